"""Quality by votes of the nearest labelled texts in a latent-semantic space.

A text is described by the square roots of the shares of its hashed n-grams: trigrams of character
classes (what the text looks like) and bigrams of lower-cased characters; and of the share of words
that repeat the word before them. The labelled sample, at
most `sample` texts of each label, is decomposed into `dims` latent directions. Its vectors are
broadcast (2 x sample x dims numbers, fixed by the parameters); every text is compared with all of
them in blocks of exact cosine products and its nearest `neighbours` vote with weights by similarity.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ebbtide.llm.ngrams import FACTOR, SPACE, classes, hashed, pieces
from ebbtide.llm.sending import broadcast, received

BUCKETS, BLOCK = 2049, 256
REPEATED = 0.25
FIRST = np.uint32(0x110000)
FEATURES = "quality int, features binary"
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def features(text, table, buckets):
    """Square roots of shares: the first half of the buckets but the last holds class trigrams, the second
    lower-cased bigrams, the last repeated words. Zero for a null or empty text."""
    half = (buckets - 1) // 2
    out, words, repeated = np.zeros(2 * half), 0, 0
    if not text:
        return np.zeros(2 * half + 1)
    for codes in pieces(text, 2):
        kind = table[codes]
        hashes = word_hashes(codes, kind == SPACE)
        words, repeated = words + len(hashes), repeated + np.count_nonzero(hashes[1:] == hashes[:-1])
        out[:half] += np.bincount(hashed(np.where(kind > 0, FIRST + kind, codes), 3, half, 3), minlength=half)
    for codes in pieces(text.lower(), 1):
        out[half:] += np.bincount(hashed(codes, 2, half, 2), minlength=half)
    return np.sqrt(np.append(out / max(out.sum(), 1), REPEATED * repeated / max(words, 1)))


def word_hashes(codes, space):
    """A number for each run of codes that are no white space."""
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    mixed = (codes ^ (codes >> np.uint32(7))) * FACTOR
    return np.add.reduceat(np.where(space, 0, (mixed ^ (mixed >> np.uint32(15))).astype(np.uint64)), starts)


class Neighbours:
    """Latent directions and the labelled vectors in them."""

    def __init__(self, rows, labels, dims, seed=5, overwrite=False):
        """`overwrite`: rows may be centred in place, so that no second matrix is held."""
        self.mean = rows.mean(axis=0)
        seen = (rows > 0).sum(axis=0)
        self.scale = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(rows.dtype)
        centred = rows if overwrite else rows.copy()
        centred -= self.mean
        centred *= self.scale
        rng = np.random.default_rng(seed)
        base = np.linalg.qr(centred @ rng.standard_normal((rows.shape[1], dims + 16)).astype(rows.dtype))[0]
        for _ in range(3):
            base = np.linalg.qr(centred @ (centred.T @ base))[0]
        _, _, directions = np.linalg.svd(base.T @ centred, full_matrices=False)
        self.directions = directions[:dims].T.astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.vectors = self.directed(centred)
        self.prior = float(labels.mean())

    def project(self, rows):
        return self.directed((rows - self.mean) * self.scale)

    def directed(self, centred):
        out = centred.astype(np.float32, copy=False) @ self.directions
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, rows, neighbours, power):
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        cosine = self.project(rows) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6) ** power
        votes = (weights * self.labels[near]).sum(axis=1) / weights.sum(axis=1)
        return np.where(rows.any(axis=1), np.clip(votes, 0, 1), self.prior)


def fit(docs, labels, sample, dims, buckets=BUCKETS):
    """Model from at most `sample` texts of each label, those of smallest hash. None without labels."""
    known = (labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").cast("int").alias("quality")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("quality = 0").orderBy(*order).limit(sample).unionByName(
        known.where("quality = 1").orderBy(*order).limit(sample))
    texts = docs.where("text != ''").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", "text")

    def run(batches):
        table = classes()
        for batch in batches:
            rows = [features(t, table, buckets).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["quality", "features"])
    rows, marks = np.empty((2 * sample, buckets), np.float32), []
    for r in texts.mapInArrow(run, FEATURES).orderBy("features").toLocalIterator():
        if len(marks) == len(rows):  # repeated doc_ids
            rows = np.concatenate([rows, np.empty_like(rows)])
        rows[len(marks)] = np.frombuffer(r.features, np.float32)
        marks.append(r.quality)
    if not marks:
        return None
    return Neighbours(rows[:len(marks)], np.array(marks, float), dims, overwrite=True)


def scored(texts, fitted, table, neighbours, power, buckets):
    """Scores of a block of texts. Null and empty texts get the share of label 1 in the sample;
    without any label all scores are 0.5."""
    if fitted is None or not texts:
        return np.full(len(texts), 0.5)
    rows = np.stack([features(t, table, buckets) for t in texts])
    return fitted.scores(rows, neighbours, power).astype(float)


def score(docs, model, threshold=0.3, neighbours=25, power=4.0, buckets=BUCKETS):
    """docs (doc_id, held_out, text) with score and predicted, see `scored`."""
    shared = broadcast(docs.sparkSession, model)

    def run(batches):
        table, fitted = classes(), received(shared)
        for batch in batches:
            column = batch.column(2)
            found = np.concatenate([np.empty(0), *(
                scored(column.slice(at, BLOCK).to_pylist(), fitted, table, neighbours, power, buckets)
                for at in range(0, batch.num_rows, BLOCK))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    return docs.mapInArrow(run, RESULT)


def filtered(docs, labels, threshold=0.3, neighbours=25, power=4.0, modulus=5, remainder=0, sample=2048, dims=48,
             buckets=BUCKETS):
    """The rows of docs, all columns, whose text scores at least `threshold` by the model of `classify`."""
    shared = broadcast(docs.sparkSession, learned(docs, labels, modulus, remainder, sample, dims))
    at = docs.columns.index("text")

    def run(batches):
        table, fitted = classes(), received(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                scores = scored(part.column(at).to_pylist(), fitted, table, neighbours, power, buckets)
                yield part.filter(pa.array(scores >= threshold))
    return docs.mapInArrow(run, docs.schema)


def learned(docs, labels, modulus, remainder, sample, dims):
    """Model from the labels of rows whose crc32(doc_id) mod `modulus` is not `remainder`."""
    held = F.crc32(F.col("doc_id").cast("string")) % modulus == remainder
    return fit(docs, labels.select("doc_id", "quality").where(~held), sample, dims)


def classify(docs, labels, modulus=5, remainder=0, sample=2048, dims=48):
    """Score every text, learning from labels of rows whose crc32(doc_id) mod `modulus` is not
    `remainder`. Rows without doc_id are scored, never learned from."""
    held = F.crc32(F.col("doc_id").cast("string")) % modulus == remainder
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return score(rows, learned(docs, labels, modulus, remainder, sample, dims))
