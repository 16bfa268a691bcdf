"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier per bit weighs hashed letter bigrams
and trigrams by the log ratio of their frequencies in the languages on either side of the bit. The
counts behind it cover all learning rows and are summed by Spark; the model on the driver holds
languages x buckets numbers. Margins are scaled so that the languages of a side lie beyond +1 or -1.
Decoding weighs each bit's exponential loss by how well that bit separates the language and takes
the codeword of least loss; a small gap to the second is flagged as ambiguous.
"""

from itertools import product
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ebbtide.llm.ngrams import LETTER, UPPER, classes, hashed, pieces
from ebbtide.llm.sending import broadcast, received

BUCKETS = 1 << 14
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def codewords(k, seed=11):
    """One row per language; every bit splits the languages. Up to five languages get all splits,
    more get the random code of largest distance among 200 draws."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([(1,) + bits for bits in product((1, -1), repeat=k - 1) if -1 in bits]).T.astype(float)
    rng, best, gap = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, ceil(10 * log2(k))))
        code = code[:, abs(code.sum(axis=0)) < k]
        least = min(np.count_nonzero(code[i] != code[j]) for i in range(k) for j in range(i))
        if least > gap:
            best, gap = code, least
    return best


def letters(text, table):
    """Pieces of the lower-cased text with every run of other characters as one space."""
    for codes in pieces(f" {text.lower()} ", 2):
        alpha = (table[codes] == LETTER) | (table[codes] == UPPER)
        keep = alpha.copy()
        keep[1:] |= alpha[:-1]
        yield np.where(alpha, codes, np.uint32(32))[keep | (np.arange(len(codes)) == 0)], bool(alpha.any())


def counted(text, table, buckets):
    """Counts of the text's n-grams by bucket; whether it has a letter."""
    counts, found = np.zeros(buckets), False
    for codes, any_letter in letters(text, table):
        found |= any_letter
        for width in (2, 3):
            counts += np.bincount(hashed(codes, width, buckets, width), minlength=buckets)
    return counts, found


def frequencies(docs, buckets):
    """(lang, bucket, n) over all rows of docs (text, lang)."""
    def run(batches):
        table, sums = classes(), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, found = counted(text, table, buckets)
                if found:
                    sums[lang] = sums.get(lang, 0) + counts
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))],
                ["lang", "bucket", "n"])
    parts = docs.mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Codes:
    """The fitted classifiers and what decoding needs."""

    def __init__(self, names, counts, smooth=0.5):
        self.names = names
        self.code = codewords(len(names))
        share = (counts + smooth) / (counts + smooth).sum(axis=1, keepdims=True)
        up = np.stack([share[c > 0].mean(axis=0) for c in self.code.T], axis=1)
        down = np.stack([share[c < 0].mean(axis=0) if (c < 0).any() else share.mean(axis=0) for c in self.code.T], axis=1)
        self.weights = np.log(up) - np.log(down)
        mean = share @ self.weights
        spread = np.sqrt(np.maximum(share @ self.weights**2 - mean**2, 1e-12))
        low = np.where(self.code > 0, mean, np.inf).min(axis=0)
        high = np.where(self.code < 0, mean, -np.inf).max(axis=0)
        high = np.where(np.isfinite(high), high, low - 2)
        self.middle, self.half = (low + high) / 2, np.maximum((low - high) / 2, 1e-9)
        trust = np.maximum((mean - self.middle) * self.code, 1e-9) / spread
        self.trust = trust / trust.sum(axis=1, keepdims=True)

    def losses(self, counts):
        z = np.clip((counts @ self.weights / max(counts.sum(), 1) - self.middle) / self.half, -3, 3)
        return (self.trust * np.exp(-z * self.code)).sum(axis=1)


def fit(docs, buckets=BUCKETS):
    """Codes learned from all rows of docs (text, lang) that have both."""
    rows = frequencies(docs.where("text is not null and lang is not null").select("text", "lang"), buckets).collect()
    names = sorted({r.lang for r in rows})
    counts, at = np.zeros((len(names), buckets)), {name: k for k, name in enumerate(names)}
    for r in rows:
        counts[at[r.lang], r.bucket] = r.n
    return Codes(names, counts) if names else None


def judged(text, codes, table, buckets, gap, sharpness):
    """(language, score, ambiguous) of one text. Null texts, texts without letters and all texts
    under an empty model are `und` with score 0 and ambiguous."""
    counts, found = counted(text, table, buckets) if text and codes else (None, False)
    if not found:
        return "und", 0.0, True
    loss = codes.losses(counts)
    best = int(loss.argmin())
    others = np.delete(loss, best)
    doubt = bool(len(others) and others.min() - loss[best] < gap)
    return codes.names[best], float(1 / np.exp(-sharpness * (loss - loss[best])).sum()), doubt


def predict(docs, model, buckets=BUCKETS, gap=0.1, sharpness=4.0):
    """docs (doc_id, held_out, text) with lang_pred, score and ambiguous."""
    shared = broadcast(docs.sparkSession, model)

    def run(batches):
        table, codes = classes(), received(shared)
        for batch in batches:
            found = [judged(t, codes, table, buckets, gap, sharpness) for t in batch.column(2).to_pylist()]
            names, scores, doubts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(doubts, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
    return docs.mapInArrow(run, RESULT)


def held_out(modulus, remainder):
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def filtered(docs, modulus=4, remainder=2, buckets=BUCKETS, gap=0.1, sharpness=4.0):
    """The rows of docs, all columns, whose language the model of `identify` recognises beyond doubt."""
    shared = broadcast(docs.sparkSession, fit(docs.where(~held_out(modulus, remainder))))
    at = docs.columns.index("text")

    def run(batches):
        table, codes = classes(), received(shared)
        for batch in batches:
            sure = [not judged(t, codes, table, buckets, gap, sharpness)[2] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(sure, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def identify(docs, modulus=4, remainder=2):
    """Predict the language of every text, learning from the rows whose crc32(doc_id) mod `modulus`
    is not `remainder` and whose lang is given. Rows without doc_id are judged, never learned from."""
    rows = docs.select("doc_id", "text", "lang", held_out(modulus, remainder).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"), model)
