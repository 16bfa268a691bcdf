"""Exact top-k by inner product with a three-phase uniform threshold.

The dimensions are cut into `lists` blocks, those of most energy first; the inner product within a block
is a local score, and the score of a vector is the sum of its local scores. What is not yet computed is
bounded by the norms of the blocks. Queries are taken in blocks of at most `query_block`, so what is
broadcast has a fixed bound.

1. Every task gathers, for each query, the heads of its first local list. Only their full scores are
   computed; the k-th best of all is a lower bound of the k-th best score: the safe cutoff, which is
   broadcast.
2. With m lists, a vector can only reach the cutoff if its local scores and the bounds of the lists to
   come add up to it. Pieces of vectors whose norms miss the cutoff of a query are skipped whole, then
   the first list is computed, and later lists only for entries that are still sufficient.
3. What is left is resolved exactly; entries at or above the cutoff are returned and ranked.

Components are whole numbers of any size. Local scores are exact doubles where no sum can pass 2**53;
elsewhere they carry a bound of their rounding errors, entries are kept unless they miss the cutoff by more
than that, and scores are resolved in integers of any length. A score among the results that does not
fit 64 bits ends the query with SCORE_OUT_OF_RANGE.

Rows that repeat a vec_id count once, with the greatest vector; shorter vectors count as filled with zeros;
null vectors and those with null or non-finite components take no part; ties go to the smaller id.
Columns other than vec_id and embedding are not read. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.sending import broadcast, received
from ebbtide.llm.vectors import best, matrix, usable
from ebbtide.session import materialize, new_path

EXACT, LONG = 2.0**53, 2**63
ROWS = 1024
SPARSE = 0.05  # below this share of survivors, single products are cheaper than whole rows
FOUND = "query_id long, vec_id long, score long, fits boolean"


def integers(embeddings, scale):
    """(vec_id, items) with floor(scale * x) as doubles: from 2**52 on every double is whole."""
    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return usable(embeddings).select("vec_id", F.transform("embedding", whole).alias("items"))


def by_energy(vectors, width):
    """Dimensions in descending order of their sums of squares."""
    sums = (vectors.select(F.posexplode("items").alias("at", "x")).groupBy("at")
            .agg(F.sum(F.col("x") * F.col("x")).alias("energy")).collect())  # one row per dimension
    energy = np.zeros(width)
    for r in sums:
        energy[r["at"]] = r.energy
    return np.argsort(-energy, kind="stable")


class Block:
    """Queries of one block, cut into lists of dimensions."""

    def __init__(self, rows, order, lists):
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        self.order, self.width = order, len(order)
        items = np.zeros((len(rows), self.width))
        for k, r in enumerate(rows):
            items[k, :len(r["items"])] = r["items"]
        self.items = items[:, order]
        self.edges = np.linspace(0, self.width, min(lists, max(self.width, 1)) + 1).astype(int)
        self.spans = list(zip(self.edges, self.edges[1:]))
        self.norms = [np.linalg.norm(self.items[:, a:b], axis=1) for a, b in self.spans]
        self.peak = abs(self.items).max(initial=0)

    def piece(self, batch):
        """(ids, items, norms by list, whether products are exact) of a batch of vectors."""
        x = matrix(batch.column(1), self.width, np.float64)[:, self.order]
        exact = self.peak * abs(x).max(initial=0) * max(self.width, 1) < EXACT
        return batch.column(0).to_numpy(), x, [np.linalg.norm(x[:, a:b], axis=1) for a, b in self.spans], exact

    def error(self, norms, exact):
        """Bound of the rounding errors of all scores of a piece (queries x vectors)."""
        if exact:
            return 0.0
        sizes = np.sqrt(sum(n * n for n in self.norms))[:, None] * np.sqrt(sum(n * n for n in norms))[None, :]
        return sizes * (4 * self.width + 8) * 2.0**-53


def pair_scores(q, x, query, at, span):
    a, b = span
    return np.einsum("ij,ij->i", q[query, a:b], x[at, a:b])


def gathered(vectors, shared, k, seen):
    """Phase 1: (query, score), lower bounds of the k best gathered entries of each task."""
    def run(batches):
        block = received(shared)
        top = np.full((len(block.ids), k), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, x, norms, exact = block.piece(batch.slice(start, ROWS))
                if not block.spans:
                    continue
                a, b = block.spans[0]
                first = block.items[:, a:b] @ x[:, a:b].T
                first[block.ids[:, None] == ids[None, :]] = -np.inf
                heads = best(first, k)
                query, at = np.repeat(np.arange(len(block.ids)), heads.shape[1]), heads.ravel()
                scores = first[query, at] + sum(pair_scores(block.items, x, query, at, s) for s in block.spans[1:])
                error = block.error(norms, exact)
                scores = scores - (error[query, at] if not exact else 0.0)
                seen[0].add(first.size * (b - a) + len(query) * (block.width - b))
                both = np.concatenate([top, scores.reshape(heads.shape)], axis=1)
                top = np.take_along_axis(both, best(both, k), axis=1)
        query, _ = np.nonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(top[np.isfinite(top)])], ["query", "score"])
    return vectors.mapInArrow(run, "query int, score double")


def sufficient(block, ids, x, norms, exact, cutoff, seen):
    """Phase 2 for one piece: positions (query, vector) of the entries that may reach the cutoff, and
    their scores as doubles."""
    slack = block.error(norms, exact)
    bounds = [(q[:, None] * n[None, :]) * (1 + 1e-12) for q, n in zip(block.norms, norms)]
    upper = sum(bounds) + slack
    alive = np.flatnonzero((upper >= cutoff).any(axis=1))  # queries that the piece's norms may serve
    if not len(alive) or not len(ids):
        return alive[:0], alive[:0], np.empty(0)
    cut, own = cutoff[alive], block.ids[alive]
    slack = slack[alive] if not exact else 0.0
    scores, query, at = np.zeros((len(alive), len(ids))), None, None
    for n, (a, b) in enumerate(block.spans):
        rest = sum((bound[alive] for bound in bounds[n + 1:]), np.zeros(scores.shape))  # of the lists to come
        if query is None:
            scores += block.items[alive, a:b] @ x[:, a:b].T
            seen[0].add(scores.size * (b - a))
            keep = (scores + rest * (1 + 1e-9) + slack >= cut) & (own[:, None] != ids[None, :])
            if keep.mean() < SPARSE:
                query, at = np.nonzero(keep)
        else:
            scores[query, at] += pair_scores(block.items, x, alive[query], at, (a, b))
            seen[0].add(len(query) * (b - a))
            keep = scores[query, at] + rest[query, at] * (1 + 1e-9) + (slack[query, at] if not exact else 0.0) >= cut[query, 0]
            query, at = query[keep], at[keep]
    if query is None:
        query, at = np.nonzero(keep)
    return alive[query], at, scores[query, at]


def resolved_scores(block, x, query, at, scores, exact):
    """Phase 3: whole scores, as Python integers where doubles could round."""
    if exact:
        return scores.astype(np.int64).astype(object)
    whole = [np.array([int(v) for v in row], object) for row in (x[k] for k in np.unique(at))]
    vectors = dict(zip(np.unique(at), whole))
    queries = {q: np.array([int(v) for v in block.items[q]], object) for q in np.unique(query)}
    return np.array([(queries[q] * vectors[k]).sum() for q, k in zip(query, at)], object)


def first_of_each(query, ids, scores, k):
    """Positions of each query's k highest scores, ties to smaller ids."""
    order, out, count = sorted(range(len(query)), key=lambda j: (query[j], -scores[j], ids[j])), [], {}
    for j in order:
        count[query[j]] = count.get(query[j], 0) + 1
        if count[query[j]] <= k:
            out.append(j)
    return out


def resolved(vectors, shared, cutoffs, k, seen):
    """Phases 2 and 3: (query_id, vec_id, score, fits) of the vectors that reach the query's cutoff; of a
    batch, the k first by score and id, as no others can be among the k first of all."""
    def run(batches):
        block, cutoff = received(shared), received(cutoffs)[:, None]
        for batch in batches:
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object))]
            for start in range(0, batch.num_rows, ROWS):
                ids, x, norms, exact = block.piece(batch.slice(start, ROWS))
                seen[1].add(2 * len(block.ids) * len(ids) * block.width)
                query, at, scores = sufficient(block, ids, x, norms, exact, cutoff, seen)
                found.append((query, ids[at], resolved_scores(block, x, query, at, scores, exact)))
            query, ids, scores = (np.concatenate(c) for c in zip(*found))
            kept = first_of_each(query, ids, scores, k)
            fits = [-LONG <= scores[j] < LONG for j in kept]
            held = [min(max(int(scores[j]), -LONG), LONG - 1) for j in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[query[kept]], pa.int64()), pa.array(ids[kept], pa.int64()), pa.array(held, pa.int64()),
                 pa.array(fits, pa.bool_())], ["query_id", "vec_id", "score", "fits"])
    return vectors.mapInArrow(run, FOUND)


def ranked(found, k):
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    names = ["query_id", "rank", "vec_id", *(c for c in found.columns if c not in ("query_id", "vec_id"))]
    return found.withColumn("rank", order.cast("int")).where(F.col("rank") <= k).select(names)


def checked(found):
    """Results whose scores all fit."""
    wrong = F.raise_error(F.lit("SCORE_OUT_OF_RANGE: an inner product does not fit 64 bits")).cast("long")
    return found.withColumn("score", F.when(F.col("fits"), F.col("score")).otherwise(wrong)).drop("fits")


def blocks_of(rows, size):
    """Lists of at most `size` rows from an iterator."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def search(embeddings, every=100, k=10, scale=1024.0, lists=4, query_block=2048, work=None):
    """query_id, rank, vec_id, score: the k highest integer inner products of each vector whose id is
    divisible by `every` with all others. Each block of queries costs two passes over the vectors
    and no shuffle of them. A dict given as `work` gets the numbers of single products `done` and
    `possible` in both passes (tasks that Spark repeats count again)."""
    vectors = materialize(integers(embeddings, scale), "integers")
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("items"))).first()[0] or 0
    order = by_energy(vectors, width)
    seen = [spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)]
    path = new_path(spark, "found")
    queries = vectors.where(F.col("vec_id") % every == 0)
    for rows in blocks_of(queries.toLocalIterator(), query_block):
        block = Block(rows, order, lists)
        shared = broadcast(spark, block)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        kth = (gathered(vectors, shared, k, seen).withColumn("rank", place).where(F.col("rank") == k)
               .select("query", "score").collect())
        cutoff = np.full(len(rows), -np.inf)
        cutoff[[r.query for r in kth]] = [r.score for r in kth]
        found = resolved(vectors, shared, broadcast(spark, cutoff), k, seen)
        checked(ranked(found, k)).write.mode("append").parquet(path)
        shared.unpersist()
    if work is not None:
        work.update(done=int(seen[0].value), possible=int(seen[1].value))
    kind = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(kind).parquet(path) if width or not queries.isEmpty() else spark.createDataFrame([], kind)
