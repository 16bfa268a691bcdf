"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on at most `sample` vectors (those of smallest hash) and sent to the executors; its
size is fixed by the parameters. Vectors get one more component that brings all to the same norm, so
that the nearest in the tree's space have the largest inner products. Every vector is indexed under
its leaf; leaves are cut into chunks of bounded size, so equal vectors do not pile up in one task.

A query walks the tree best bin first: a priority queue holds the nodes met so far by distance, the
nearest is opened, and leaves come out in the order in which they are visited. The sample vectors in
those leaves give a lower bound of the query's k-th best score there, so that chunks hand on only
what can still be among the k best. How many leaves are visited is calibrated: for some sample vectors
the true neighbours are found among all vectors by a blocked pass, and visits are widened until the
wanted share of them lies in the visited leaves.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.sending import broadcast, received
from ebbtide.llm.topk import ranked
from ebbtide.llm.vectors import best, found_rows, leading, matrix, usable
from ebbtide.session import materialize

CHUNK, QUERIES = 1024, 512
FOUND = "query_id long, vec_id long, score double"


def kmeans(rows, k, rng, rounds=12):
    """Centres and the centre of each row; centres without rows are dropped."""
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        own = nearest(rows, centres)
        used = np.unique(own)
        centres = np.stack([rows[own == c].mean(axis=0) for c in used])
    return centres, nearest(rows, centres)


def nearest(rows, centres):
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


class Tree:
    """Nodes as (centres, children); a child is a node number or, below zero, a leaf."""

    def __init__(self, rows, ids, leaf_rows, branches, seed=3):
        self.radius = float(np.linalg.norm(rows, axis=1).max(initial=0))
        self.width, self.nodes, self.leaves = rows.shape[1], [], 0
        self.root = self.grow(self.lifted(rows), max(leaf_rows, 2), branches, np.random.default_rng(seed))
        self.rows, self.ids, self.homes = rows, ids, self.leaf(rows)

    def lifted(self, rows):
        """Rows with one more component, which fills their norm up to the radius."""
        rest = np.sqrt(np.maximum(self.radius**2 - (rows**2).sum(axis=1), 0))
        return np.concatenate([rows, rest[:, None]], axis=1)

    def grow(self, rows, leaf_rows, branches, rng):
        parts = min(branches, -(-len(rows) // leaf_rows))
        if parts > 1:
            centres, own = kmeans(rows, parts, rng)
            if len(centres) > 1:
                at = len(self.nodes)
                self.nodes.append(None)
                self.nodes[at] = centres, [self.grow(rows[own == c], leaf_rows, branches, rng) for c in range(len(centres))]
                return at
        self.leaves += 1
        return -self.leaves

    def leaf(self, rows):
        """Leaf number of each row, by the nearest centre at every node."""
        out, lifted = np.zeros(len(rows), np.int32), self.lifted(rows)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
            elif len(at):
                centres, children = self.nodes[node]
                own = nearest(lifted[at], centres)
                todo += [(child, at[own == c]) for c, child in enumerate(children)]
        return out

    def bounds(self, ids, queries, visited, k):
        """For each query a value that its k-th best score in the visited leaves does not fall below."""
        inside = np.zeros((len(queries), self.leaves), bool)
        for row, leaves in zip(inside, visited):
            row[leaves] = True
        scores = np.where(inside[:, self.homes] & (ids[:, None] != self.ids), queries @ self.rows.T, -np.inf)
        if scores.shape[1] < k:
            return np.full(len(queries), -np.inf)
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        return np.where(np.isfinite(kth), kth - 1e-9 * abs(kth), kth)

    def visits(self, query, most):
        """The first `most` leaves in best-bin-first order."""
        q, out = np.append(query, 0.0), []
        queue = [(0.0, self.root)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                continue
            centres, children = self.nodes[node]
            for gap, child in zip((centres**2).sum(axis=1) - 2 * centres @ q, children):
                heapq.heappush(queue, (float(gap), child))
        return out


def index(vectors, shared):
    """(leaf, vec_id, embedding) for every vector."""
    def run(batches):
        tree = received(shared)
        for batch in batches:
            leaf = tree.leaf(matrix(batch.column(1), tree.width, np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "vec_id", "embedding"])
    return vectors.mapInArrow(run, f"leaf int, vec_id long, {vectors.select('embedding').schema.simpleString()[7:-1]}")


def neighbours(indexed, rows, ids, width, k):
    """For each of the given queries its k nearest of all vectors, with their leaves: exact products
    in one blocked pass. Each task hands on at most k rows a query."""
    shared = broadcast(indexed.sparkSession, (rows, ids))

    def run(batches):
        queries, own = received(shared)
        top = [np.empty((len(own), 0)), np.empty((len(own), 0), np.int64), np.empty((len(own), 0), np.int64)]
        for batch in batches:
            x = matrix(batch.column(2), width, np.float64)
            vec, leaf = batch.column(1).to_numpy(), batch.column(0).to_numpy().astype(np.int64)
            scores = np.where(own[:, None] != vec, queries @ x.T, -np.inf)
            at = best(scores, k)
            now = [np.take_along_axis(scores, at, axis=1), vec[at], leaf[at]]
            both = [np.concatenate(pair, axis=1) for pair in zip(top, now)]
            keep = best(both[0], k)
            top = [np.take_along_axis(b, keep, axis=1) for b in both]
        real = np.isfinite(top[0])
        query = np.nonzero(real)[0]
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), *(pa.array(t[real]) for t in (top[1], top[0], top[2]))],
                                         ["query_id", "vec_id", "score", "leaf"])
    found = indexed.mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "leaf")


def calibrated(tree, indexed, rows, ids, k, recall):
    """Leaf visits that find the wanted share of the true neighbours of the given queries."""
    order = [{leaf: n for n, leaf in enumerate(tree.visits(q, tree.leaves), 1)} for q in rows]
    needed = sorted(order[r.query_id][r.leaf] for r in neighbours(indexed, rows, ids, tree.width, k).collect())
    return needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1] if needed else tree.leaves


def visited(queries, shared, visits, k):
    """(leaf, query_id, bound, embedding) for every leaf that a query visits."""
    def run(batches):
        tree = received(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                vectors = matrix(part.column(1), tree.width, np.float64)
                leaves = [tree.visits(q, visits) for q in vectors]
                bounds = pa.array(tree.bounds(part.column(0).to_numpy(), vectors, leaves, k))
                rows = pa.array(np.repeat(np.arange(len(leaves)), [len(x) for x in leaves]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([leaf for x in leaves for leaf in x], pa.int32()),
                     *(c.take(rows) for c in (part.column(0), bounds, part.column(1)))],
                    ["leaf", "query_id", "bound", "embedding"])
    return queries.mapInArrow(
        run, f"leaf int, query_id long, bound double, {queries.select('embedding').schema.simpleString()[7:-1]}")


def chunked(rows, key, size, name, *more):
    """Rows of each leaf packed into lists of about `size`; large leaves are dealt by hash."""
    counts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("chunks"))
    return (rows.join(counts, "leaf").withColumn("chunk", F.pmod(F.xxhash64(key), "chunks"))
            .groupBy("leaf", "chunk").agg(F.collect_list(F.struct(F.col(key).alias("id"), "embedding", *more)).alias(name))
            .withColumnRenamed("chunk", f"{name}_chunk"))


def pairs_of_chunks(queries, indexed):
    """Chunks of queries next to chunks of vectors of the same leaf. A leaf that holds many vectors or is
    visited by many queries is dealt to many tasks."""
    pairs = chunked(queries, "query_id", QUERIES, "queries", "bound").join(chunked(indexed, "vec_id", CHUNK, "items"), "leaf")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is not made smaller
    return pairs.repartition(tasks, "leaf", "queries_chunk", "items_chunk")


def compared(pairs, width, k):
    """The k best of each query among the vectors of a pair of chunks."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                (own, q, bound), (ids, x) = (unpacked(batch.column(c), row, width) for c in (0, 1))
                scores = np.where(own[:, None] != ids, q @ x.T, -np.inf)
                least = np.take_along_axis(scores, best(scores, k), axis=1).min(axis=1, keepdims=True)
                query, place = np.nonzero((scores >= np.maximum(least, bound[:, None])) & np.isfinite(scores))
                kept = leading(query, ids[place], scores[query, place], k)
                query, place = query[kept], place[kept]
                yield found_rows(own[query], ids[place], scores[query, place], pa.float64())
    return pairs.select("queries", "items").mapInArrow(run, FOUND)


def unpacked(column, row, width):
    part = column.slice(row, 1).flatten()
    rest = [part.field(n).to_numpy() for n in range(2, part.type.num_fields)]
    return part.field(0).to_numpy(), matrix(part.field(1), width, np.float64), *rest


def search(embeddings, every=20, k=20, recall=0.96, sample=16_384, leaf_rows=512, branches=16, trials=96):
    """query_id, rank, vec_id, score for each vector whose id is divisible by `every`: its nearest
    found, by exact inner products of the original vectors, ties to the smaller id. Zero vectors take
    no part; shorter vectors count as filled with zeros."""
    vectors = materialize(usable(embeddings).where("exists(embedding, x -> x != 0)"), "vectors")
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not size[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    rows, ids = np.zeros((len(picked), size[1])), np.array([r.vec_id for r in picked], np.int64)
    for n, r in enumerate(picked):
        rows[n, :len(r.embedding)] = r.embedding
    tree = Tree(rows, ids, max(len(picked) * leaf_rows // size[0], 8), branches)
    shared = broadcast(spark, tree)
    indexed = materialize(index(vectors, shared), "leaves")
    visits = calibrated(tree, indexed, rows[:trials], ids[:trials], k, recall)
    queries = visited(vectors.where(F.col("vec_id") % every == 0), shared, visits, k)
    return ranked(compared(pairs_of_chunks(materialize(queries, "visits"), indexed), size[1], k), k)
