"""Exact and approximate vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import ann, topk

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k, change):
    """(query, rank) -> (vec_id, score), ties to the smaller id."""
    width = max((len(v) for _, v in rows), default=0)
    vectors = {i: change(np.pad(np.array(v, np.float32).astype(float), (0, width - len(v)))) for i, v in rows}
    out = {}
    for q in (i for i in vectors if i % every == 0):
        best = sorted((-(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:k]
        out.update({(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)})
    return out


def integer(v):
    return np.floor(v * 1024).astype(np.int64)


def found(df):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], KIND)


def random_rows(seed, n=700, width=12):
    rng = np.random.default_rng(seed)
    return [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, width)).astype(np.float32))]


ODD = [(1000, None), (1100, [1.0, None]), (1200, [float("nan"), 1.0]), (1300, [float("inf"), 1.0]), (None, [1.0, 2.0])]


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_exact_search(spark, lists):
    rows = random_rows(1) + [(k, [0.5, -0.25]) for k in range(2000, 2040)] + [(3000, [0.0] * 12), (3100, [])]
    out = topk.search(table(spark, rows + ODD), every=50, lists=lists, query_block=9)
    assert found(out) == brute(rows, 50, 10, integer)


def test_exact_search_of_large_components(spark):
    rows = [(k, [x * 30_000 for x in v]) for k, v in random_rows(2, 300)]
    assert found(topk.search(table(spark, rows), every=50)) == brute(rows, 50, 10, integer)


def test_components_of_any_size(spark):
    """Sums beyond 2**53, products beyond 2**63 that cancel out, and components beyond 64 bits."""
    near = [(200_000, [1.0]), (300_000, [0.0]), (150_000, [5.0])]
    rows = [(0, [300_000.0, 5.0]), (1, [200_000.0, 0.0]), (2, [150_000.0, 5.0]), *((k + 10, v) for k, (_, v) in enumerate(near))]
    assert [found(topk.search(table(spark, rows)))[0, n] for n in (1, 2)] == [(1, 62914560000000000), (2, 47185920026214400)]
    rng = np.random.default_rng(4)
    wild = [(k, (rng.normal(size=5) * 10.0 ** rng.integers(0, 5, 5)).tolist()) for k in range(400)]
    wild += [(1000 + k, [3e8, x, 0.0, 0.0, 0.0]) for k, x in enumerate((0.0, 1.0, 1.0, 2.0))]
    vectors = {i: [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v] for i, v in wild}
    assert found(topk.search(table(spark, [r for r in wild if r[0] != 1000]))) == brute_ints(vectors, 1000)
    huge = [(100, [0.0, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 3.0])]
    assert found(topk.search(table(spark, huge))) == {(100, 1): (2, 3 * 2**20), (100, 2): (1, 2 * 2**20)}
    with pytest.raises(Exception, match="SCORE_OUT_OF_RANGE"):
        topk.search(table(spark, [(100, [3e30]), (1, [1e30])]))


def brute_ints(vectors, left_out):
    vectors = {i: v for i, v in vectors.items() if i != left_out}
    out = {}
    for q in (i for i in vectors if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:10]
        out.update({(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)})
    return out


def test_threshold_saves_work(spark):
    """Most vectors are short in all lists, some in the second one: few products are needed."""
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) * (1.0 if k % 50 == 0 else 0.02)).tolist()) for k in range(4000)]
    work = {}
    out = topk.search(table(spark, rows), every=100, lists=4, work=work)
    assert found(out) == brute(rows, 100, 10, integer)
    assert 0 < work["done"] < 0.8 * work["possible"]


def test_columns_that_clash(spark):
    """Names of the results as columns of the input."""
    rows = random_rows(6, 200)
    kind = "rank string, score string, leaf string, query_id string, vec_id long, embedding array<float>"
    odd = spark.createDataFrame([("r", "s", "l", "q", i, v) for i, v in rows], kind)
    assert found(topk.search(odd, every=50)) == brute(rows, 50, 10, integer)
    assert found(ann.search(odd, every=50)) == brute(rows, 50, 20, lambda v: v)


def test_exact_search_with_few_or_no_rows(spark):
    rows = [(100, [1.0, 0.0]), (7, [0.5, 0.5]), (9, [0.5, 0.5])]
    assert found(topk.search(table(spark, rows))) == {(100, 1): (7, 512 * 1024), (100, 2): (9, 512 * 1024)}
    assert found(topk.search(table(spark, [(100, [1.0])]))) == {}
    assert found(topk.search(table(spark, []))) == {}


def test_repeated_ids_count_once(spark):
    rows = [(100, [1.0, 0.0]), (100, [2.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    assert found(topk.search(table(spark, rows))) == {(100, 1): (3, 2048 * 1024)}


def test_tree_search_recall(spark):
    rows = random_rows(3, 3000, 16)
    truth = brute(rows, 20, 20, lambda v: v)
    out = ann.search(table(spark, rows + ODD + [(4000, [0.0] * 16)]), sample=1000, leaf_rows=60, branches=4)
    got = found(out)
    hits = sum(len({got[k][0] for k in got if k[0] == q} & {truth[k][0] for k in truth if k[0] == q})
               for q in {q for q, _ in truth})
    assert hits / len(truth) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 and i != q for (q, _), (i, s) in got.items())
    assert len(got) == len(truth)


def test_tree_search_of_equal_vectors(spark):
    """A vector held by most rows fills its leaf, which is cut into chunks; ties go to smaller ids."""
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(3000)] + [(5000 + k, [float(k), 1.0, 0.0]) for k in range(50)]
    out = found(ann.search(table(spark, rows), every=500))
    assert out == brute(rows, 500, 20, lambda v: v)


def test_hot_leaf_is_compared_by_many_tasks(spark):
    """One leaf holds all vectors and is visited by all queries: its pairs of chunks are dealt out."""
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(6000)]
    vectors = table(spark, rows).select("vec_id", "embedding").selectExpr("0 AS leaf", "*")
    queries = vectors.selectExpr("leaf", "vec_id AS query_id", "-1.0D AS bound", "embedding")
    pairs = ann.pairs_of_chunks(queries, vectors)
    held = pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in held) >= 36 and len(held) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tree_search_with_few_or_no_rows(spark):
    rows = [(20, [1.0, 0.0]), (7, [0.5, 0.5]), (9, [0.0, 0.0])]
    assert found(ann.search(table(spark, rows))) == {(20, 1): (7, 0.5)}
    assert found(ann.search(table(spark, []))) == {}
    assert found(ann.search(table(spark, [(20, [1.0])]))) == {}


def test_visits_are_best_first():
    rows = np.random.default_rng(0).normal(size=(800, 6))
    tree = ann.Tree(rows, np.arange(800), 50, 4)
    order = tree.visits(rows[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and order[:3] == tree.visits(rows[0], 3)
    assert set(tree.leaf(rows)) <= set(range(tree.leaves))


def test_bounds_hold():
    """No bound lies above the k-th best score among the vectors in the visited leaves."""
    rows, ids = np.random.default_rng(1).normal(size=(600, 5)), np.arange(600)
    tree = ann.Tree(rows, ids, 40, 4)
    visits = [tree.visits(q, 4) for q in rows[:50]]
    for q, leaves, bound in zip(range(50), visits, tree.bounds(ids[:50], rows[:50], visits, 7)):
        inside = [rows[i] @ rows[q] for i in ids if i != q and tree.homes[i] in leaves]
        assert bound <= sorted(inside)[-7] if len(inside) >= 7 else bound == -np.inf
