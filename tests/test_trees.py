"""Forests and boosting against plain versions, phase against phase."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ebbtide.operators import boosting, forest, models, rank, trees
from ebbtide.operators.features import LABEL, ROW_ID
from ebbtide.session import new_path

M = 600


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(M, 6)), 1)
    x[:, 3:] = rng.integers(0, 2, size=(M, 3))
    return x, (rng.random(M) < 1 / (1 + np.exp(-x[:, 0] - x[:, 4]))).astype(int)


@pytest.fixture(scope="module")
def matrix(spark, data):
    rows = [(k, int(y), Vectors.dense(x)) for k, (x, y) in enumerate(zip(*data))]
    return spark.createDataFrame(rows, [ROW_ID, LABEL, "features"])


def probabilities(model, matrix):
    out = model.transform(matrix).select(ROW_ID, vector_to_array("__vector")[1].alias("p"), "__prediction")
    rows = out.orderBy(ROW_ID).collect()
    assert all(r["__prediction"] == (r.p > 0.5) for r in rows)
    return np.array([r.p for r in rows])


def gini(n0, n1):
    return (n0 * n0 + n1 * n1) / max(n0 + n1, 1e-300)


def plain_tree(x, n0, n1, key, growth, depth=0):
    """One tree by recursion, every candidate tried: a function from a row to its value."""
    t0, t1 = n0.sum(), n1.sum()
    value = growth.value(t0, t1)
    if not growth.splittable(len(x), t0, t1) or growth.max_depth is not None and depth >= growth.max_depth:
        return lambda row: value
    order = trees.mixed(np.arange(x.shape[1], dtype=np.uint64) + np.uint64(1))
    drawn = trees.mixed(key[0] ^ order) >> np.uint64(1)
    varying = sorted((f for f in range(x.shape[1]) if x[:, f].min() < x[:, f].max()), key=lambda f: drawn[f])
    found = {}
    for f in varying:
        values = np.unique(x[:, f])
        cuts = [float(trees.between(a, b)) for a, b in zip(values, values[1:])]
        if growth.random_thresholds:
            low = np.full((x.shape[1], 1), values[0])
            cuts = [growth.thresholds(key, low, np.full_like(low, values[-1]))[f, 0]]
        for cut in cuts:
            left = x[:, f] <= cut
            if growth.fits(left.sum(), len(x)):
                w0, w1 = growth.weights
                score = sum(gini(w0 * n0[s].sum(), w1 * n1[s].sum()) for s in (left, ~left))
                if f not in found or score > found[f][0]:
                    found[f] = (score, cut)
    tried = [f for f in varying[:growth.features] if f in found] or [f for f in varying if f in found][:1]
    if not tried:
        return lambda row: value
    f = max(sorted(tried), key=lambda f: found[f][0])
    cut = found[f][1]
    sides = [plain_tree(x[s], n0[s], n1[s], trees.child_keys(key, right), growth, depth + 1)
             for s, right in ((x[:, f] <= cut, False), (x[:, f] > cut, True))]
    return lambda row: sides[int(row[f] > cut)](row)


@pytest.mark.parametrize("random,bootstrap,depth", [(False, True, None), (True, False, None), (False, False, 3)])
def test_forest_equals_plain_trees_in_both_phases(data, matrix, random, bootstrap, depth):
    x, y = data
    weights = tuple(M / (2 * (y == c).sum()) for c in (0, 1))
    growth = trees.Growth(2, weights, min_leaf=2, max_depth=depth, random_thresholds=random)
    want = np.zeros(M)
    for key in trees.tree_keys(42, range(4)):
        times = trees.bag_counts(key, np.arange(M)) if bootstrap else np.ones(M, int)
        own = times > 0
        tree = plain_tree(x[own], (times * (1 - y))[own], (times * y)[own], np.array([key]), growth)
        want += [tree(row) for row in x]
    # 1: nodes of 256 rows and more are split by passes over all rows.
    for cells, parts in ((forest.CELLS, 3), (1, 5)):
        fit = forest.Forest(4, depth, 2, bootstrap=bootstrap, random_thresholds=random, ranges=128, cells=cells)
        assert probabilities(fit.fit(matrix.repartition(parts)), matrix) == pytest.approx(want / 4, abs=1e-12)


def test_ranges_part_where_values_are_many(spark):
    """More values than ranges: borders cut the rows evenly and no row is lost."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    y = (x[:, 0] + 0.1 * rng.normal(size=2000) > 0).astype(int)
    rows = spark.createDataFrame([(k, int(b), Vectors.dense(a)) for k, (a, b) in enumerate(zip(x, y))], [ROW_ID, LABEL, "features"])
    fit = forest.Forest(5, ranges=16, cells=1).fit(rows)
    assert ((probabilities(fit, rows) > 0.5) == y).mean() > 0.97
    for (first, last), f in zip(forest.value_ranges(forest.dense(rows), 2, 16), range(2)):
        held = np.bincount(np.searchsorted(last, x[:, f]))
        assert len(last) == 16 and held.min() >= 120 and (first[1:] == last[:-1]).all()


@pytest.mark.parametrize("bootstrap,features,weak", [(True, None, False), (True, 1, True), (False, 5, True)])
def test_more_values_than_ranges_give_the_same_trees_in_both_phases(spark, monkeypatch, bootstrap, features, weak):
    """Every threshold of every feature drawn is tried, however large the table: values between borders, values
    that many rows hold, a feature that varies in few rows, a node inside one range."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=M), np.round(rng.exponential(size=M), 2) * (rng.random(M) < 0.5), rng.normal(size=M),
                         np.where(np.arange(M) < 2, np.arange(M) + 1.0, 0.0), rng.integers(0, 2, size=M)])
    y = (rng.random(M) < (0.4 if weak else 1 / (1 + np.exp(-4 * x[:, 0] - x[:, 1])))).astype(int)
    matrix = spark.createDataFrame([(k, int(b), Vectors.dense(a)) for k, (a, b) in enumerate(zip(x, y))], [ROW_ID, LABEL, "features"])
    weights = tuple(M / (2 * (y == c).sum()) for c in (0, 1))
    growth, want = trees.Growth(features or 2, weights, min_leaf=2, max_depth=4), np.zeros(M)
    for key in trees.tree_keys(42, range(6)):
        times = trees.bag_counts(key, np.arange(M)) if bootstrap else np.ones(M, int)
        own = times > 0
        tree = plain_tree(x[own], (times * (1 - y))[own], (times * y)[own], np.array([key]), growth)
        want += [tree(row) for row in x]
    monkeypatch.setattr(forest, "GROUP_ROWS", 300, raising=False)
    for cells, ranges, parts in ((forest.CELLS, 64, 3), (1, 4, 5), (1, 32, 2)):
        fit = forest.Forest(6, 4, 2, bootstrap=bootstrap, ranges=ranges, cells=cells, features=features)
        assert probabilities(fit.fit(matrix.repartition(parts)), matrix) == pytest.approx(want / 6, abs=1e-12)


def test_borders_are_ranked_in_ranges_of_bounded_size(spark, monkeypatch):
    """120,000 values are not numbered in one task, and no pass over the rows is needed beyond counting."""
    found, plain = [], rank.ranged
    monkeypatch.setattr(rank, "ranged", lambda *args: found.append(plain(*args)) or found[-1])
    rows = spark.range(120_000).select("id", F.lit(0).alias("y"), F.array(
        F.col("id") * 0.5, (F.col("id") % 3).cast("double"),
        F.when(F.col("id") < 3, float("inf")).otherwise(F.col("id") * 1.0)).alias("x"))
    (_, halves), (_, three), (_, late) = forest.value_ranges(rows, 3, 16)
    assert halves.tolist() == [(7500 * j - 1) * 0.5 for j in range(1, 17)] and three.tolist() == [0.0, 1.0, 2.0]
    assert late.tolist() == [7500 * j + 2 for j in range(1, 16)]  # the last rank lies among the infinite values
    sizes = [r["count"] for r in found[0].groupBy("bucket").count().collect()]
    assert sum(sizes) == 120_000 + 119_997 and max(sizes) <= 80_000


def plain_boosting(x, y, rounds, rules):
    p, raw = y.mean(), None
    raw = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(rounds):
        g, h = boosting.derivatives(raw, y.astype(float))

        def best(rows, depth):
            found = (0.0,)
            if rules.max_depth is not None and depth >= rules.max_depth or len(rows) < max(2 * rules.min_leaf, rules.min_split):
                return found
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f]):
                    sides = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                    (gl, hl), (gr, hr) = ((g[s].sum() / boosting.SCALE, h[s].sum() / boosting.SCALE) for s in sides)
                    n, m = map(len, sides)
                    if min(n, m) < rules.min_leaf or rules.criterion == "second" and min(hl, hr) < boosting.LEAST_SECOND:
                        continue
                    gain = (gl * gl / (hl + rules.l2) + gr * gr / (hr + rules.l2) - (gl + gr)**2 / (hl + hr + rules.l2)
                            if rules.criterion == "second" else n * m / (n + m) * (gl / n - gr / m)**2)
                    if gain > found[0]:
                        found = (gain, *sides)
            return found
        leaves = [(best(np.arange(len(y)), 0), np.arange(len(y)), 0)]
        while len(leaves) < rules.max_leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
            if leaves[k][0][0] <= 0:
                break
            (_, *sides), _, depth = leaves.pop(k)
            leaves += [(best(s, depth + 1), s, depth + 1) for s in sides]
        for _, rows, _ in leaves:
            raw[rows] += rules.value(g[rows].sum(), h[rows].sum())
    return 1 / (1 + np.exp(-raw))


@pytest.mark.parametrize("rules", [
    boosting.Rules(), boosting.Rules(max_leaves=8, max_depth=3, min_leaf=3, min_split=5, l2=0.0, criterion="friedman")])
def test_boosting_equals_plain_rounds_in_both_ways(data, matrix, rules):
    want = plain_boosting(*data, 12, rules)
    fits = [boosting.Boosting(12, rules, local_cells=cells).fit(matrix.repartition(parts))
            for cells, parts in ((boosting.LOCAL_CELLS, 3), (1, 2))]  # 12 rounds: raw scores are written anew once
    for fit in fits:
        assert probabilities(fit, matrix) == pytest.approx(want, abs=1e-12)
    assert fits[0].nodes.packed() == fits[1].nodes.packed()
    assert max(np.bincount(np.searchsorted(fits[0].nodes.roots, np.flatnonzero(fits[0].nodes.feature == -1), side="right"))) <= rules.max_leaves


def test_logistic_regression_equals_newton(spark, data, matrix):
    x, y = data
    w = np.where(y == 1, M / (2 * y.sum()), M / (2 * (M - y.sum())))
    design, beta = np.column_stack([np.ones(M), x]), np.zeros(7)
    penalty = np.diag([0.0] + [1.0] * 6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        step = design.T @ (w * (p - y)) + penalty @ beta
        beta -= np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + penalty, step)
    weights = F.when(F.col(LABEL) == 1, float(w[y == 1][0])).otherwise(float(w[y == 0][0]))
    fit = models.logistic_regression(M).setTol(1e-12).fit(matrix.withColumn("__weight", weights))
    assert [fit.intercept, *fit.coefficients] == pytest.approx(beta.tolist(), abs=1e-5)


def test_odd_matrices(spark, matrix):
    one = matrix.where(f"{LABEL} = 1")
    for fit in (forest.Forest(3), boosting.Boosting(3)):
        assert probabilities(fit.fit(one), one).min() > 0.999
        with pytest.raises(ValueError):
            fit.fit(one.where("false"))
    same = matrix.withColumn("features", F.lit(1)).withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    share = matrix.agg(F.avg(LABEL)).first()[0]
    assert probabilities(boosting.Boosting(3).fit(same), same)[0] == pytest.approx(share)
    assert probabilities(forest.Forest(3, bootstrap=False, cells=1).fit(same), same)[0] == pytest.approx(0.5)


def test_wide_rows_are_refused(spark):
    wide = spark.createDataFrame([(1, 0, Vectors.sparse(forest.MOST_FEATURES + 1, {0: 1.0}))], [ROW_ID, LABEL, "features"])
    for fit in (forest.Forest(3), boosting.Boosting(3)):
        with pytest.raises(forest.TooManyFeatures):
            fit.fit(wide)


def test_saved_trees_score_the_same(spark, matrix):
    for fit in (forest.Forest(3).fit(matrix), boosting.Boosting(3).fit(matrix)):
        path = new_path(spark, "trees")
        PipelineModel([fit]).write().overwrite().save(path)
        again = PipelineModel.load(path)
        assert (probabilities(fit, matrix) == probabilities(again, matrix)).all()


@pytest.mark.parametrize("cells", [forest.CELLS, 1])
def test_forests_beyond_the_nodes_held_whole_score_the_same(spark, data, matrix, monkeypatch, cells):
    """Many lower trees a tree where cells are few, upper levels that end in leaves, copies of rows, a saved model."""
    x, y = data
    more = matrix.unionByName(spark.createDataFrame(  # a far group of one class: a leaf of the upper levels
        [(M + k, 1, Vectors.dense([9.0 + k % 3, *x[k, 1:]])) for k in range(M)], matrix.schema)).repartition(3)
    fit = forest.Forest(6, cells=cells)
    whole = fit.fit(more)
    twice = more.unionByName(more)
    want = probabilities(whole, twice)
    monkeypatch.setattr(forest, "MOST_NODES", 10)
    parted = fit.fit(more)
    assert parted.below.count() >= 6 and len(parted.nodes.feature) < len(whole.nodes.feature)
    assert probabilities(parted, twice) == pytest.approx(want, abs=1e-12)
    path = new_path(spark, "trees")
    PipelineModel([parted]).write().save(path)
    assert probabilities(PipelineModel.load(path), twice).tolist() == probabilities(parted, twice.repartition(5)).tolist()
    assert parted.transform(more.where("false")).count() == 0


def test_packed_rows_are_whole():
    rng = np.random.default_rng(3)
    for x in (np.column_stack([rng.normal(size=13), rng.integers(0, 2, 13), np.full(13, -0.5)]), rng.normal(size=(9, 2)), np.ones((17, 1))):
        data = forest.packed_rows(x[2:], *forest.as_bits(x))
        assert (forest.unpacked_rows(data, len(x) - 2, x.shape[1]) == x[2:]).all()


def test_records_are_whole():
    rng = np.random.default_rng(4)
    for x in (np.column_stack([rng.normal(size=13), rng.integers(0, 2, (13, 9)), np.full(13, -0.5)]), rng.normal(size=(9, 2)), np.ones((17, 1))):
        records, facts = forest.as_records(x)
        assert (forest.from_records(records[3:].ravel(), facts, x.shape[1]).T == x[3:]).all()


def test_a_request_of_boosting_is_one_job(spark, matrix, monkeypatch):
    context, seen, plain = spark.sparkContext, [], boosting.SparkRows.sums

    def mark():
        """Number of a small job of its own; jobs are numbered in order."""
        context.setJobGroup("mark", "")
        spark.range(1).collect()
        context.setLocalProperty("spark.jobGroup.id", None)
        return max(context.statusTracker().getJobIdsForGroup("mark"))

    def counted(rows, tree, asked):
        first = mark()
        found = plain(rows, tree, asked)
        seen.append(mark() - first - 1)
        return found
    monkeypatch.setattr(boosting.SparkRows, "sums", counted)
    boosting.Boosting(2, boosting.Rules(), local_cells=1).fit(matrix)
    assert set(seen) == {1}


def test_only_drawn_features_are_tried(monkeypatch):
    """One feature of 20 that all part every node: one candidate a row and level at most."""
    rng = np.random.default_rng(2)
    x, y, tried, plain = rng.normal(size=(400, 20)), rng.integers(0, 2, size=400), [], trees.Growth.purity

    def purity(growth, left, node):
        tried.append(np.size(left[0]))
        return plain(growth, left, node)
    monkeypatch.setattr(trees.Growth, "purity", purity)
    found = trees.grown(x, 1 - y, y, trees.tree_keys(42, [0]), trees.Growth(1, (1.0, 1.0), max_depth=3))
    assert len(found.feature) > 3 and sum(tried) <= 3 * 400
