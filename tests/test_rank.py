"""Order statistics and ranks against brute force, with limits small enough that the paths for
large data are taken."""

import math

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import rank
from workload.views import customer_360, stored, table


@pytest.fixture(scope="module")
def prices(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """A third of the rows share one value, another part shares zero."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 1000.0)
                    .when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("x"))


def values(df):
    return sorted(r[0] for r in df.select("x").collect() if r[0] is not None)


def linear(xs, q):
    h = q * (len(xs) - 1)
    low, high = xs[math.floor(h)], xs[math.ceil(h)]
    return low + (high - low) * (h - math.floor(h))


@pytest.mark.parametrize("limit", [3, 40, 100_000])
@pytest.mark.parametrize("data", ["prices", "skewed"])
def test_quantiles_at_any_limit(request, data, limit):
    df = request.getfixturevalue(data)
    xs, probs = values(df), [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = rank.exact_quantiles(df, ["x"], probs, row_limit=limit)["x"]
    assert got == pytest.approx([linear(xs, q) for q in probs], rel=1e-12)


def test_order_statistics_of_long_hashes(spark, sf):
    df = table(spark, sf, "orders").select(F.xxhash64("o_orderkey").alias("x"))
    xs = values(df)
    ks = {1, 2, 77, len(xs) // 2, len(xs)}
    got = rank.order_statistics(df, {"x": ks}, row_limit=5)["x"]
    assert got == {k: xs[k - 1] for k in ks}


def test_values_far_apart(spark):
    """Most values share one range of the first passes; neighbouring integers are told apart."""
    big = 2 ** 62
    xs = sorted([-big, big] + [5 + i for i in range(300)] + [big - i for i in range(1, 200)])
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    ks = {1, 2, 150, 301, 302, 400, len(xs)}
    assert rank.order_statistics(df, {"x": ks}, row_limit=4)["x"] == {k: xs[k - 1] for k in ks}


def test_quantiles_of_empty_column(spark):
    df = spark.range(5).select(F.lit(None).cast("double").alias("x"))
    assert rank.exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def average_rank_percentiles(xs):
    out = {}
    for x in set(xs):
        less, ties = sum(v < x for v in xs), xs.count(x)
        out[x] = (less + (ties + 1) / 2) / len(xs)
    return out


@pytest.mark.parametrize("data", ["prices", "skewed"])
def test_percentile_cutoffs(request, data):
    df = request.getfixturevalue(data)
    pct = average_rank_percentiles(values(df))
    for limit in (3, 100_000):
        got = rank.percentile_cutoffs(df, "x", [10, 70, 75, 100], row_limit=limit)
        for p, cut in got.items():
            reach = [x for x, share in pct.items() if share * 100 >= p]
            assert cut == (min(reach) if reach else None)


@pytest.mark.parametrize("per_bucket", [50, 1_000_000])
@pytest.mark.parametrize("data", ["prices", "skewed"])
def test_percentile_ranks_with_ranges_and_hot_values(request, data, per_bucket):
    df = request.getfixturevalue(data)
    pct = average_rank_percentiles(values(df))
    got = rank.percentile_ranks(df, ["x"], "o_orderkey", per_bucket).collect()
    assert len(got) == df.count()
    assert all(abs(r["percentile"] - pct[r["value"]]) < 1e-12 for r in got)


def test_positions_over_ranges(spark, sf):
    df = table(spark, sf, "orders").select((F.col("o_orderkey") * 3).alias("k"))
    got = sorted((r["k"], r["position"]) for r in rank.positions(df, "k", rows_per_bucket=100).collect())
    assert [p for _, p in got] == list(range(1, len(got) + 1))


def test_dense_rank(spark, sf):
    df = stored(customer_360, spark, sf).select(F.round(F.col("churn_probability") * 100, 2).alias("s")).na.drop()
    order = sorted({r["s"] for r in df.collect()}, reverse=True)
    for r in rank.dense_rank_of_scores(df, "s", "k").collect():
        assert order[r["k"] - 1] == r["s"]


ODD = [float("inf"), float("-inf"), float("nan"), None]


@pytest.mark.parametrize("limit", [3, 10])
def test_infinite_and_extreme_values(spark, limit):
    """Infinities and NaN are missing; the width of the range may exceed the largest double."""
    xs = sorted([1e308, -1e308, 5e-324, 1e-300, 0.0] + [float(k) for k in range(60)])
    df = spark.createDataFrame([(x,) for x in xs + ODD * 3], "x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = rank.exact_quantiles(df, ["x"], probs, row_limit=limit)["x"]
    assert got == pytest.approx([linear(xs, q) for q in probs], rel=1e-12)
    ks = set(range(1, len(xs) + 1))
    assert rank.order_statistics(df, {"x": ks}, row_limit=limit)["x"] == {k: xs[k - 1] for k in ks}
    pct = average_rank_percentiles(xs)
    cut = rank.percentile_cutoffs(df, "x", [50], row_limit=limit)[50]
    assert cut == min(x for x, share in pct.items() if share >= 0.5)


def test_ranks_skip_missing_values(spark):
    rows = [(k, x) for k, x in enumerate([1.0, 2.0, 2.0, *ODD])]
    got = rank.percentile_ranks(spark.createDataFrame(rows, "k int, x double"), ["x"], "k", 1).collect()
    assert {r["k"]: r["percentile"] for r in got} == {0: pytest.approx(1 / 3), 1: pytest.approx(2.5 / 3), 2: pytest.approx(2.5 / 3)}


@pytest.mark.parametrize("rows", [[1, 2, 2], [1, None, 3]])
def test_positions_refuse_repeated_and_null_order(spark, rows):
    df = spark.createDataFrame([(x,) for x in rows], "x int")
    with pytest.raises(Exception, match="not unique"):
        rank.positions(df, "x").collect()


def test_auc_of_counts_beyond_bigint(spark):
    """The counts of the rank-sum formula are multiplied as doubles."""
    from ebbtide.operators import metrics
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.875
    plan = metrics.roc_auc(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "as double) * cast" in plan.replace("  ", " ")
