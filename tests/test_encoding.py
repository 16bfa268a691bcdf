import pytest
from pyspark.sql import functions as F

from ebbtide.operators import breakdown
from ebbtide.operators.encoding import Encoding, dictionary


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(4_000).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, F.concat(F.lit("v"), F.col("id") % 901))
        .otherwise("hot").alias("kind"),
        F.concat(F.lit("ü"), F.col("id") * 31 % 1_777).alias("o'dd name"),
        F.lit(None).cast("string").alias("empty"))
    return rows.cache()


COLUMNS = ["kind", "o'dd name", "empty"]


def expected(table):
    return {c: {v: i for i, v in enumerate(sorted({r[c] for r in table.collect()} - {None}, key=lambda v: v.encode()))}
            for c in COLUMNS}


@pytest.mark.parametrize("rows_per_range", [50, 100_000])
def test_ids_count_texts_in_order_whatever_the_ranges(table, rows_per_range):
    got = {}
    for r in dictionary(table.repartition(5), COLUMNS, rows_per_range).collect():
        got.setdefault(r["feature"], {})[r["value"]] = r["id"]
    assert got == {c: ids for c, ids in expected(table).items() if ids}


def test_codes_and_vectors_equal_a_plain_version(table):
    ids, encoding = expected(table), Encoding.fit(table, COLUMNS, 100)
    assert encoding.sizes == {c: len(v) for c, v in ids.items()}
    codes = {r["key"]: r for r in encoding.codes(table, "key").collect()}
    vectors = {r["key"]: r["features"] for r in encoding.vectors(table, "key").collect()}
    assert len(codes) == len(vectors) == 4_000
    for r in table.collect():
        want = [ids[c].get(r[c]) for c in COLUMNS]
        assert [codes[r["key"]][f"{c}_id"] for c in COLUMNS] == want
        shifts = [0, encoding.sizes["kind"], 0]
        assert list(vectors[r["key"]].indices) == [i + s for i, s in zip(want, shifts) if i is not None]
        assert vectors[r["key"]].size == encoding.width


def test_unseen_texts_are_zeros_and_repeated_keys_are_refused(spark, table):
    encoding = Encoding.fit(table, ["kind"])
    new = spark.createDataFrame([(1, "hot"), (2, "never seen"), (3, None)], "key long, kind string")
    got = {r["key"]: r["features"].numNonzeros() for r in encoding.vectors(new, "key").collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    with pytest.raises(Exception, match="the key repeats"):
        encoding.codes(new.union(new), "key").collect()
    assert encoding.codes(new.limit(0), "key").isEmpty()


def test_only_heavy_values_are_broadcast(spark, table):
    encoding = Encoding.fit(table, COLUMNS)
    assert [r["value"] for r in encoding.table.where(F.col("n") * 1_000 > 4_000).collect()] == ["hot"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = encoding.ids(table, "key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan
    assert 1 <= plan.count("BroadcastExchange") <= 2


def test_wide_forms_refuse_too_many_levels(table):
    assert len(breakdown.distinct_levels(table, ["kind"], most=10_000)["kind"]) > 10
    with pytest.raises(ValueError, match="more than 10 levels"):
        breakdown.distinct_levels(table, ["kind"], most=10)


def test_an_empty_table_has_no_levels(table):
    encoding = Encoding.fit(table.limit(0), COLUMNS)
    assert encoding.width == 0 and encoding.vectors(table.limit(2), "key").first()["features"].size == 0
