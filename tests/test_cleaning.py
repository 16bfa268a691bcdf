import pytest
from pyspark.sql import functions as F

from ebbtide.functions import columns as X
from ebbtide.functions import names
from ebbtide.operators import breakdown, clean, quality, risk, roles, stats
from workload.views import customer_360, dirty_customer, stored


def column(df, c):
    return [r[c] for r in df.collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_numbers_with_trailing_letters_are_not_numbers(spark):
    df = frame(spark, [("12d",), (" 7 ",), ("1e3",), (".5",), ("$1,200",), ("",), (None,), ("inf",)], "x string")
    assert column(df.select(X.number(df, "x").alias("n")), "n") == [None, 7.0, 1000.0, 0.5, None, None, None, None]
    assert column(df.select(X.number(df, "x", currency=True).alias("n")), "n")[4] == 1200.0


def test_nan_counts_as_missing(spark):
    df = frame(spark, [(float("nan"), 1), (2.0, None)], "x double, y int")
    assert quality.quality_check(df).first()["missing_cells"] == 2
    assert column(stats.missing_values(df).orderBy("column_name"), "missing_values") == [1, 1]


def test_cleaning_twice_changes_nothing(spark, sf):
    once, report, _ = clean.clean_dataset(dirty_customer(spark, sf))
    twice, again, _ = clean.clean_dataset(once)
    assert again.first()["missing_values_after"] == report.first()["missing_values_after"]
    assert once.distinct().exceptAll(twice).count() == 0 and twice.exceptAll(once.distinct()).count() == 0


def test_cleaning_profile_survives_json_and_new_batches(spark, sf):
    d = stored(dirty_customer, spark, sf)
    _, _, profile = clean.clean_dataset(d)
    again = clean.CleaningProfile.from_json(profile.to_json())
    assert again == profile
    part = clean.apply_cleaning(d.where("customer_id = 'C0000001'"), again)
    assert part.schema["tenure"].dataType.typeName() == "double"


def test_all_null_and_constant_columns(spark):
    df = frame(spark, [(1, None, "a"), (2, None, "a")], "k int, gone double, same string")
    cleaned, _, _ = clean.clean_dataset(df)
    assert cleaned.columns == ["k", "same"]
    assert clean.handle_missing_values(df).where("gone IS NOT NULL").isEmpty()


def test_text_left_out_of_modes_becomes_unknown(spark):
    df = frame(spark, [("N/A",), ("",)], "contract string")
    assert set(column(clean.handle_missing_values(clean.clean_text_columns(df)), "contract")) == {"Unknown"}


def test_strict_label_keeps_foreign_columns(spark):
    df = frame(spark, [("gold",), ("silver",), ("yes",)], "churn string")
    assert column(clean.clean_churn_target(df), "churn") == ["gold", "silver", "yes"]
    assert column(clean.clean_churn_target(df, strict=False), "churn") == [None, None, 1]


def test_retained_means_not_churned(spark):
    df = frame(spark, [(1,), (0,)], "retained int")
    assert column(clean.normalize_target(df, "retained"), "retained") == [0, 1]
    df = frame(spark, [("yes",), ("no",), ("churned",)], "retained string")
    assert column(clean.normalize_target(df, "retained"), "retained") == [0, 1, 1]


def test_unknown_labels_stay_unknown(spark):
    df = frame(spark, [("yes",), ("no",), ("maybe",)], "churn string")
    assert column(clean.normalize_target(df, "churn"), "churn") == [1, 0, None]


def test_repeated_column_names(spark):
    df = frame(spark, [(1, 2, 3)], "a int, b int, c int").toDF("x", "y", "x")
    assert clean.drop_repeated_columns(df).columns == ["x", "y"]
    assert clean.clean_column_names(df).columns == ["x", "y", "x.2"]


def test_short_names_are_not_taken_for_roles():
    assert names.match_column(["c", "id"], ["customer_id"]) is None
    assert names.match_column(["churn_probability", "x"], ["churn"]) is None
    assert names.find_column(["Customer ID", "customer-id"], ["customerID"]) == "customer-id"


def test_one_column_serves_one_signal():
    families = roles.signal_columns(["days_since_last_activity", "activity_score"])
    assert families["recency"] == ["days_since_last_activity"] and families["usage"] == ["activity_score"]


def test_inactive_is_not_active(spark):
    df = frame(spark, [("inactive",), ("active",), ("dissatisfied",), ("satisfied",), ("plain",), (None,)], "t string")
    assert column(df.select(risk.keyword_risk("t").alias("r")), "r") == [0.75, 0.25, 0.75, 0.25, 0.5, 0.5]


def test_collapsed_quartiles_give_one_band(spark):
    df = frame(spark, [(10.0, "Yes"), (10.0, "No"), (10.0, "No")], "MonthlyCharges double, Churn string")
    got = breakdown.charge_breakdown(df).collect()
    assert [(r["charge_band"], r["customers"], r["churned_customers"]) for r in got] == [("All Customers", 3, 1)]


def test_empty_table(spark, sf):
    d = stored(customer_360, spark, sf).limit(0)
    assert quality.quality_check(d).first()["valid"] is False
    assert quality.data_quality(d).first()["quality_score"] == 0.0
    assert breakdown.advanced_kpis(d).first()["total_customers"] == 0
    assert risk.customer_intelligence(d).count() == 0
    assert {r["customers"] for r in breakdown.charge_breakdown(d).collect()} == {0}


def test_bands_partition_the_table(spark, sf):
    d = stored(customer_360, spark, sf)
    known = d.where("tenure IS NOT NULL").count()
    assert sum(column(breakdown.tenure_breakdown(d), "customers")) == known
    assert sum(column(breakdown.charge_breakdown(d), "customers")) == d.where("monthly_charges IS NOT NULL").count()
    assert sum(column(breakdown.contract_breakdown(d), "customers")) == d.count()


def test_sketched_column_profile_is_close(spark, sf):
    d = stored(customer_360, spark, sf)
    exact = {r["column_name"]: r["unique_values"] for r in quality.column_profile(d).collect()}
    for r in quality.column_profile(d, exact=False).collect():
        assert abs(r["unique_values"] - exact[r["column_name"]]) <= max(2, 0.15 * exact[r["column_name"]])


def test_hashed_rows_give_the_same_facts(spark, sf):
    d = stored(dirty_customer, spark, sf)
    assert quality.data_quality(d).first() == quality.data_quality(d, exact=False).first()


def test_readiness_warnings(spark):
    df = frame(spark, [(None, None), (None, None), ("x", "y")], "a string, b string")
    row = quality.churn_readiness(df).first()
    assert not row["churn_ready"] and row["missing_required"] and len(row["warnings"]) == 4


@pytest.mark.parametrize("longest,first", [(10, "0-3"), (30, "0-6"), (80, "0-6")])
def test_tenure_bands_follow_the_longest_tenure(spark, longest, first):
    df = spark.range(longest + 1).select(F.col("id").alias("tenure"), F.lit("Yes").alias("churn"))
    got = stats.tenure_churn(df).collect()
    assert got[0]["tenure_group"] == first and sum(r["customers"] for r in got) == longest + 1
