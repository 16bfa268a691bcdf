"""Column roles, data quality and cleaning."""

from pyspark.sql import functions as F

from ebbtide.functions import columns as X
from ebbtide.operators import clean, quality, roles
from workload.registry import query
from workload.sql_parts import label, number, tokens
from workload.views import customer_360, dirty_customer, r2, stored, unlabelled, with_views

DIRTY = ["customer_id", "contract", "monthly_charges", "tenure", "churn", "empty_col"]
GAPS = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in DIRTY)
FACTS = f"""
facts AS (SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(sum({GAPS}) AS BIGINT) AS missing_cells,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS duplicate_rows,
  count(*) FILTER ({GAPS} = 6) AS empty_rows, count(*) FILTER ({GAPS} = 0) AS complete_rows FROM dirty_customer)"""
MISSING = r2("missing_cells / CAST(rows * columns AS DOUBLE) * 100")


@query("b1_exact_roles", with_views("""
SELECT count(*) AS rows, count(customer_id) AS customer_id_values, count(churn) AS churn_values,
       count(tenure) AS tenure_values, count(monthly_charges) AS monthly_charges_values,
       count(total_charges) AS total_charges_values, count(contract) AS contract_values,
       count(payment_method) AS payment_method_values FROM customer_360"""))
def b1_exact_roles(spark, sf):
    d = customer_360(spark, sf).toDF(*[
        "customer_key", "Customer-ID", "gender", "senior_citizen", "plan_segment", "internet_service",
        "Contract Type", "Payment.Method", "Tenure (Months)", "recency_months", "usage_events",
        "support_tickets", "TotalCharges", "Monthly Charges", "Is_Churn", "churn_probability"])
    return d.agg(F.count("*").alias("rows"), *[
        F.count(X.col(c)).alias(f"{r}_values") for r, c in roles.detect_columns(d.columns).items()])


@query("b2_contained_roles", with_views("""
SELECT customer_id, usage_events AS usage, support_tickets AS support, recency_months AS recency FROM customer_360"""))
def b2_contained_roles(spark, sf):
    d = customer_360(spark, sf)
    families = roles.signal_columns(d.columns)
    return d.select("customer_id", *[X.col(families[f][0]).alias(f) for f in ("usage", "support", "recency")])


@query("b3_role_profile", with_views("""
SELECT count(*) AS rows, CAST(16 AS BIGINT) AS columns, 'customer_id' AS customer_id_column, 'churn' AS churn_column,
  'tenure' AS tenure_column, 'contract' AS contract_column, 'payment_method' AS payment_column,
  'monthly_charges' AS monthly_value_column, 'total_charges' AS total_value_column, 'support_tickets' AS support_column,
  'usage_events' AS usage_column, CAST(NULL AS VARCHAR) AS engagement_column, CAST(NULL AS VARCHAR) AS discount_column,
  CAST(9 AS BIGINT) AS numeric_columns, CAST(7 AS BIGINT) AS categorical_columns, true AS actual_churn_available
FROM customer_360"""))
def b3_role_profile(spark, sf):
    return roles.profile_dataset(customer_360(spark, sf))


@query("b4_target_and_id", with_views("""
SELECT customer_id AS id_value, churn AS target_value, 'Adaptive ML Model' AS with_label,
       'Behavioral Risk Engine' AS without_label FROM customer_360"""))
def b4_target_and_id(spark, sf):
    d = customer_360(spark, sf)
    return d.select(X.col(roles.detect_customer_id(d.columns)).alias("id_value"),
                    X.col(roles.detect_target(d.columns)).alias("target_value"),
                    F.lit(roles.scoring_mode(d.columns)).alias("with_label"),
                    F.lit(roles.scoring_mode(unlabelled(spark, sf).columns)).alias("without_label"))


@query("b5_dataset_analysis", with_views(f"""
SELECT (SELECT count(*) FROM d) AS rows, CAST(6 AS BIGINT) AS columns, 'churn' AS target_column,
  'customer_id' AS customer_id_column, CAST(1 AS BIGINT) AS numeric_columns, CAST(5 AS BIGINT) AS categorical_columns,
  (SELECT CAST(sum({' + '.join(f'CAST(({tokens(c)}) IS NULL AS BIGINT)' for c in DIRTY if c != 'tenure')}
     + CAST(TRY_CAST(trim(tenure) AS DOUBLE) IS NULL AS BIGINT)) AS BIGINT) FROM d) AS missing_values,
  duplicate_rows, 'Adaptive ML Model' AS prediction_mode FROM facts""", dirty=True,
    extra=FACTS + ", d AS (SELECT DISTINCT * FROM dirty_customer)"))
def b5_dataset_analysis(spark, sf):
    return roles.analyze_dataset(stored(dirty_customer, spark, sf))


@query("b6_quality_check", with_views(
    f"SELECT rows > 0 AS valid, rows, columns, missing_cells, {MISSING} AS missing_percentage, duplicate_rows, empty_rows FROM facts",
    dirty=True, extra=FACTS))
def b6_quality_check(spark, sf):
    return quality.quality_check(dirty_customer(spark, sf))


@query("b7_churn_readiness", with_views(f"""
SELECT rows, missing_cells, duplicate_rows, true AS churn_ready, CAST(4 - 1 AS BIGINT) AS feature_count,
  concat_ws('; ', CASE WHEN missing_cells / CAST(rows * columns AS DOUBLE) * 100 > 30
       THEN 'The dataset contains more than 30% missing values.' END,
     CASE WHEN duplicate_rows > 0 THEN concat(duplicate_rows, ' duplicate rows detected.') END) AS warnings,
  'churn' AS churn_column FROM facts""", dirty=True, extra=FACTS))
def b7_churn_readiness(spark, sf):
    return quality.churn_readiness(dirty_customer(spark, sf)).select(
        "rows", "missing_cells", "duplicate_rows", "churn_ready", "feature_count",
        F.array_join("warnings", "; ").alias("warnings"),
        F.col("detected_columns")["churn"].alias("churn_column"))


@query("b8_dataset_summary", with_views("""
SELECT count(*) AS rows, CAST(16 AS BIGINT) AS columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer_360)) AS duplicate_rows,
  'customer_key,senior_citizen,tenure,recency_months,usage_events,support_tickets,total_charges,monthly_charges,churn_probability' AS numeric_columns,
  'customer_id,gender,plan_segment,internet_service,contract,payment_method,churn' AS categorical_columns,
  'contract' AS contract_column FROM customer_360"""))
def b8_dataset_summary(spark, sf):
    return quality.dataset_summary(customer_360(spark, sf)).select(
        "rows", "columns", "duplicate_rows", F.array_join("numeric_columns", ",").alias("numeric_columns"),
        F.array_join("categorical_columns", ",").alias("categorical_columns"),
        F.col("detected_columns")["contract"].alias("contract_column"))


def _profile_sql(cols, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS missing, "
        f"{r2(f'(count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100')} AS missing_percentage, "
        f"count(DISTINCT {c}) AS unique_values, {r2(f'count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) * 100')} AS unique_percentage "
        f"FROM {source}" for c, t in cols)


@query("b9_column_profile", with_views(_profile_sql([
    ("customer_key", "bigint"), ("customer_id", "string"), ("gender", "string"), ("senior_citizen", "int"),
    ("plan_segment", "string"), ("internet_service", "string"), ("contract", "string"), ("payment_method", "string"),
    ("tenure", "int"), ("recency_months", "int"), ("usage_events", "bigint"), ("support_tickets", "bigint"),
    ("total_charges", "double"), ("monthly_charges", "double"), ("churn", "string"), ("churn_probability", "double")],
    "customer_360")))
def b9_column_profile(spark, sf):
    return quality.column_profile(customer_360(spark, sf))


@query("b10_model_compatibility", with_views("""
SELECT count(*) AS rows, true AS full_table, false AS without_tenure, false AS no_features FROM customer_360"""))
def b10_model_compatibility(spark, sf):
    d, need = customer_360(spark, sf), ["tenure", "monthly_charges", "contract"]
    return d.agg(F.count("*").alias("rows"), F.lit(roles.has_features(d.columns, need)).alias("full_table"),
                 F.lit(roles.has_features(d.drop("tenure").columns, need)).alias("without_tenure"),
                 F.lit(roles.has_features(d.columns, [])).alias("no_features"))


@query("b11_data_quality_score", with_views(f"""
SELECT {r2('least(CAST(100 AS DOUBLE), greatest(CAST(0 AS DOUBLE), 100 - m * 2) * CAST(0.4 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 100 - d * 2) * CAST(0.2 AS DOUBLE) + c * CAST(0.4 AS DOUBLE))')} AS quality_score,
  missing_cells, duplicate_rows, rows, columns, {r2('m')} AS missing_percentage, {r2('d')} AS duplicate_percentage,
  complete_rows, {r2('c')} AS complete_row_percentage, CAST(0 AS BIGINT) AS numeric_columns, CAST(6 AS BIGINT) AS categorical_columns
FROM (SELECT *, missing_cells / CAST(rows * columns AS DOUBLE) * 100 AS m, duplicate_rows / CAST(rows AS DOUBLE) * 100 AS d,
        complete_rows / CAST(rows AS DOUBLE) * 100 AS c FROM facts)""", dirty=True, extra=FACTS))
def b11_data_quality_score(spark, sf):
    return quality.data_quality(dirty_customer(spark, sf))


# --- cleaning ---------------------------------------------------------------------------------------

@query("c1_clean_names", with_views("SELECT customer_id AS \"Customer ID\", contract AS \"Contract type\" FROM customer_360"))
def c1_clean_names(spark, sf):
    d = customer_360(spark, sf).select("customer_id", "contract").toDF("  Customer   ID ", "Contract \t type")
    return clean.clean_column_names(d)


@query("c2_remove_empty", with_views(
    "SELECT * EXCLUDE (empty_col) FROM dirty_customer WHERE coalesce(customer_id, contract, monthly_charges, tenure, churn) IS NOT NULL",
    dirty=True))
def c2_remove_empty(spark, sf):
    return clean.remove_empty_data(stored(dirty_customer, spark, sf))


@query("c3_remove_duplicates", with_views("SELECT DISTINCT * FROM dirty_customer", dirty=True))
def c3_remove_duplicates(spark, sf):
    return clean.remove_duplicates(dirty_customer(spark, sf))


@query("c4_clean_text", with_views(
    "SELECT " + ", ".join(f"{tokens(c)} AS {c}" for c in DIRTY) + " FROM dirty_customer", dirty=True))
def c4_clean_text(spark, sf):
    return clean.clean_text_columns(dirty_customer(spark, sf))


@query("c5_ratio_typing", with_views(f"""
SELECT customer_id, contract, {number('monthly_charges')} AS monthly_charges,
       CASE WHEN (SELECT count(TRY_CAST(trim(tenure) AS DOUBLE)) / CAST(count({tokens('tenure')}) AS DOUBLE) FROM dirty_customer) >= 0.9
            THEN CAST(TRY_CAST(trim(tenure) AS DOUBLE) AS VARCHAR) ELSE tenure END AS tenure_text, churn, empty_col
FROM dirty_customer""", dirty=True))
def c5_ratio_typing(spark, sf):
    return clean.convert_numeric_columns(stored(dirty_customer, spark, sf)).withColumn(
        "tenure_text", F.col("tenure").cast("string")).drop("tenure")


@query("c5_ratio_typing_scoring", with_views("""
SELECT customer_id, contract, monthly_charges, TRY_CAST(trim(tenure) AS DOUBLE) AS tenure, churn, empty_col
FROM dirty_customer""", dirty=True))
def c5_ratio_typing_scoring(spark, sf):
    return clean.convert_numeric_columns(stored(dirty_customer, spark, sf), clean.SCORING_RATIO,
                                         currency=False, of_all_rows=True)


@query("c6_common_columns", with_views(f"""
SELECT customer_id, contract, {number('monthly_charges')} AS monthly_charges, {number('tenure')} AS tenure, churn, empty_col
FROM dirty_customer""", dirty=True))
def c6_common_columns(spark, sf):
    return clean.clean_common_columns(dirty_customer(spark, sf))


MODES = {c: f"(SELECT {c} FROM {{src}} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
         for c in ("customer_id", "contract")}


@query("c7_fill_missing", with_views(f"""
SELECT coalesce(customer_id, {MODES['customer_id'].format(src='t')}) AS customer_id,
  coalesce(contract, {MODES['contract'].format(src='t')}) AS contract,
  coalesce(monthly_charges, (SELECT quantile_cont(monthly_charges, 0.5) FROM t)) AS monthly_charges,
  coalesce(tenure, (SELECT quantile_cont(tenure, 0.5) FROM t)) AS tenure, coalesce(empty_col, 'Unknown') AS empty_col
FROM t""", dirty=True, extra=f"""
t AS (SELECT {tokens('customer_id')} AS customer_id, {tokens('contract')} AS contract, {number('monthly_charges')} AS monthly_charges,
      {number('tenure')} AS tenure, empty_col FROM dirty_customer)"""))
def c7_fill_missing(spark, sf):
    d = stored(dirty_customer, spark, sf).drop("churn")
    return clean.handle_missing_values(clean.clean_common_columns(clean.clean_text_columns(d)))


@query("c8_churn_label", with_views(f"""
SELECT customer_id, contract, monthly_charges, tenure, {label('churn')} AS churn, empty_col FROM dirty_customer""", dirty=True))
def c8_churn_label(spark, sf):
    return clean.clean_churn_target(stored(dirty_customer, spark, sf))


@query("c9_target_from_data", with_views(f"""
SELECT customer_id, {label('churn')} AS by_word, senior_citizen AS by_number,
       CASE gender WHEN 'Female' THEN 0 WHEN 'Male' THEN 1 END AS by_text,
       1 - senior_citizen AS retained FROM customer_360"""))
def c9_target_from_data(spark, sf):
    d = stored(customer_360, spark, sf).select(
        "customer_id", "churn", F.col("gender").alias("left"),
        (F.col("senior_citizen") * 4 + 3).alias("attrition"), F.col("senior_citizen").alias("retained"))
    return d.select("customer_id", *[
        clean.apply_target(d, c, clean.fit_target(d, c)).alias(out)
        for c, out in (("churn", "by_word"), ("attrition", "by_number"), ("left", "by_text"), ("retained", "retained"))])


CLEANED = f"""
d AS (SELECT DISTINCT * EXCLUDE (empty_col) FROM dirty_customer),
t AS (SELECT {tokens('customer_id')} AS customer_id, {tokens('contract')} AS contract, {number('monthly_charges')} AS monthly_charges,
      {number('tenure')} AS tenure, {label('churn')} AS churn FROM d),
cleaned AS (SELECT coalesce(customer_id, {MODES['customer_id'].format(src='t')}) AS customer_id,
  coalesce(contract, {MODES['contract'].format(src='t')}) AS contract,
  coalesce(monthly_charges, (SELECT quantile_cont(monthly_charges, 0.5) FROM t)) AS monthly_charges,
  coalesce(tenure, (SELECT quantile_cont(tenure, 0.5) FROM t)) AS tenure,
  coalesce(churn, (SELECT CASE WHEN quantile_cont(churn, 0.5) IN (0, 1) THEN CAST(quantile_cont(churn, 0.5) AS INTEGER) END FROM t)) AS churn
  FROM t)"""


@query("c10_clean_dataset", with_views("SELECT * FROM cleaned", dirty=True, extra=CLEANED))
def c10_clean_dataset(spark, sf):
    return clean.clean_dataset(dirty_customer(spark, sf))[0]


@query("c10_cleaning_report", with_views(f"""
SELECT (SELECT count(*) FROM dirty_customer) AS original_rows, CAST(6 AS BIGINT) AS original_columns,
  (SELECT count(*) FROM cleaned) AS final_rows, CAST(5 AS BIGINT) AS final_columns,
  (SELECT count(*) FROM dirty_customer) - (SELECT count(*) FROM cleaned) AS duplicates_removed,
  (SELECT missing_cells FROM facts) AS missing_values_before,
  (SELECT CAST(sum(CAST(customer_id IS NULL AS BIGINT) + CAST(churn IS NULL AS BIGINT)) AS BIGINT) FROM cleaned) AS missing_values_after""",
    dirty=True, extra=CLEANED + "," + FACTS))
def c10_cleaning_report(spark, sf):
    return clean.clean_dataset(dirty_customer(spark, sf))[1]


@query("c11_light_clean", with_views(f"""
SELECT {tokens('customer_id')} AS customer_id, {tokens('contract')} AS contract, {number('monthly_charges')} AS monthly_charges,
       CASE WHEN (SELECT count(TRY_CAST(trim(tenure) AS DOUBLE)) / CAST(count({tokens('tenure')}) AS DOUBLE) FROM d) >= 0.9
            THEN CAST(CAST(TRY_CAST(trim(tenure) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE {tokens('tenure')} END AS tenure,
       {tokens('churn')} AS churn FROM d""", dirty=True,
    extra="d AS (SELECT DISTINCT * EXCLUDE (empty_col) FROM dirty_customer)"))
def c11_light_clean(spark, sf):
    out = clean.light_clean(stored(dirty_customer, spark, sf))
    # Tenure becomes a number only at scales where 90% of it can be read; compare it as text.
    return out.withColumn("tenure", F.regexp_replace(F.col("tenure").cast("string"), r"\.0$", ""))


@query("c12_scoring_clean", with_views(f"""
SELECT {tokens('customer_id')} AS customer_id, {tokens('contract')} AS contract, {tokens('monthly_charges')} AS monthly_charges,
       TRY_CAST(trim(tenure) AS DOUBLE) AS tenure, {tokens('churn')} AS churn, empty_col FROM dirty_customer""", dirty=True))
def c12_scoring_clean(spark, sf):
    return clean.scoring_clean(stored(dirty_customer, spark, sf))
