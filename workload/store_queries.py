"""Sources, sinks and the customer table."""

from pyspark.sql import functions as F

from ebbtide.session import new_path
from ebbtide.sources import files, models, store
from workload.registry import query
from workload.risk_queries import intel
from workload.sql_parts import INTEL
from workload.views import customer_360, stored, table, with_views


def _csv(df, spark, name, encoding="UTF-8"):
    path = new_path(spark, name)
    df.write.csv(path, header=True, encoding=encoding)
    return path


@query("a1_csv_encodings", with_views("""
SELECT 'utf8' AS file, customer_id, concat(contract, ' é') AS contract, CAST(monthly_charges AS DOUBLE) AS monthly_charges FROM customer_360
UNION ALL SELECT 'latin1', customer_id, concat(contract, ' é'), CAST(monthly_charges AS DOUBLE) FROM customer_360"""))
def a1_csv_encodings(spark, sf):
    d = stored(customer_360, spark, sf).select(
        "customer_id", F.concat("contract", F.lit(" é")).alias("contract"), "monthly_charges")
    parts = [files.read_dataset(spark, _csv(d, spark, name, enc)).withColumn("file", F.lit(name))
             for name, enc in (("utf8", "UTF-8"), ("latin1", "ISO-8859-1"))]
    return parts[0].unionByName(parts[1]).withColumn("monthly_charges", F.col("monthly_charges").cast("double"))


@query("a2_first_dataset", with_views("SELECT customer_id, contract FROM customer_360"))
def a2_first_dataset(spark, sf):
    d = stored(customer_360, spark, sf).select("customer_id", "contract")
    empty = _csv(d.where(F.lit(False)), spark, "empty")
    return files.first_dataset(spark, [new_path(spark, "missing"), empty, _csv(d, spark, "customers")])[0]


@query("a4_customer_table", with_views("""
SELECT row_number() OVER (ORDER BY customer_key) AS id, customer_id, gender, senior_citizen, internet_service, contract, payment_method,
  CAST(tenure AS INTEGER) AS tenure, CAST(monthly_charges AS DOUBLE) AS monthly_charges, CAST(total_charges AS DOUBLE) AS total_charges,
  churn, true AS created, CAST(27 AS BIGINT) AS columns FROM customer_360"""))
def a4_customer_table(spark, sf):
    t = _loaded(spark, sf).read()
    return t.select("id", "customer_id", "gender", "senior_citizen", "internet_service", "contract", "payment_method", "tenure",
                    *[F.col(c).cast("double").alias(c) for c in ("monthly_charges", "total_charges")], "churn",
                    F.col("created_at").isNotNull().alias("created"), F.lit(len(t.columns)).cast("long").alias("columns"))


def _loaded(spark, sf):
    """A new customer table, filled from the customer view in key order."""
    t = store.CustomerTable(spark, folder=new_path(spark, "customers")).create()
    t.save(stored(customer_360, spark, sf), order="customer_key")
    return t


def _updates(spark, sf):
    """Every order is one update of a customer; half of the ids are unknown to the table."""
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit(" C"), F.lpad((F.col("o_custkey") * 2).cast("string"), 7, "0")).alias("customerID"),
                    F.col("o_totalprice").alias("MonthlyCharges"), F.col("o_orderpriority").alias("Contract"),
                    F.col("o_orderstatus").alias("Churn Prediction"), F.col("o_orderkey").alias("seq"))


UPDATES = """
u AS (SELECT concat('C', lpad(CAST(o_custkey * 2 AS VARCHAR), 7, '0')) AS customer_id, o_orderkey AS seq,
        CAST(round(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,4)), 2) AS DOUBLE) AS monthly_charges,
        o_orderpriority AS contract, o_orderstatus AS prediction FROM orders),
l AS (SELECT customer_id, arg_max(monthly_charges, seq) AS monthly_charges, arg_max(contract, seq) AS contract,
        arg_max(prediction, seq) AS prediction, min(seq) AS first_seq FROM u GROUP BY customer_id),
c AS (SELECT row_number() OVER (ORDER BY customer_key) AS id, customer_id, contract, monthly_charges, tenure FROM customer_360),
mxid AS (SELECT max(id) AS base FROM c),
fresh AS (SELECT customer_id, row_number() OVER (ORDER BY first_seq, customer_id) AS place FROM l
   WHERE customer_id NOT IN (SELECT customer_id FROM c)),
merged AS (SELECT coalesce(c.id, base + place) AS id, coalesce(c.customer_id, l.customer_id) AS customer_id,
   CASE WHEN l.customer_id IS NOT NULL THEN l.contract ELSE c.contract END AS contract,
   CASE WHEN l.customer_id IS NOT NULL THEN l.monthly_charges ELSE c.monthly_charges END AS monthly_charges,
   CASE WHEN l.customer_id IS NULL THEN c.tenure END AS tenure, l.prediction
   FROM c FULL JOIN l ON l.customer_id = c.customer_id LEFT JOIN fresh ON fresh.customer_id = l.customer_id CROSS JOIN mxid)"""


def _shown(t):
    return t.read().select("id", "customer_id", "contract", F.col("monthly_charges").cast("double").alias("monthly_charges"),
                           "tenure", "prediction")


@query("a5_upsert", with_views("SELECT * FROM merged", extra=UPDATES))
def a5_upsert(spark, sf):
    t = _loaded(spark, sf)
    t.save(_updates(spark, sf), order="seq")
    return _shown(t)


@query("a6_insert_only", with_views("""
SELECT id, customer_id, contract, monthly_charges, tenure, CAST(NULL AS VARCHAR) AS prediction FROM c
UNION ALL SELECT base + place, f.customer_id, f.contract, f.monthly_charges, NULL, f.prediction
FROM (SELECT customer_id, arg_min(monthly_charges, seq) AS monthly_charges, arg_min(contract, seq) AS contract,
      arg_min(prediction, seq) AS prediction, min(seq) AS first_seq FROM u GROUP BY customer_id) f
JOIN fresh ON fresh.customer_id = f.customer_id CROSS JOIN mxid""", extra=UPDATES))
def a6_insert_only(spark, sf):
    t = _loaded(spark, sf)
    t.insert(_updates(spark, sf), order="seq")
    return _shown(t)


@query("a7_newest_customers", with_views(
    "SELECT row_number() OVER (ORDER BY customer_key) AS id, customer_id, contract FROM customer_360 ORDER BY id DESC LIMIT 1000"))
def a7_newest_customers(spark, sf):
    return _loaded(spark, sf).newest(1000).select("id", "customer_id", "contract")


@query("a8_customer_count", with_views("SELECT count(*) AS customers FROM customer_360"))
def a8_customer_count(spark, sf):
    return _loaded(spark, sf).read().agg(F.count("*").alias("customers"))


TIES = """
t AS (SELECT concat('C', lpad(CAST(o_custkey * 2 AS VARCHAR), 7, '0')) AS customer_id, CAST(o_orderkey % 7 AS BIGINT) AS seq,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(round(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(18,4)), 2) AS DOUBLE) END AS monthly_charges
      FROM orders WHERE o_orderkey % 5 <> 0),
g AS (SELECT customer_id, min(seq) AS first_seq FROM t GROUP BY customer_id),
c AS (SELECT row_number() OVER (ORDER BY customer_key) AS id, customer_id FROM customer_360),
n AS (SELECT customer_id, (SELECT max(id) FROM c) + row_number() OVER (ORDER BY first_seq, customer_id) AS id FROM g
      WHERE customer_id NOT IN (SELECT customer_id FROM c))"""


@query("a5_upsert_ties", with_views("""
SELECT coalesce(c.id, n.id) AS id, coalesce(c.customer_id, n.customer_id) AS customer_id, true AS from_last_rows,
       (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS rejected FROM c FULL JOIN n ON n.customer_id = c.customer_id""", extra=TIES))
def a5_upsert_ties(spark, sf):
    """Many updates share one order value, and every fifth amount does not fit its column. Any of the
    last rows of a customer may be the one that is stored, but no other."""
    o = table(spark, sf, "orders")
    amount = F.when(F.col("o_orderkey") % 5 == 0, "99999999999999").when(
        F.col("o_orderkey") % 11 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    rows = o.select(F.concat(F.lit("C"), F.lpad((F.col("o_custkey") * 2).cast("string"), 7, "0")).alias("customerID"),
                    amount.alias("MonthlyCharges"), (F.col("o_orderkey") % 7).alias("seq"))
    t = _loaded(spark, sf)
    t.save(rows, order="seq")
    rejected = t.rejected
    last = (rows.where("MonthlyCharges IS NULL OR MonthlyCharges <> '99999999999999'").groupBy(F.col("customerID").alias("customer_id"))
            .agg(F.max("seq").alias("top"), F.collect_set(F.struct("seq", F.col("MonthlyCharges").try_cast("double").alias("x"))).alias("rows")))
    mine = t.read().join(last, "customer_id", "left")
    fits = F.exists("rows", lambda r: (r["seq"] == F.col("top")) & r["x"].eqNullSafe(F.col("monthly_charges").cast("double")))
    return mine.select("id", "customer_id", F.coalesce(fits, F.lit(True)).alias("from_last_rows"), F.lit(rejected).cast("long").alias("rejected"))


@query("a9_clear_customers", with_views("""
SELECT count(*) AS customers_before, count(*) FILTER (false) AS customers_left, CAST(27 AS BIGINT) AS columns FROM customer_360"""))
def a9_clear_customers(spark, sf):
    t = _loaded(spark, sf)
    before = t.read().agg(F.count("*").alias("customers_before"))
    rows = before.first()["customers_before"]
    t.clear()
    left = t.read()
    return left.agg(F.lit(rows).cast("long").alias("customers_before"), F.count("*").alias("customers_left"),
                    F.lit(len(left.columns)).cast("long").alias("columns"))


@query("a10_csv_report", with_views("""
SELECT customer_id, customer_risk_score AS "Customer Risk Score", risk_level AS "Risk Level",
       strategic_segment AS "Strategic Segment", revenue_at_risk AS "Revenue At Risk" FROM intel""", extra=INTEL))
def a10_csv_report(spark, sf):
    report = files.with_titles(intel(spark, sf).select(
        "customer_id", "customer_risk_score", "risk_level", "strategic_segment", "revenue_at_risk"))
    path = files.write_csv(report, new_path(spark, "report"))
    back = files.read_dataset(spark, path)
    return back.withColumns({c: F.col(f"`{c}`").cast("double") for c in ("Customer Risk Score", "Revenue At Risk")})


@query("a11_model_round_trip", with_views("SELECT customer_id, true AS same_probability FROM customer_360"))
def a11_model_round_trip(spark, sf):
    """A saved and reloaded model gives every customer the probability of the original."""
    from workload.ml_queries import training_customers
    from ebbtide.operators.models import decision_tree
    from ebbtide.plans.training import run_training
    d = training_customers(spark, sf)
    model, _ = run_training(d, "customer_id", {"Decision Tree": decision_tree}, cross_validation=False)
    again = models.load_model(spark, models.save_model(model, new_path(spark, "model")))
    a = model.predict(d).select("customer_id", F.col("__probability").alias("original"))
    b = again.predict(d).select("customer_id", F.col("__probability").alias("reloaded"))
    return a.join(b, "customer_id").select(
        "customer_id", F.col("original").eqNullSafe(F.col("reloaded")).alias("same_probability"))
