"""Customer tables derived from the test tables, in Spark and as SQL for the checks."""

from pyspark.sql import functions as F


from ebbtide.session import materialize

_STORED = {}


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(view, spark, sf):
    """The view as a table in the shared folder, written once per session: what operators that
    read a customer table several times would be given in practice."""
    key = (spark.sparkContext.applicationId, sf, view.__name__)
    if key not in _STORED:
        _STORED[key] = materialize(view(spark, sf), view.__name__)
    return _STORED[key]


def _month_number(date):
    return F.year(date) * 12 + F.month(date)


def _joined(spark, sf, with_orders=False):
    """customer + per-customer orders and events + nation and region. Orders and events are
    pre-aggregated by customer before any join; the two small tables are broadcast by size."""
    orders = table(spark, sf, "orders")
    has = [F.count_if(F.col("o_orderpriority").startswith(str(i))).alias(f"p{i}") for i in range(1, 6)]
    kinds = [F.count_if(F.col("o_orderstatus") == s).alias(f"s_{s.lower()}") for s in "FOP"]
    o = orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total_dec"),
        F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"),
        *(has + kinds if with_orders else []))
    e = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("usage_events"),
        F.count_if(F.col("event_type") == "error").alias("support_tickets"))
    latest = orders.agg(F.max(_month_number("o_orderdate"))).scalar()
    return (table(spark, sf, "customer")
            .join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(e, F.col("user_id") == F.col("c_custkey"), "left")
            .join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
            .join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
            .withColumn("tenure", _month_number("last_order") - _month_number("first_order"))
            .withColumn("recency_months", latest - _month_number("last_order")))


def _picked(key, names):
    expr = None
    for i, name in enumerate(names[:-1]):
        hit = F.pmod(key, F.lit(len(names))) == i
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise(names[-1])


def _customer_columns():
    k = F.col("c_custkey")
    cents = (F.col("total_dec") * 100).cast("double")
    # greatest() skips NULL, so a customer without orders divides NULL by 1.
    return [
        k.alias("customer_key"),
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 7, "0")).alias("customer_id"),
        _picked(k, ["Female", "Male"]).alias("gender"),
        F.when(F.pmod(k, F.lit(5)) == 0, 1).otherwise(0).alias("senior_citizen"),
        F.col("c_mktsegment").alias("plan_segment"), F.col("r_name").alias("internet_service"),
        _picked(k, ["Month-to-month", "One year", "Two year"]).alias("contract"),
        _picked(k, ["Electronic check", "Mailed check", "Bank transfer", "Credit card"]).alias("payment_method"),
        "tenure", "recency_months", "usage_events", "support_tickets",
        F.col("total_dec").cast("double").alias("total_charges"),
        (F.floor(cents / F.greatest(F.col("tenure"), F.lit(1))).cast("double") / 100.0).alias("monthly_charges"),
        F.when(F.col("recency_months") >= 6, "Yes").when(F.col("recency_months").isNotNull(), "No").alias("churn"),
        F.round(F.least(F.col("recency_months").cast("double") / 24.0, F.when(
            F.col("recency_months").isNotNull(), 1.0)), 4).alias("churn_probability")]


def customer_360(spark, sf):
    return _joined(spark, sf).select(*_customer_columns())


def customer_services(spark, sf):
    """customer_360 plus the service and household columns, read off the customer's orders."""
    def yes(cond):
        return F.when(cond, "Yes").otherwise("No")

    def has(c, n=0):
        return F.coalesce(F.col(c), F.lit(0)) > n
    return _joined(spark, sf, with_orders=True).select(
        *_customer_columns(),
        yes(has("p1")).alias("phone_service"), yes(has("p2", 1)).alias("multiple_lines"),
        yes(has("p3")).alias("online_security"), yes(has("p4", 1)).alias("online_backup"),
        yes(has("p5")).alias("device_protection"), yes(has("s_f", 2)).alias("tech_support"),
        yes(has("s_o", 2)).alias("streaming_tv"), yes(has("s_p", 2)).alias("streaming_movies"),
        yes(has("s_f", 3)).alias("partner"), yes(has("s_o", 3)).alias("dependents"),
        yes(has("s_p", 3)).alias("paperless_billing"))


def unlabelled(spark, sf):
    """customer_360 as a company without a churn label would have it."""
    return customer_360(spark, sf).drop("churn", "churn_probability", "customer_key")


def dirty_customer(spark, sf):
    """customer_360 with null tokens, spaces, currency signs, bad numbers, mixed labels, an
    empty column and two exact copies of some rows; one pass over customer_360."""
    c = customer_360(spark, sf)
    k = F.col("customer_key")

    def mod(n):
        return F.pmod(k, F.lit(n))
    money = F.col("monthly_charges").cast("decimal(18,2)").cast("string")
    plain = F.struct(
        F.col("customer_id"), F.col("contract"), money.alias("monthly_charges"),
        F.col("tenure").cast("string").alias("tenure"), F.col("churn"))
    soiled = F.struct(
        F.when(mod(50) != 0, F.col("customer_id")).alias("customer_id"),
        F.when(mod(6) == 0, F.concat(F.lit(" "), F.col("contract"), F.lit(" ")))
        .when(mod(6) == 5, "N/A").otherwise(F.col("contract")).alias("contract"),
        F.when(mod(7) == 0, "").when(mod(7) == 1, F.concat(F.lit("$"), money)).otherwise(money)
        .alias("monthly_charges"),
        F.when(mod(10) == 3, "unknown").otherwise(F.col("tenure").cast("string")).alias("tenure"),
        F.when(mod(4) == 0, F.upper("churn")).when(mod(4) == 1, F.concat(F.col("churn"), F.lit(" ")))
        .when(mod(4) == 2, F.when(F.col("churn") == "Yes", "Exited").otherwise("Retained"))
        .otherwise(F.col("churn")).alias("churn"))
    copies = F.when(mod(20) == 4, F.array(soiled, plain, plain)).otherwise(F.array(soiled))
    return c.select(F.inline(copies)).withColumn("empty_col", F.lit(None).cast("string"))


SQL_CUSTOMER = """
o AS (
  SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total_dec,
         min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
         count(*) FILTER (o_orderpriority LIKE '1%') AS p1, count(*) FILTER (o_orderpriority LIKE '2%') AS p2,
         count(*) FILTER (o_orderpriority LIKE '3%') AS p3, count(*) FILTER (o_orderpriority LIKE '4%') AS p4,
         count(*) FILTER (o_orderpriority LIKE '5%') AS p5, count(*) FILTER (o_orderstatus = 'F') AS s_f,
         count(*) FILTER (o_orderstatus = 'O') AS s_o, count(*) FILTER (o_orderstatus = 'P') AS s_p
  FROM orders GROUP BY o_custkey),
e AS (
  SELECT user_id, count(*) AS usage_events,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS support_tickets
  FROM events GROUP BY user_id),
mx AS (SELECT max(o_orderdate) AS ref_date FROM orders),
b AS (
  SELECT c.c_custkey, c.c_nationkey, c.c_mktsegment, o.* EXCLUDE (o_custkey),
         (year(o.last_order) - year(o.first_order)) * 12 + month(o.last_order) - month(o.first_order) AS tenure,
         (year(mx.ref_date) - year(o.last_order)) * 12 + month(mx.ref_date) - month(o.last_order) AS recency_months,
         e.usage_events, e.support_tickets
  FROM customer c LEFT JOIN o ON o.o_custkey = c.c_custkey
                  LEFT JOIN e ON e.user_id = c.c_custkey CROSS JOIN mx),
customer_360 AS (
SELECT b.c_custkey AS customer_key,
       concat('C', lpad(CAST(b.c_custkey AS VARCHAR), 7, '0')) AS customer_id,
       CASE WHEN b.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
       CASE WHEN b.c_custkey % 5 = 0 THEN 1 ELSE 0 END AS senior_citizen,
       b.c_mktsegment AS plan_segment, r.r_name AS internet_service,
       CASE b.c_custkey % 3 WHEN 0 THEN 'Month-to-month' WHEN 1 THEN 'One year' ELSE 'Two year' END AS contract,
       CASE b.c_custkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
            WHEN 2 THEN 'Bank transfer' ELSE 'Credit card' END AS payment_method,
       b.tenure, b.recency_months, b.usage_events, b.support_tickets,
       CAST(b.total_dec AS DOUBLE) AS total_charges,
       CAST(floor(CAST(b.total_dec * 100 AS DOUBLE) / greatest(b.tenure, 1)) AS DOUBLE) / CAST(100 AS DOUBLE) AS monthly_charges,
       CASE WHEN b.recency_months >= 6 THEN 'Yes' WHEN b.recency_months IS NOT NULL THEN 'No' END AS churn,
       CASE WHEN b.recency_months IS NOT NULL
            THEN round(least(CAST(b.recency_months AS DOUBLE) / CAST(24 AS DOUBLE), CAST(1 AS DOUBLE)), 4) END AS churn_probability
FROM b JOIN nation n ON n.n_nationkey = b.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
customer_services AS (
SELECT c.*,
       CASE WHEN coalesce(p1, 0) > 0 THEN 'Yes' ELSE 'No' END AS phone_service,
       CASE WHEN coalesce(p2, 0) > 1 THEN 'Yes' ELSE 'No' END AS multiple_lines,
       CASE WHEN coalesce(p3, 0) > 0 THEN 'Yes' ELSE 'No' END AS online_security,
       CASE WHEN coalesce(p4, 0) > 1 THEN 'Yes' ELSE 'No' END AS online_backup,
       CASE WHEN coalesce(p5, 0) > 0 THEN 'Yes' ELSE 'No' END AS device_protection,
       CASE WHEN coalesce(s_f, 0) > 2 THEN 'Yes' ELSE 'No' END AS tech_support,
       CASE WHEN coalesce(s_o, 0) > 2 THEN 'Yes' ELSE 'No' END AS streaming_tv,
       CASE WHEN coalesce(s_p, 0) > 2 THEN 'Yes' ELSE 'No' END AS streaming_movies,
       CASE WHEN coalesce(s_f, 0) > 3 THEN 'Yes' ELSE 'No' END AS partner,
       CASE WHEN coalesce(s_o, 0) > 3 THEN 'Yes' ELSE 'No' END AS dependents,
       CASE WHEN coalesce(s_p, 0) > 3 THEN 'Yes' ELSE 'No' END AS paperless_billing
FROM customer_360 c JOIN b ON b.c_custkey = c.customer_key)"""

SQL_DIRTY = """
money AS (SELECT *, CAST(CAST(monthly_charges AS DECIMAL(18,2)) AS VARCHAR) AS m FROM customer_360),
dirty_customer AS (
SELECT CASE WHEN customer_key % 50 = 0 THEN NULL ELSE customer_id END AS customer_id,
       CASE customer_key % 6 WHEN 0 THEN ' ' || contract || ' ' WHEN 5 THEN 'N/A' ELSE contract END AS contract,
       CASE customer_key % 7 WHEN 0 THEN '' WHEN 1 THEN '$' || m ELSE m END AS monthly_charges,
       CASE WHEN customer_key % 10 = 3 THEN 'unknown' ELSE CAST(tenure AS VARCHAR) END AS tenure,
       CASE customer_key % 4 WHEN 0 THEN upper(churn) WHEN 1 THEN churn || ' '
            WHEN 2 THEN CASE WHEN churn = 'Yes' THEN 'Exited' ELSE 'Retained' END ELSE churn END AS churn,
       CAST(NULL AS VARCHAR) AS empty_col
FROM money
UNION ALL
SELECT customer_id, contract, m, CAST(tenure AS VARCHAR), churn, CAST(NULL AS VARCHAR)
FROM (SELECT *, unnest([1, 2]) AS k FROM money WHERE customer_key % 20 = 4))"""


def with_views(body, dirty=False, extra=""):
    """SQL with the views as CTEs; `extra` holds further CTEs."""
    parts = [SQL_CUSTOMER] + ([SQL_DIRTY] if dirty else []) + ([extra] if extra else [])
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()


def r2(x, digits=2):
    """Half-up rounding of the shortest decimal text of a double, as Spark's round() does it."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"
