"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then timed; results are written to the no-op sink so that
all rows are produced without passing the driver. The multi-pass queries read the stored customer
table, whose one-time build from the raw tables is timed as `customer_table_build`.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ebbtide.session import local_session  # noqa: E402
from workload.registry import QUERIES  # noqa: E402
from workload import registered, views  # noqa: E402

HEADLINE = [
    "a1_csv_encodings", "a5_upsert", "b9_column_profile", "b11_data_quality_score", "c10_clean_dataset",
    "d2_search", "d6_explorer_summary", "d8_explorer_sort", "e3_numeric_summary", "e4_categorical_summary",
    "e5_churn_by_segment", "e7_tenure_churn", "e8_correlations", "e9_outliers", "e11_contract_breakdown",
    "e13_charge_breakdown", "e16_service_breakdown", "e17_churn_drivers", "e20_advanced_kpis",
    "e25_business_summary", "e29_executive_insights", "i3_behavioral_risk", "i5_universal_risk",
    "i8_customer_intelligence", "j1_action_plan", "k2_processed_dataset", "k3_stratified_split",
    "k5_logistic_regression", "k13_roc_auc", "r2_recommendations", "r4_retention_plan",
    "w1_priority_rank", "w2_value_percentile", "w3_mean_percentile", "e10_eda_bundle",
]
# Training takes minutes, and compiled code hardly matters to it: timed once, without a warm-up.
LONG = ["k7_random_forest", "k9_gradient_boosting", "k18_adaptive_model"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    registered.load()
    spark = local_session("bench", cpus=cpus, partitions=cpus)
    names = sys.argv[1:] or HEADLINE + LONG
    times = {}
    start = time.time()
    views.stored(views.customer_360, spark, sf)
    times["customer_table_build"] = round(time.time() - start, 3)
    for name in names:
        if name not in LONG:
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
