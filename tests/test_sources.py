from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ebbtide.plans import scoring
from ebbtide.session import file_times, materialize, new_path
from ebbtide.sources import files, models, store
from ebbtide.streaming.scoring import score_stream, upsert_stream
from workload.views import customer_360, stored, unlabelled


def test_missing_and_foreign_files(spark):
    with pytest.raises(FileNotFoundError):
        files.read_dataset(spark, "/tmp/no-such-file.csv")
    with pytest.raises(ValueError):
        files.read_dataset(spark, "/tmp/book.xlsx")
    with pytest.raises(ValueError):
        files.read_dataset(spark, "/tmp/data.bin")
    assert files.first_dataset(spark, ["/tmp/no-such-file.csv"]) == (None, None)


def test_bom_and_latin1(spark, tmp_path):
    bom, latin = tmp_path / "bom.csv", tmp_path / "latin.csv"
    bom.write_bytes("﻿name,city\nÅsa,Århus\n".encode())
    latin.write_bytes("name,city\nÅsa,Århus\n".encode("latin-1"))
    for path in (bom, latin):
        df = files.read_dataset(spark, path)
        assert df.columns == ["name", "city"] and tuple(df.first()) == ("Åsa", "Århus")


def test_report_titles_and_nested_columns(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "risk_score int, warnings array<string>")
    path = files.write_csv(files.with_titles(df), new_path(spark, "titles"))
    back = files.read_dataset(spark, path)
    assert back.columns == ["Risk Score", "warnings"] and back.first()["warnings"] == '["a","b"]'


def batch(spark, rows):
    return spark.createDataFrame(rows, "seq long, customerID string, tenure string, Contract string")


@pytest.fixture
def customers(spark):
    return store.CustomerTable(spark, folder=new_path(spark, "customers")).create()


def test_upsert_rules(spark, customers):
    stored_rows = customers.save(batch(spark, [
        (0, " A ", "5", "One year"), (1, "B", "6", "Two year"), (2, None, "1", "x"), (3, "  ", "1", "x"),
        (4, "A", "7", None), (5, "C", "not a number", "x")]), order="seq")
    assert stored_rows == 3
    first = {r["customer_id"]: r for r in customers.read().collect()}
    assert set(first) == {"A", "B"} and first["A"]["tenure"] == 7 and first["A"]["contract"] is None
    customers.save(batch(spark, [(0, "B", None, "One year"), (1, "D", "1", "x")]), order="seq")
    second = {r["customer_id"]: r for r in customers.read().collect()}
    assert second["A"] == first["A"]
    assert second["B"]["id"] == first["B"]["id"] and second["B"]["created_at"] == first["B"]["created_at"]
    assert second["B"]["tenure"] is None and second["B"]["contract"] == "One year"
    assert second["D"]["id"] > max(r["id"] for r in first.values())
    assert [r["customer_id"] for r in customers.newest(1).collect()] == ["D"]


def test_insert_rejects_known_ids(spark, customers):
    assert customers.insert(batch(spark, [(0, "A", "1", "x"), (1, "A", "2", "y"), (2, None, "3", "z")]), "seq") == 2
    assert customers.insert(batch(spark, [(0, "A", "9", "x"), (1, "B", "2", "y")]), "seq") == 1
    assert {r["tenure"] for r in customers.read().collect()} == {1, 2, 3}
    customers.save(batch(spark, [(0, "B", "5", "y")]), "seq")
    kept = customers.read().where("customer_id IS NULL").collect()
    assert [r["tenure"] for r in kept] == [3] and customers.count() == 3
    customers.clear()
    assert customers.count() == 0 and len(customers.read().columns) == 27


def test_a_small_upsert_scans_touched_buckets_only(spark, customers):
    customers.save(batch(spark, [(k, f"C{k}", "1", "x") for k in range(200)]), "seq")
    before = customers._state()["parts"]
    latest = materialize(store.last_rows(store.batch_rows(batch(spark, [(0, "C7", "9", "x")]), "seq")))
    plan = store.updated(customers.read({3}), latest)._jdf.queryExecution().executedPlan().toString()
    table_side = plan[plan.index("Join"):].split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in table_side
    customers.save(batch(spark, [(0, "C7", "9", "x")]), "seq")
    after = customers._state()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    customers.insert(batch(spark, [(0, "New", "9", "x")]), "seq")
    assert sum(len(v) for v in customers._state()["parts"].values()) == len(after) + 1
    assert customers.count() == 201


def test_ids_are_dense_and_unique(spark, customers):
    customers.save(batch(spark, [(5, "A", "1", "x"), (5, "B", "1", "x"), (-3, "C", "1", "x")]), "seq")
    customers.save(batch(spark, [(5, "D", "1", "x"), (5, "A", "1", "x"), (5, "E", "2", "x")]), "seq")
    assert {r["customer_id"]: r["id"] for r in customers.read().collect()} == {"C": 1, "A": 2, "B": 3, "D": 4, "E": 5}


def test_numbers_that_do_not_fit_are_rejected(spark, customers):
    rows = spark.createDataFrame([("A", "99999999999999", 1.0), ("B", "5.5", 1e30), ("C", "7", 2.0), ("D", None, None)],
                                 "customerID string, TotalCharges string, MonthlyCharges double")
    assert customers.save(rows) == 2 and customers.rejected == 2
    assert sorted(r["customer_id"] for r in customers.read().collect()) == ["C", "D"]


def test_table_outlives_its_object_and_drops_old_versions(spark, customers):
    short = store.CustomerTable(spark, folder=customers.folder, retain=0)
    for k in range(4):
        short.save(batch(spark, [(0, "A", str(k), "x")]), "seq")
    again = store.CustomerTable(spark, folder=customers.folder).create()
    assert [r["tenure"] for r in again.read().collect()] == [3]
    pointer, folder = sorted(file_times(spark, customers.folder))
    assert pointer == "pointer-000000004.json" and folder.startswith("v4-")


def test_readers_keep_their_files(spark, customers):
    customers.save(batch(spark, [(0, "A", "1", "x")]), "seq")
    early = customers.read()
    for k in range(2, 5):
        customers.save(batch(spark, [(0, "A", str(k), "x")]), "seq")
    assert [r["tenure"] for r in early.collect()] == [1]


def test_a_writer_that_comes_second_starts_again(spark, customers):
    """Another table object commits between this one's read of the state and its commit."""
    other = store.CustomerTable(spark, folder=customers.folder)
    real, meant = customers._store, [
        lambda: other.save(batch(spark, [(0, "B", "2", "x"), (1, "A", "1", "x")]), "seq"),
        lambda: other.insert(batch(spark, [(0, "C", "3", "x")]), "seq")]

    def late(*args):
        if meant:
            meant.pop(0)()
        return real(*args)
    customers._store = late
    assert customers.save(batch(spark, [(0, "A", "9", "y"), (1, "D", "4", "y")]), "seq") == 2
    rows = {r["customer_id"]: (r["id"], r["tenure"]) for r in customers.read().collect()}
    assert rows == {"B": (1, 2), "A": (2, 9), "C": (3, 3), "D": (4, 4)}
    folders = {f for f in file_times(spark, customers.folder) if f.startswith("v")}
    state = customers._state()
    assert folders == store._folders(state["parts"]) | set(state["retired"])


def test_writers_side_by_side_lose_nothing(spark, customers):
    def write(k):
        store.CustomerTable(spark, folder=customers.folder).save(batch(spark, [(0, f"W{k}", str(k), "x")]), "seq")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    rows = customers.read().collect()
    assert sorted((r["customer_id"], r["tenure"]) for r in rows) == [(f"W{k}", k) for k in range(4)]
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4] and customers.count() == 4


def test_writers_give_up_after_their_attempts(spark, customers):
    customers._commit, customers.attempts = lambda *args: False, 2
    with pytest.raises(store.WriteConflict):
        customers.save(batch(spark, [(0, "A", "1", "x")]), "seq")


def test_newest_reads_only_parts_that_can_hold_them(spark, customers):
    customers.save(batch(spark, [(k, f"C{k}", "1", "x") for k in range(100)]), "seq")
    customers.insert(batch(spark, [(0, "N1", "1", "x"), (1, "N2", "1", "x")]), "seq")
    assert len(customers.newest(2).inputFiles()) <= 2 < len(customers.newest(3).inputFiles())
    assert [r["id"] for r in customers.newest(2).collect()] == [102, 101]
    assert [r["id"] for r in customers.newest(5).collect()] == [102, 101, 100, 99, 98]
    assert customers.newest(0).count() == 0 and customers.newest(500).count() == customers.count() == 102


def test_replacement_character_is_valid_utf8(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,t\n1,é\ufffd\n".encode())
    (tmp_path / "b.csv").write_bytes("id,t\n1,é\n".encode("latin-1"))
    assert files.read_dataset(spark, tmp_path / "a.csv").first()["t"] == "é\ufffd"
    assert files.read_dataset(spark, tmp_path / "b.csv").first()["t"] == "é"


def test_targets_are_labels(spark):
    from ebbtide.operators.roles import detect_target
    assert detect_target(["customer_id", "days_inactive", "login_count"]) is None
    assert detect_target(["customer_id", "left"]) == "left" and detect_target(["Inactive"]) == "Inactive"
    df = spark.createDataFrame([(1, 4, "a"), (2, 9, "b"), (3, 1, "a")], "id int, days_since_left_page int, customer_left_flag string")
    assert detect_target(df.columns) == "days_since_left_page"
    assert detect_target(df.columns, df) == "customer_left_flag"


def test_no_saved_model(spark):
    assert models.load_model(spark, new_path(spark, "no-model")) is None


def test_stream_scores_equal_batch_scores(spark, sf):
    d = stored(unlabelled, spark, sf)
    scorer = scoring.fit_scorer(d)
    path = new_path(spark, "arrivals")
    d.write.parquet(path)
    stream = spark.readStream.schema(d.schema).parquet(path)
    q = (score_stream(stream, scorer).writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", new_path(spark, "stream")).start())
    q.processAllAvailable()
    q.stop()
    want = scorer.apply(d).select("customer_id", "churn_probability")
    got = spark.table("scored_stream").select("customer_id", "churn_probability")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_stream_upserts(spark, sf, customers):
    d = stored(customer_360, spark, sf)
    path = new_path(spark, "arrivals")
    d.write.parquet(path)
    q = upsert_stream(spark.readStream.schema(d.schema).parquet(path), customers, new_path(spark, "stream"),
                      "customer_key")
    q.processAllAvailable()
    q.stop()
    assert customers.count() == d.count()


def test_scores_cover_every_row(spark, sf):
    d = stored(unlabelled, spark, sf)
    twice = d.unionByName(d)
    got = scoring.predict_customers(twice)
    assert got.count() == twice.count()
    bounds = got.agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 100


def test_one_customer_with_a_frozen_scorer(spark, sf):
    d = stored(unlabelled, spark, sf)
    scorer = scoring.fit_scorer(d)
    want = scorer.apply(d).where("customer_id = 'C0000007'").first()
    got = scorer.apply(spark.createDataFrame([d.where("customer_id = 'C0000007'").first()], d.schema)).first()
    assert got == want


def test_table_without_signals_is_ranked(spark, sf):
    d = stored(customer_360, spark, sf).select("customer_id", "total_charges", "senior_citizen")
    got = scoring.predict_customers(d, key="customer_id", clean=False)
    assert got.count() == d.count()
    assert got.agg(F.countDistinct("churn_probability")).first()[0] > 10


def test_generated_ids(spark, sf):
    d = stored(customer_360, spark, sf).select("tenure", "monthly_charges")
    got = scoring.with_customer_ids(d)
    assert got.select("generated_customer_id").distinct().count() == d.count()


def test_new_customers_are_numbered_in_short_ranges(spark):
    fresh = spark.range(0, 120_000, 1, 1).select(
        (F.col("id") * 7919 % 60_000).alias("first_seq"), F.format_string("C%06d", 120_000 - F.col("id")).alias("customer_id"))
    n, rows = store.numbered(fresh, 5)
    assert n == 120_000 and len(rows.inputFiles()) >= 3  # no task sorts all of them
    got = rows.orderBy("id").toPandas()
    assert got["id"].tolist() == list(range(6, n + 6))
    assert got.equals(got.sort_values(["first_seq", "customer_id"], ignore_index=True))
