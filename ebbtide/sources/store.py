"""The customer table: fixed columns, unique customer id, insert and upsert.

Rows lie in folders by a hash bucket of their id. An upsert rewrites the buckets that its batch touches,
an insert only adds files. Finished files come into force by a small pointer file that names, for each
bucket, the folders that hold it with their number of rows and range of ids; so readers never see a
half-written table, nothing is overwritten while it is read, and the table outlives the session.

Writers need no lock. Each writes folders of its own name and then creates the pointer that follows the
one it started from. Creating it fails if another writer was first; the loser drops its folders and
starts again from the new state. Folders and pointers that are no longer in force stay for `retain`
seconds (a day), which must exceed the longest read and the longest write.
"""

import json
import time
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.columns import col, is_text, number
from ebbtide.functions.names import find_column
from ebbtide.session import create_file, drop_path, file_times, materialize, read_file, shared_folder

ROWS_PER_RANGE = 50_000
TEXT, MONEY, SCORE = T.StringType(), T.DecimalType(12, 2), T.DecimalType(8, 2)

# fixed values: table columns, their types and the input names they are filled from
COLUMNS = {
    "gender": (TEXT, ["gender"]),
    "senior_citizen": (T.IntegerType(), ["SeniorCitizen"]),
    "partner": (TEXT, ["Partner"]),
    "dependents": (TEXT, ["Dependents"]),
    "tenure": (T.IntegerType(), ["tenure"]),
    "phone_service": (TEXT, ["PhoneService"]),
    "multiple_lines": (TEXT, ["MultipleLines"]),
    "internet_service": (TEXT, ["InternetService"]),
    "online_security": (TEXT, ["OnlineSecurity"]),
    "online_backup": (TEXT, ["OnlineBackup"]),
    "device_protection": (TEXT, ["DeviceProtection"]),
    "tech_support": (TEXT, ["TechSupport"]),
    "streaming_tv": (TEXT, ["StreamingTV"]),
    "streaming_movies": (TEXT, ["StreamingMovies"]),
    "contract": (TEXT, ["Contract"]),
    "paperless_billing": (TEXT, ["PaperlessBilling"]),
    "payment_method": (TEXT, ["PaymentMethod"]),
    "monthly_charges": (MONEY, ["MonthlyCharges"]),
    "total_charges": (MONEY, ["TotalCharges"]),
    "churn": (TEXT, ["Churn"]),
    "churn_probability": (SCORE, ["Churn Probability"]),
    "prediction": (TEXT, ["Prediction", "Churn Prediction"]),
    "risk_level": (TEXT, ["Risk Level", "Customer Risk Segment"]),
    "risk_score": (SCORE, ["Customer Risk Score", "Risk Score"]),
}
SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("customer_id", TEXT)]
    + [T.StructField(c, t) for c, (t, _) in COLUMNS.items()]
    + [T.StructField("created_at", T.TimestampType())])


def batch_rows(df, order=None, skip_blank=True):
    """Input rows in table form with their ordinal `seq`, and `rejected` for rows with a number that
    is unreadable or does not fit its column. Rows without an id are left out if asked for. Copies
    of one order value are told apart by `tie`, a hash of the row."""
    key = find_column(df.columns, ["customer_id"])
    if key is None:
        raise ValueError(f"no customer id column among {df.columns}")
    found = {c: find_column(df.columns, names) for c, (_, names) in COLUMNS.items()}
    bad = F.lit(False)
    values = []
    for c, (t, _) in COLUMNS.items():
        name = found[c]
        if name is None:
            values.append(F.lit(None).cast(t).alias(c))
        elif t == TEXT:
            values.append(col(name).cast("string").alias(c))
        else:
            x = F.round(number(df, name), t.scale if isinstance(t, T.DecimalType) else 0).try_cast(t)
            values.append(x.alias(c))
            given = col(name) if is_text(df, name) else number(df, name)
            bad = bad | (given.isNotNull() & x.isNull())
    seq = col(order).cast("long") if order else F.monotonically_increasing_id()
    rows = df.withColumns({"__seq": seq, "__bad": bad, "__id": F.trim(col(key).cast("string"))})
    if skip_blank:
        rows = rows.where(F.col("__id") != "")
    rows = rows.select(F.col("__seq").alias("seq"), F.col("__bad").alias("rejected"),
                       F.col("__id").alias("customer_id"), *values)
    return rows.withColumn("tie", F.xxhash64(*COLUMNS))


def last_rows(rows):
    """(customer_id, new, first_seq): the last row of each id. A partial aggregate, so an id that
    fills the batch still combines map-side."""
    return rows.groupBy("customer_id").agg(
        F.max_by(F.struct(*COLUMNS), F.struct("seq", "tie")).alias("new"), F.min("seq").alias("first_seq"))


def first_rows(rows):
    return rows.groupBy("customer_id").agg(
        F.min_by(F.struct(*COLUMNS), F.struct("seq", "tie")).alias("new"), F.min("seq").alias("first_seq"))


def numbered(fresh, base, rows_per_range=ROWS_PER_RANGE):
    """(number of rows, fresh with id): base + 1, base + 2, ... in the order of first_seq and
    customer_id, counted inside sorted ranges and shifted by the sizes of the ranges before. Rows are
    wide, so a range is short and no task sorts more than that."""
    fresh = materialize(fresh, "fresh")
    n = fresh.count()
    order = ["first_seq", "customer_id"]
    if n <= rows_per_range:  # a single range needs neither cuts nor shifts
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
        return n, fresh.withColumn("id", F.lit(base) + place)
    ranges = fresh.repartitionByRange(-(-n // rows_per_range), *order).sortWithinPartitions(*order)
    # The lower 33 bits count the rows of a partition; written once, so later passes agree on them.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = materialize(ranges.select("*", F.spark_partition_id().alias("bucket"), within.alias("within")), "ranges")
    shift = (rows.groupBy("bucket").agg(F.count("*").alias("m"))
             .select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("shift")))
    return n, (rows.join(shift, "bucket").withColumn("id", F.lit(base) + F.col("shift") + F.col("within"))
               .drop("bucket", "shift", "within"))


def updated(current, latest):
    """Known customers with every column of their last input row, even its NULLs; id and created_at
    stay. The table side is a plain scan when the batch is small enough to be broadcast."""
    joined = current.join(latest, "customer_id", "left")
    return joined.select("id", "customer_id", *[
        F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(col(c)).alias(c) for c in COLUMNS], "created_at")


def in_table_form(fresh):
    return fresh.select("id", "customer_id", *[F.col("new")[c].alias(c) for c in COLUMNS],
                        F.current_timestamp().alias("created_at"))


class WriteConflict(RuntimeError):
    """Other writers were first in every attempt."""


class CustomerTable:
    """A named customer table in a folder that all executors reach."""

    def __init__(self, spark, name="customers", buckets=16, folder=None, retain=86_400, attempts=20):
        self.spark, self.buckets, self.retain, self.attempts = spark, buckets, retain, attempts
        self.folder = folder or f"{shared_folder(spark)}/{name}"
        self.rejected = 0

    def create(self):
        if not self._pointers():
            self._commit({}, 0, {"parts": {}, "version": -1, "retired": {}})
        return self

    def _pointers(self):
        return sorted(f for f in file_times(self.spark, self.folder) if f.endswith(".json"))

    def _state(self):
        return json.loads(read_file(self.spark, f"{self.folder}/{self._pointers()[-1]}"))

    def _states(self):
        """The state in force, again for each attempt to commit."""
        for attempt in range(self.attempts):
            yield self._state()
            time.sleep(0.05 * attempt)
        raise WriteConflict(f"{self.folder}: other writers were first in {self.attempts} attempts")

    def _commit(self, parts, last_id, before):
        """Let the parts follow the state `before`; False if another state follows it already."""
        now, version = time.time(), before["version"] + 1
        held = _folders(parts)
        retired = {**before["retired"], **dict.fromkeys(_folders(before["parts"]) - held, now)}
        due = {f for f, since in retired.items() if now - since >= self.retain}
        state = {"parts": parts, "last_id": last_id, "version": version,
                 "retired": {f: since for f, since in retired.items() if f not in due}}
        if not create_file(self.spark, f"{self.folder}/pointer-{version:09d}.json", json.dumps(state).encode()):
            return False
        self._clean(due, held | set(state["retired"]))
        return True

    def _clean(self, due, named):
        """Drop what is out of force for `retain` seconds, and what failed writers left."""
        now, times = time.time(), file_times(self.spark, self.folder)
        pointers = sorted(f for f in times if f.endswith(".json"))
        due = due | {old for old, new in zip(pointers, pointers[1:]) if now - times[new] >= self.retain}
        due |= {f for f, since in times.items()
                if f not in pointers and f not in named and now - since >= self.retain}
        for name in due & set(times):
            drop_path(self.spark, f"{self.folder}/{name}")

    def _bucket(self):
        """Bucket of a row; rows without an id are spread by their number."""
        return F.pmod(F.coalesce(F.xxhash64(F.nullif("customer_id", F.lit(""))), F.lit(0))
                      + F.when(F.col("customer_id").isNull(), F.col("id")).otherwise(0), F.lit(self.buckets)).cast("int")

    def _rows(self, state, wanted):
        """Rows of the parts for which wanted(bucket, rows, smallest id, largest id) holds."""
        paths = [f"{self.folder}/{f}/bucket={b}" for b, held in state["parts"].items()
                 for f, *facts in held if wanted(int(b), *facts)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def read(self, only=None):
        """The table, or the given buckets of it."""
        return self._read(self._state(), only)

    def _read(self, state, only=None):
        return self._rows(state, lambda bucket, *_: only is None or bucket in only)

    def _store(self, rows, state, replaced, added):
        """Write rows as a new folder and commit it; the replaced buckets are held by it alone. False,
        and nothing is left, if another writer was first."""
        folder = f"v{state['version'] + 1}-{uuid.uuid4().hex[:12]}"
        path = f"{self.folder}/{folder}"
        rows.select(*SCHEMA.fieldNames()).withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(path)
        facts = (self.spark.read.schema("id long, bucket int").parquet(path).groupBy("bucket")
                 .agg(F.count("*"), F.min("id"), F.max("id")).collect())  # one row per bucket
        parts = {b: held for b, held in state["parts"].items() if int(b) not in replaced}
        for bucket, *fact in facts:
            parts[str(bucket)] = [*parts.get(str(bucket), []), [folder, *fact]]
        if self._commit(parts, state["last_id"] + added, state):
            return True
        drop_path(self.spark, path)
        return False

    def _batch(self, df, order, skip_blank=True):
        """Accepted rows, written once; how many there are."""
        rows = materialize(batch_rows(df, order, skip_blank), "batch")
        self.rejected, accepted = rows.agg(F.count_if("rejected"), F.count_if(~F.col("rejected"))).first()
        return rows.where(~F.col("rejected")), accepted

    def _touched(self, rows):
        ids = rows.where("customer_id IS NOT NULL").select("customer_id", F.lit(0).alias("id"))
        return {r[0] for r in ids.select(self._bucket()).distinct().collect()}  # at most one row per bucket

    def save(self, df, order=None):
        """Upsert a table of customers; returns how many input rows were stored. The number of
        rejected rows is left in `rejected`."""
        rows, accepted = self._batch(df, order)
        latest = materialize(last_rows(rows), "latest")
        touched = self._touched(latest)
        for state in self._states():
            current = self._read(state, touched)
            fresh = latest.join(current.select("customer_id"), "customer_id", "left_anti")
            added, fresh = numbered(fresh, state["last_id"])
            if self._store(updated(current, latest).unionByName(in_table_form(fresh)), state, touched, added):
                return accepted

    def insert(self, df, order=None):
        """Add new customers; returns how many were added. Of several rows with one id the first is
        taken; rows without an id never clash. Only new files are written."""
        rows, _ = self._batch(df, order, skip_blank=False)
        named = materialize(first_rows(rows.where("customer_id IS NOT NULL")), "first")
        touched = self._touched(named)
        anonymous = rows.where("customer_id IS NULL").select(
            "customer_id", F.struct(*COLUMNS).alias("new"), F.col("seq").alias("first_seq"))
        for state in self._states():
            fresh = named.join(self._read(state, touched).select("customer_id"), "customer_id", "left_anti")
            added, fresh = numbered(fresh.unionByName(anonymous), state["last_id"])
            if not added or self._store(in_table_form(fresh), state, (), added):
                return added

    def newest(self, limit=1000):
        """The customers of the largest ids. Only parts that can hold one of them are read: going down by
        smallest id, parts are taken until they hold enough rows; no smaller id is needed."""
        state, have, floor = self._state(), 0, 0
        for _, n, low, _ in sorted((f for held in state["parts"].values() for f in held), key=lambda f: -f[2]):
            have, floor = have + n, low
            if have >= int(limit):
                break
        rows = self._rows(state, lambda bucket, n, low, high: high >= floor)
        return rows.where(F.col("id") >= floor).orderBy(F.desc("id")).limit(int(limit))

    def count(self):
        """Number of customers, from the pointer alone."""
        return sum(n for held in self._state()["parts"].values() for _, n, *_ in held)

    def clear(self):
        for state in self._states():
            if self._commit({}, state["last_id"], state):
                return


def _folders(parts):
    return {f for held in parts.values() for f, *_ in held}
