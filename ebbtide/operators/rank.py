"""Exact order statistics and ranks that never bring a whole column into one task.

A wanted rank is searched by counting: values are counted in up to 4,096 ranges between the
smallest and the largest, the range that holds the rank is the next search interval, and the
scan repeats inside it until few rows are left. The counts combine map-side, so every pass
shuffles only a few thousand numbers whatever the size of the table.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbtide.functions.columns import col, value
from ebbtide.session import materialize

ROW_LIMIT = 10_000
BINS = 4_096
ROWS_PER_BUCKET = 1_000_000
HEAVY_SHARE = 1_000
AGGREGATES_PER_JOB = 90


def _chunks(items, size=AGGREGATES_PER_JOB):
    items = list(items)
    return [items[i:i + size] for i in range(0, len(items), size)]


def agg_values(df, exprs):
    """Run named one-row aggregates, in several jobs when there are very many."""
    out = {}
    for part in _chunks(exprs.items()):
        out.update(df.agg(*[e.alias(k) for k, e in part]).first().asDict())
    return out


def extents(df, columns):
    """{column: (count, smallest, largest)} of the finite values in one pass."""
    got = agg_values(df, {f"{kind}{i}": f(value(df, c)) for i, c in enumerate(columns)
                          for kind, f in (("n", F.count), ("a", F.min), ("z", F.max))})
    return {c: (got[f"n{i}"], got[f"a{i}"], got[f"z{i}"]) for i, c in enumerate(columns)}


def exact_quantiles(df, columns, probs, row_limit=ROW_LIMIT):
    """{column: [value per prob]} by linear interpolation; None where a column is empty."""
    columns = list(columns)
    if not columns:
        return {}
    rows = df.select(*[col(c).cast("double").alias(c) for c in columns])
    extent = extents(rows, columns)
    places = {c: [q * (extent[c][0] - 1) for q in probs] for c in columns if extent[c][0]}
    ranks = {c: {math.floor(h) + 1 for h in hs} | {math.ceil(h) + 1 for h in hs}
             for c, hs in places.items()}
    found = order_statistics(rows, ranks, extent, row_limit)
    out = {c: [None] * len(probs) for c in columns}
    for c, hs in places.items():
        pairs = [(found[c][math.floor(h) + 1], found[c][math.ceil(h) + 1], h - math.floor(h)) for h in hs]
        out[c] = [low + (high - low) * part for low, high, part in pairs]
    return out


def _inside(c, low, high):
    return (col(c) >= F.lit(low)) & (col(c) <= F.lit(high))


def _hits(df, searches, *extra):
    """One row (s, x, ...) per search interval that a row's value lies in."""
    cells = [F.when(_inside(c, low, high), F.struct(
        F.lit(i).alias("s"), col(c).alias("x"), *[e(c, low, high) for e in extra]))
        for i, (c, low, high) in enumerate(searches)]
    return df.select(F.inline(F.array_compact(F.array(*cells))))


def _half_width(low, high):
    """Half the width, because the width itself can exceed the range of doubles."""
    return float(high) / 2 - float(low) / 2


def _bin(c, low, high):
    """Range number; it never falls as the value grows, which is all the search needs."""
    share = (col(c).cast("double") / 2 - F.lit(float(low) / 2)) / F.lit(_half_width(low, high))
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int").alias("bin")


def order_statistics(df, ranks, extent=None, row_limit=ROW_LIMIT):
    """{column: {k: k-th smallest value}} for 1-based ranks k of columns of one numeric type. NaN and
    infinities are missing values."""
    extent = extent or extents(df, list(ranks))
    found = {c: {} for c in ranks}
    # (column, smallest, largest value of the interval): [rows below it, rows inside, ranks]
    wide, narrow = {}, {}

    def place(c, low, high, below, n, ks):
        if low == high:
            found[c].update(dict.fromkeys(ks, low))
        else:
            few = n <= row_limit or _half_width(low, high) == 0  # then at most some thousand values differ
            (narrow if few else wide)[(c, low, high)] = (below, n, ks)

    for c, ks in ranks.items():
        if ks:
            n, low, high = extent[c]
            place(c, low, high, 0, n, sorted(ks))
    while wide:
        now, wide = wide, {}
        for part in _chunks(now):
            rows = (_hits(df, part, _bin).groupBy("s", "bin")
                    .agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
                    .orderBy("s", "bin").collect())  # at most BINS rows per interval
            for i, key in enumerate(part):
                below, _, ks = now[key]
                for r in (r for r in rows if r["s"] == i):
                    mine = [k for k in ks if below < k <= below + r["n"]]
                    if mine and (r["low"], r["high"]) == key[1:]:
                        raise ArithmeticError(f"the search interval of {key[0]} does not shrink: {key[1:]}")
                    if mine:
                        place(key[0], r["low"], r["high"], below, r["n"], mine)
                    below += r["n"]
    for part in _chunks(narrow):
        rows = _hits(df, part).groupBy("s", "x").count().orderBy("s", "x").collect()  # few, see place()
        for i, key in enumerate(part):
            below, _, ks = narrow[key]
            for r in (r for r in rows if r["s"] == i):
                found[key[0]].update({k: r["x"] for k in ks if below < k <= below + r["count"]})
                below += r["count"]
    return found


def percentile_cutoffs(df, column, percents, row_limit=ROW_LIMIT):
    """{percent: smallest value whose average-rank percentile reaches it}, None if none does.

    The percentile grows with the value, so "percentile >= p" is "value >= cut-off": the rank
    of every row need not be known. Only the value at rank ceil(p*n) or the next one can be it.
    """
    extent = extents(df, [column])
    n = extent[column][0]
    if not n:
        return dict.fromkeys(percents)
    ks = {p: max(1, math.ceil(p / 100 * n - 1e-9)) for p in percents}
    at = order_statistics(df, {column: set(ks.values())}, extent, row_limit)[column]
    exprs = {}
    for i, p in enumerate(percents):
        x, v = F.lit(at[ks[p]]), value(df, column)
        exprs[f"less{i}"] = F.count_if(v < x)
        exprs[f"ties{i}"] = F.count_if(v == x)
        exprs[f"next{i}"] = F.min(F.when(v > x, v))
    got = agg_values(df, exprs)
    out = {}
    for i, p in enumerate(percents):
        average = got[f"less{i}"] + (got[f"ties{i}"] + 1) / 2
        out[p] = at[ks[p]] if average / n * 100 >= p else got[f"next{i}"]
    return out


def ranged(rows, order, count, rows_per_bucket, bucket="bucket"):
    """The rows, written once, with the number of the range of `order` they lie in. Spark's range
    partitioner places the borders; what it decided is stored, so later passes agree on it."""
    parts = max(1, -(-count // rows_per_bucket))
    return materialize(rows.repartitionByRange(parts, *order).withColumn(bucket, F.spark_partition_id()), "ranges")


def average_ranks(counts, rows_per_bucket=ROWS_PER_BUCKET, stored=None):
    """(feature, value, n), one row per value -> adds `below` (rows with smaller values), `total`
    and `average_rank`. Ranks are running sums inside ranges of values, shifted by the sizes of
    the ranges before; rows are already counted per value, so no range holds a hot value twice.
    Further columns of the input are kept. `stored`: their number, if the counts are a stored table
    already."""
    if stored is None:
        counts = materialize(counts, "counts")
        stored = counts.count()
    ranges = ranged(counts, ["feature", "value"], stored, rows_per_bucket)
    inside = (Window.partitionBy("feature", "bucket").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy("feature").orderBy("bucket")
    whole = Window.partitionBy("feature")
    # One row per feature and range.
    shift = (ranges.groupBy("feature", "bucket").agg(F.sum("n").alias("m"))
             .select("feature", "bucket",
                     (F.sum("m").over(before) - F.col("m")).alias("shift"),
                     F.sum("m").over(whole).alias("total")))
    return (ranges.withColumn("upto", F.sum("n").over(inside))
            .join(shift, ["feature", "bucket"])
            .withColumn("below", F.col("shift") + F.col("upto") - F.col("n"))
            .withColumn("average_rank", F.col("below") + (F.col("n") + 1) / 2)
            .drop("bucket", "upto", "shift"))


def attach_percentiles(rows, ranks):
    """Join rows (feature, value, ...) to their percentile. A value held by more than 1/1000 of
    the rows is looked up in a broadcast table (at most 1,000 such values per feature can
    exist); only the others are shuffled, so no value makes a hot partition."""
    pct = ranks.select("feature", "value", "n", "total",
                       (F.col("average_rank") / F.col("total")).alias("percentile"))
    is_heavy = F.col("n") * HEAVY_SHARE > F.col("total")
    heavy = F.broadcast(pct.where(is_heavy).select("feature", "value", "percentile"))
    light = pct.where(~is_heavy).select("feature", "value", "percentile")
    keys = ["feature", "value"]
    return (rows.join(heavy, keys)
            .unionByName(rows.join(heavy.drop("percentile"), keys, "left_anti")
                         .join(light, keys, "left")))


def percentile_ranks(df, columns, key, rows_per_bucket=ROWS_PER_BUCKET):
    """(key, feature, value, percentile in 0..1) with average ranks for ties; missing values have
    none."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"),
                               (value(df, c).cast("double") + F.lit(0.0)).alias("value")) for c in columns])
    rows = df.select(col(key), F.inline(pairs)).where(F.col("value").isNotNull())
    counts = rows.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return attach_percentiles(rows, materialize(average_ranks(counts, rows_per_bucket), "ranks"))


def dense_rank_of_scores(df, score, out):
    """Dense rank of the score to two decimals, highest first. Scores lie in 0..100, so the ranked
    table has at most 10,001 rows."""
    cents = F.round(col(score).cast("double"), 2)
    ranks = (df.select(cents.alias("__cents")).distinct()
             .withColumn(out, F.dense_rank().over(Window.orderBy(F.col("__cents").desc()))))
    return df.withColumn("__cents", cents).join(ranks, "__cents", "left").drop("__cents")


def positions(df, column, rows_per_bucket=ROWS_PER_BUCKET, out="position"):
    """Dense row numbers 1..n over a numeric order column, counted inside ranges of the column and
    shifted by the sizes of the ranges before. Reading a position fails where the order column is
    NULL or repeats a value, since the order would be undefined there."""
    ranges = ranged(df, [col(column)], df.count(), rows_per_bucket, "__bucket")
    before = Window.orderBy("__bucket")  # over one row per range
    shift = (ranges.groupBy("__bucket").agg(F.count("*").alias("__m"))
             .select("__bucket", (F.sum("__m").over(before) - F.col("__m")).alias("__shift")))
    inside = Window.partitionBy("__bucket").orderBy(col(column))
    repeated = col(column).isNull() | col(column).eqNullSafe(F.lag(col(column)).over(inside))
    return (ranges.withColumn("__upto", F.row_number().over(inside)).withColumn("__repeated", repeated)
            .join(shift, "__bucket")
            .select(*[col(c) for c in df.columns],
                    F.when(F.col("__repeated"), F.raise_error(F.lit(f"order column {column} is NULL or not unique")))
                    .otherwise(F.col("__shift") + F.col("__upto")).cast("long").alias(out)))
