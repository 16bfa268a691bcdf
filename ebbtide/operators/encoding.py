"""Category codes for text columns with any number of levels.

A dictionary is a table (feature, value, n, id): the ids of a column's texts count from 0 in the order of
the texts. It is counted with map-side sums, dealt by ranges and numbered inside the ranges, shifted by
the ranges before, so no level list passes through the driver or one task. Rows meet it in long form, of
which only the key and one text are shuffled; a value held by more than 1/1000 of the rows is looked up
in a broadcast table of at most 1,000 values per column.

NULL and texts that the dictionary does not hold have no id; in a vector they are all zeros. Numbers count
as their text. Rows that repeat a key are refused where rows are put together again.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ebbtide.functions.columns import col, long_form
from ebbtide.operators.rank import HEAVY_SHARE, ROWS_PER_BUCKET, average_ranks
from ebbtide.session import materialize, new_path


def dictionary(df, columns, rows_per_range=ROWS_PER_BUCKET):
    """(feature, value, n, id), one row per distinct text of each column."""
    counts = (long_form(df, columns).where(F.col("value").isNotNull())
              .groupBy("feature", "value").agg(F.count("*").alias("n")))
    # Every value counts once, so the number of smaller values is the id.
    ranks = average_ranks(counts.select("feature", "value", F.col("n").alias("rows"), F.lit(1).alias("n")), rows_per_range)
    return materialize(ranks.select("feature", "value", F.col("rows").alias("n"), F.col("below").cast("long").alias("id")),
                       "dictionary")


@dataclass
class Encoding:
    """A fitted dictionary with the number of levels of each column."""
    columns: list
    table: DataFrame
    sizes: dict
    rows: dict

    @classmethod
    def fit(cls, df, columns, rows_per_range=ROWS_PER_BUCKET):
        table = dictionary(df, columns, rows_per_range)
        found = {r["feature"]: r for r in table.groupBy("feature").agg(
            F.count("*").alias("levels"), F.sum("n").alias("rows")).collect()}  # one row per column
        sizes, rows = ({c: found[c][k] if c in found else 0 for c in columns} for k in ("levels", "rows"))
        return cls(list(columns), table, sizes, rows)

    @property
    def width(self):
        return sum(self.sizes.values())

    def ids(self, df, key):
        """(key, feature, id) in long form, without the cells that have no id."""
        cells = long_form(df, self.columns, [key]).where(F.col("value").isNotNull())
        total = reduce(lambda out, c: out.when(F.col("feature") == c, F.lit(self.rows[c])),
                       self.columns[1:], F.when(F.col("feature") == self.columns[0], F.lit(self.rows[self.columns[0]])))
        is_heavy = F.col("n") * HEAVY_SHARE > total
        heavy = F.broadcast(self.table.where(is_heavy).select("feature", "value", "id"))
        light = self.table.where(~is_heavy).select("feature", "value", "id")
        looked_up = cells.join(heavy, ["feature", "value"], "left")
        rest = looked_up.where(F.col("id").isNull()).drop("id").join(light, ["feature", "value"])
        return (looked_up.where(F.col("id").isNotNull()).select(col(key), "feature", "id")
                .unionByName(rest.select(col(key), "feature", "id")))

    def codes(self, df, key):
        """The key and a column `<column>_id` for each column; one row per row of df."""
        wide = self.ids(df, key).groupBy(col(key).alias("__k")).agg(
            F.count("*").alias("__n"), F.count_distinct("feature").alias("__d"),
            *[F.max(F.when(F.col("feature") == c, F.col("id"))).alias(f"{c}_id") for c in self.columns])
        once = F.when(F.col("__n") > F.col("__d"), F.raise_error(F.lit("the key repeats"))).otherwise(F.col("__k"))
        wide = wide.select(once.alias("__k"), *[col(f"{c}_id") for c in self.columns])
        return df.select(col(key)).join(wide, col(key) == F.col("__k"), "left").drop("__k")

    def vectors(self, df, key, out="features"):
        """The key and the one-hot vector of each row, sparse, columns in order. Written once: Spark reads the
        struct that was written as a vector, without Python and without a name for each level."""
        if self.width >= 2**31:
            raise ValueError(f"{self.width} levels do not fit a vector")
        places, before = [], 0
        for c in self.columns:
            places.append((col(f"{c}_id") + before).cast("int"))
            before += self.sizes[c]
        hits = F.filter(F.array(*places), lambda i: i.isNotNull())
        codes = self.codes(df, key)
        vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(self.width).alias("size"), hits.alias("indices"),
                          F.transform(hits, lambda i: F.lit(1.0)).alias("values"))
        path = new_path(df.sparkSession, "vectors")
        codes.select(col(key), vector.alias(out)).write.parquet(path)
        schema = StructType([codes.schema[key], StructField(out, VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(path)
