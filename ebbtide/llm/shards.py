"""Minimax contiguous partition of documents into shards of near equal bytes.

The atoms are groups of equal texts (null counts as empty), ordered by a 60-bit prefix of the hash of
the text; texts that agree in it form one atom. Groups that are larger than an equal share of what
remains come first in the order, each with a shard of its own. For the others the smallest capacity
that lets a greedy pass fill the remaining shards is found by searching between bounds.

The driver never holds the groups. It holds byte counts of hash ranges, at first 65,536 of them. A
greedy pass over ranges is safe when it succeeds. When it fails, the ranges at which it had to stop
are split by one more aggregation and the pass is repeated, until it has failed at single groups.
"""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.session import materialize

BITS = 60
START, SPLIT = 16, 6
TRIES = 15
CELLS, PARTS = 4, 512


def atoms(docs):
    """docs with size, text_crc32 and unit, the place of the text's group in the order."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("unit"))


class Ranges:
    """Sizes of hash ranges [low, low + 2**bits) that are not empty, finer where cuts fall."""

    def __init__(self, units):
        self.units = units
        self.rows = self.counted(units, BITS - START)
        self.index()

    def counted(self, units, bits):
        low = F.shiftleft(F.shiftright("unit", bits), bits)
        rows = units.groupBy(low.alias("low")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return [(r.low, bits, r["size"], r.n) for r in rows]

    def index(self):
        self.rows.sort()
        self.low = np.array([r[0] for r in self.rows], np.int64)
        self.many = np.array([r[3] > 1 for r in self.rows], bool)
        self.upto = np.concatenate([[0], np.cumsum([r[2] for r in self.rows], dtype=np.int64)])

    def split(self, places):
        """Replace the ranges at these places by their parts, all in one aggregation per width."""
        gone = {self.low[k]: self.rows[k] for k in places}
        for bits in {r[1] for r in gone.values()}:
            lows = [int(low) for low, r in gone.items() if r[1] == bits]
            inside = F.shiftleft(F.shiftright("unit", bits), bits).isin(lows)
            self.rows += self.counted(self.units.where(inside), max(bits - SPLIT, 0))
        taken = {(low, r[1]) for low, r in gone.items()}
        self.rows = [r for r in self.rows if (r[0], r[1]) not in taken or r[3] == 1]
        self.index()

    def greedy(self, capacity, shards, start=0):
        """Whether the ranges from `start` on fit into `shards` as they are, and where filling stopped."""
        stops, at, last = [], start, len(self.rows)
        for _ in range(shards):
            at = int(np.searchsorted(self.upto, self.upto[at] + capacity, "right")) - 1
            if at >= last:
                return True, stops
            stops.append(at)
        return False, stops

    def capacity(self, shards, largest):
        """The smallest capacity with which the groups fit."""
        total = int(self.upto[-1])
        low, high = max(-(-total // shards), largest) - 1, total
        while high - low > 1:
            tries = sorted({low + (high - low) * k // (TRIES + 1) for k in range(1, TRIES + 1)} - {low, high} or {low + 1})
            coarse = set()
            for c in tries:
                fits, stops = self.greedy(c, shards)
                if fits:
                    high = min(high, c)
                    break
                blocking = {k for k in stops if self.many[k]}
                if blocking:
                    coarse |= blocking
                else:
                    low = max(low, c)
            coarse and self.split(coarse)
        return high

    def cuts(self, shards, capacity):
        """First values of shards 1, 2, ...: each cut lies as near to an equal share of the rest as
        the capacity allows for this shard and those after it."""
        out, at, last = [], 0, len(self.rows)
        for left in range(shards - 1, 0, -1):
            aim = self.upto[at] + (self.upto[-1] - self.upto[at]) / (left + 1)
            most = int(np.searchsorted(self.upto, self.upto[at] + capacity, "right")) - 1
            k = int(np.searchsorted(self.upto, aim))
            k -= k > at and aim - self.upto[k - 1] < self.upto[min(k, last)] - aim
            k = min(max(k, at), most)
            at = k if self.greedy(capacity, left, k)[0] else most
            out.append(int(self.low[at]) if at < last else 1 << BITS)
        return out


def layout(rows, shards):
    """(units with a shard of their own, cuts among the others)."""
    units = materialize(rows.groupBy("unit").agg(F.sum("size").alias("size")), "units")
    rest = units.agg(F.sum("size")).first()[0] or 0
    own, left, largest = [], shards, 0
    for r in units.orderBy(F.desc("size"), "unit").limit(shards).collect():
        largest = r["size"]
        if left == 1 or largest * left <= rest:
            break
        own.append(r.unit)
        rest, left, largest = rest - largest, left - 1, 0
    if not rest:
        return own, []
    ranges = Ranges(units.where(~F.col("unit").isin(own)))
    return own, ranges.cuts(left, ranges.capacity(left, largest))


def assign(docs, shards=24):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    Slots count the rows of a shard from 0 by (hash cell, part, text group, doc_id). They come from
    counts of small parts, of which no part holds more than a 512th of a large group. Repeated rows
    get slots of their own.
    """
    rows = materialize(atoms(docs.select("doc_id", "text")), "atoms")
    own, cuts = layout(rows, shards)
    unit, shard = F.col("unit"), F.lit(len(own))
    for cut in cuts:
        shard = shard + (unit >= cut).cast("int")
    for k in range(len(own) - 1, -1, -1):
        shard = F.when(unit == own[k], k).otherwise(shard)
    keys = ["shard", "cell", "part"]
    rows = (rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.shiftright("unit", BITS - CELLS))
            .withColumn("part", F.pmod(F.xxhash64("doc_id", "unit"), F.lit(PARTS))))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "part")) - F.col("n")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("unit", "doc_id")) - 1
    return (rows.withColumn("within", within).join(counts.select(*keys, before.alias("before")), keys)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
