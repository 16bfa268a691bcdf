"""Mixing sources to target weights by blocks of words.

The words of a source form one stream (documents in an order given by a hash), cut into blocks of
fixed length; only the last may be shorter. A source gets as many slots as bring it to its target.
Each output shard draws its number of slots of each source from a multinomial distribution, under
the condition that the draws of all shards add up to the source's slots. Slot i takes block
p(i mod blocks), where p is a pseudorandom permutation keyed by seed, source and round, so no block
is taken twice before all are taken once. Slots and blocks are joined by (source, block index).

Targets: sources by code point, null last, get the repeating `weights` and share the sum of all
sizes; a target stops at `most` times the source's size and the excess goes to the others by weight.
A null text has no words; null sources are a source of their own.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ebbtide.llm.shingles import mix, texts
from ebbtide.session import materialize

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SOURCE = ["source_no", "source_size", "target", "block", "blocks", "slots", "groups"]


def sizes(docs):
    """docs (row, doc_id, source, text) with the number of words instead of the text."""
    def run(batches):
        for batch in batches:
            found = [len(t.split()) if t else 0 for t in texts(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())],
                                             ["row", "doc_id", "source", "size"])
    return docs.mapInArrow(run, "row long, doc_id long, source string, size long")


def targets(sized, weights, most, block, rows_per_group=4096):
    """One row per source: its number, size, target, block length, blocks and slots."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)) + 1)
    src = src.withColumn("source_no", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    src = (src.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
           .withColumn("at", F.row_number().over(order))
           .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("at")))
           .withColumn("first", F.min("open").over(everything))
           .withColumn("final", F.min_by("level", "open").over(everything)))
    src = src.withColumn("target", F.when(F.col("at") < F.col("first"), F.col("cap"))
                         .otherwise(F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("cap")), F.col("cap"))))
    # Small sources get shorter blocks, so that whole blocks come near any target.
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / 256)))
    src = (src.withColumn("block", length.cast("long"))
           .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
           .withColumn("slots", F.when(F.col("source_size") > 0, F.least(
               F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.col("blocks") * most)).otherwise(0)
               .cast("long"))
           .withColumn("groups", F.ceil(F.col("n") / rows_per_group).cast("long")))
    return src.select("source", *SOURCE)


def streams(sized, src, seed):
    """Each document's place in the stream of its source: running sums within hashed groups of
    bounded size, shifted by the groups before. No group holds a whole source."""
    rows = sized.join(src.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "groups"))
    sums = rows.groupBy("source_no", "group").agg(F.sum("size").alias("n"))
    shift = sums.select("source_no", "group", (F.sum("n").over(Window.partitionBy("source_no").orderBy("group"))
                                               - F.col("n")).alias("shift"))
    inside = Window.partitionBy("source_no", "group").orderBy("doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("upto", F.sum("size").over(inside)).join(shift, ["source_no", "group"])
            .withColumn("start", F.col("shift") + F.col("upto") - F.col("size")).drop("shift", "upto", "group"))


def permuted(i, n, keys):
    """Images of i under pseudorandom permutations of 0..n-1: a four-round Feistel network on the
    next even number of bits, walked until the value lies below n."""
    bits = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    n, x = n.astype(np.uint64), i.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        b, m, k = bits[todo], mask[todo], keys[todo]
        left, right = x[todo] >> b, x[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def slots(src, shards, seed, run_length=65_536):
    """(source_no, slot, shard, place, block_no): what each slot of the mix takes and where it goes.
    `place` orders the slots of a shard."""
    def draw(batches):
        for batch in batches:
            out = []
            for no, name, n in zip(*(c.to_pylist() for c in batch.columns)):
                key = xxhash.xxh3_64_intdigest(b"" if name is None else b"=" + name.encode())
                counts = np.random.default_rng([seed, key]).multinomial(n, np.full(shards, 1 / shards))
                ends = np.cumsum(counts)
                for shard in range(shards):
                    for first in range(int(ends[shard] - counts[shard]), int(ends[shard]), run_length):
                        out.append((no, key - 2**63, shard, first, min(first + run_length, int(ends[shard]))))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["source_no", "key", "shard", "first", "past"])

    def take(batches):
        for batch in batches:
            no, key, shard, slot, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            turn = slot // n
            keys = mix(key.view(np.uint64) + mix(turn.astype(np.uint64) + np.uint64(seed)))
            place = mix(keys ^ slot.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(2), pa.array(place), pa.array(permuted(slot % n, n, keys))],
                ["source_no", "slot", "shard", "place", "block_no"])
    runs = src.select("source_no", "source", "slots").mapInArrow(
        draw, "source_no int, key long, shard int, first long, past long")
    runs = runs.repartition("source_no", "shard", "first").join(src.select("source_no", "blocks"), "source_no")
    each = runs.select("source_no", "key", "shard", F.explode(F.sequence("first", F.col("past") - 1)).alias("slot"), "blocks")
    return each.mapInArrow(take, "source_no int, slot long, shard int, place long, block_no long")


def pieces(placed):
    """placed, once for each block that holds words of the document: block_no and how many words."""
    start, end, block = F.col("start"), F.col("start") + F.col("size"), F.col("block")
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(start / block), F.floor((end - 1) / block)))
    rows = placed.withColumn("block_no", F.explode_outer(numbers))
    no = F.col("block_no")
    return rows.withColumn("words", F.least(end, (no + 1) * block) - F.greatest(start, no * block))


class Mix:
    """The parts of a mix over docs (row, doc_id, source, text)."""

    def __init__(self, docs, weights, most, block, shards, seed):
        self.sized = materialize(sizes(docs), "sizes")
        self.sources = materialize(targets(self.sized, weights, most, block), "sources")
        self.placed = materialize(streams(self.sized, self.sources, seed), "streams")
        self.slots = slots(self.sources, shards, seed)

    def times(self):
        """Pieces of all documents and how often the mix takes each."""
        used = self.slots.groupBy("source_no", "block_no").agg(F.count("*").alias("times"))
        # Spark takes the slots for as small as the few sources they come from; never broadcast them.
        return (pieces(self.placed).join(used.hint("merge"), ["source_no", "block_no"], "left")
                .withColumn("times", F.coalesce("times", F.lit(0))))


DEFAULTS = {"weights": (5, 2, 1), "most": 3, "block": 64, "shards": 64, "seed": 17}


def shares(docs, **options):
    """Per document: doc_id, size, source_size, target of its source, words taken with repeats."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    plan = Mix(rows, **{**DEFAULTS, **options})
    return (plan.times().groupBy("row", "doc_id", "size", "source_size", "target")
            .agg(F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).cast("long").alias("taken")).drop("row"))


def assembled(docs, **options):
    """The mix in order: (shard, place, source_no, slot, part, doc_id, first_word, words). Each slot
    is a block, and a block lists the parts of documents it is made of."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    plan = Mix(rows, **{**DEFAULTS, **options})
    own = pieces(plan.placed).where("words > 0")
    first = F.greatest(F.col("block_no") * F.col("block") - F.col("start"), F.lit(0))
    part = F.greatest(F.col("start") - F.col("block_no") * F.col("block"), F.lit(0))
    return (own.withColumn("first_word", first).withColumn("part", part)
            .join(plan.slots.hint("merge"), ["source_no", "block_no"])
            .select("shard", "place", "source_no", "slot", "part", "doc_id", "first_word", "words"))


def cut(text, counts, times, copy):
    """The text's pieces that are taken at least `copy` times, as they stand in the text."""
    if min(times) >= copy:
        return text
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    edges = np.cumsum([0] + counts)
    at = [0] + [starts[e] for e in edges[1:]]
    return b"".join(text[at[k]:at[k + 1]] for k in range(len(times)) if times[k] >= copy)


def mixed(docs, **options):
    """docs with the mix applied, same columns: copy j of a document holds the pieces taken at least
    j times; documents of which nothing is taken go. Column n_chars, if present, is renewed."""
    names = docs.columns
    numbered = materialize(docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("doc")).withColumn(
        "row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"),
                           F.col("doc.text").alias("text"))
    plan = Mix(rows, **{**DEFAULTS, **options})
    found = (plan.times().where("words > 0").groupBy("row")
             .agg(F.sort_array(F.collect_list(F.struct("block_no", "words", "times"))).alias("parts"))
             .select("row", F.col("parts.words").alias("words"), F.col("parts.times").alias("times"))
             .withColumn("copies", F.array_max("times")).where("copies > 0"))

    def run(batches):
        for batch in batches:
            out = [cut(text, words, times, copy) for text, words, times, copy in
                   zip(texts(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["doc", "text"])
    # A row for each document that is taken: not broadcast either.
    copies = (numbered.join(found.hint("merge"), "row")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
              .select("doc", F.col("doc.text").alias("text"), "words", "times", "copy"))
    made = copies.mapInArrow(run, copies.select("doc", "text").schema)
    renewed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*[renewed.get(n, F.col(f"doc.`{n}`")).alias(n) for n in names])
