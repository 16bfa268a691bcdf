"""Sharding: optimal capacity against dynamic search, whole groups, gapless slots."""

import random
import zlib
from collections import defaultdict

import numpy as np

from ebbtide.llm import shards

DOCS = "doc_id long, text string"


def check(df, rows, count):
    out = df.collect()
    assert len(out) == len(rows)
    slots, of_text, size = defaultdict(list), defaultdict(set), defaultdict(int)
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(text or "")
    for r in out:
        text = texts[r.doc_id][0]
        assert r["size"] == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < count
        slots[r.shard].append(r.slot)
        of_text[text].add(r.shard)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return [size[k] for k in range(count)]


def smallest_capacity(sizes, count):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c, used, full = (low + high) // 2, 1, 0
        for s in sizes:
            if full + s > c:
                used, full = used + 1, 0
            full += s
        low, high = (low, c) if used <= count else (c + 1, high)
    return low


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    sizes = check(shards.assign(documents, 5), rows, 5)
    assert max(sizes) < 1.25 * sum(sizes) / 5


def test_capacity_is_minimal(spark):
    """Against a plain search over all groups, with ranges so coarse that they must be split."""
    rng = random.Random(4)
    rows = [(k, "x" * rng.choice([1, 3, 10, 200]) + str(rng.randint(0, 900))) for k in range(1500)]
    units = shards.atoms(spark.createDataFrame(rows, DOCS)).groupBy("unit").agg({"size": "sum"}).toDF("unit", "size")
    atoms = [r["size"] for r in sorted(units.collect())]
    for start, count in ((3, 7), (6, 24), (16, 11)):
        old, shards.START = shards.START, start
        try:
            ranges = shards.Ranges(units)
            capacity = ranges.capacity(count, max(atoms))
            cuts = ranges.cuts(count, capacity)
        finally:
            shards.START = old
        assert capacity == smallest_capacity(atoms, count)
        parts = np.searchsorted(sorted(r.unit for r in units.collect()), cuts)
        assert max(sum(p) for p in np.split(np.array(atoms), parts)) <= capacity


def test_hot_groups_get_shards_of_their_own(spark):
    rows = [(k, "same text " * 50) for k in range(300)] + [(1000 + k, "") for k in range(200)]
    rows += [(2000 + k, f"text {k}") for k in range(300)]
    sizes = check(shards.assign(spark.createDataFrame(rows, DOCS), 6), rows, 6)
    assert sizes[0] == 300 * 508
    assert max(sizes[1:]) <= 1.3 * (sum(sizes) - sizes[0]) / 5


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    out = shards.assign(odd_documents, 4).where("doc_id is not null")
    assert out.count() == len(rows)
    assert shards.assign(odd_documents, 4).count() == odd_documents.count()
    assert shards.assign(no_documents, 4).count() == 0


def test_fewer_groups_than_shards(spark):
    rows = [(1, "a"), (2, "b"), (3, None)]
    check(shards.assign(spark.createDataFrame(rows, DOCS), 24), rows, 24)
    check(shards.assign(spark.createDataFrame(rows[:1], DOCS), 24), rows[:1], 24)
