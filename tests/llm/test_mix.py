"""Mixing: targets, bounds, permutations and the mixed texts."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ebbtide.llm import mix


def words(text):
    return text.encode().split() if text else []


def wanted(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, load = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / load > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: rest * weight[s] / load for s in free}}
        fixed.update({s: 3.0 * sizes[s] for s in over})


def check(docs, tolerance):
    rows, out = docs.collect(), mix.shares(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want, taken = wanted(dict(sizes)), defaultdict(int)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert len(out) == len(rows)
    for r in out:
        of = {(len(words(x.text)), sizes[x.source], round(want[x.source], 6)): x for x in by_id[r.doc_id]}
        key = (r["size"], r.source_size, round(r.target, 6))
        assert key in of and 0 <= r.taken <= 3 * r["size"]
        taken[of[key].source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= tolerance * target + 3
    again = mix.shares(docs.repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_documents(documents):
    check(documents, 0.02)


def test_odd_rows(odd_documents):
    check(odd_documents.where("doc_id is not null and doc_id != 10"), 0.5)
    assert mix.shares(odd_documents).count() == odd_documents.count()


def test_empty_tables(no_documents, odd_documents):
    assert mix.shares(no_documents).count() == 0 and mix.mixed(no_documents).count() == 0
    blank = odd_documents.where("doc_id in (4, 5, 6)")
    assert {(r["size"], r.taken) for r in mix.shares(blank).collect()} == {(0, 0)}
    assert mix.mixed(blank).count() == 0


def test_permutations_are_onto():
    for n in (1, 2, 3, 7, 64, 1000):
        full = np.full(n, n)
        images = [mix.permuted(np.arange(n), full, np.full(n, key, np.uint64)) for key in (1, 2)]
        assert all(sorted(x) == list(range(n)) for x in images)
        assert n < 64 or (images[0] != images[1]).any()


def test_mixed_texts_hold_what_is_taken(documents):
    shares = {r.doc_id: r.taken for r in mix.shares(documents).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    out, got = mix.mixed(documents), defaultdict(list)
    assert out.columns == documents.columns
    for r in out.collect():
        got[r.doc_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert {d: sum(len(words(t)) for t in ts) for d, ts in got.items()} == {d: n for d, n in shares.items() if n}
    for doc, copies in got.items():
        longest = max(copies, key=len)
        have = iter(words(texts[doc]))
        assert all(w in have for w in words(longest))


def test_mixed_keeps_clashing_columns(odd_documents):
    out = mix.mixed(odd_documents)
    assert out.columns == odd_documents.columns and out.count() > 0


def test_blocks_in_order(documents):
    """Every slot of the mix is one whole block, made of parts of documents in stream order."""
    parts = mix.assembled(documents).collect()
    slots = defaultdict(list)
    for r in parts:
        slots[r.source_no, r.slot].append(r)
    for rows in slots.values():
        rows.sort(key=lambda r: r.part)
        assert len({(r.shard, r.place) for r in rows}) == 1
        assert [r.part for r in rows] == list(np.cumsum([0] + [r.words for r in rows])[:-1])
    taken = defaultdict(int)
    for r in parts:
        taken[r.doc_id] += r.words
    assert dict(taken) == {r.doc_id: r.taken for r in mix.shares(documents).collect() if r.taken}


def test_slots_are_not_broadcast(spark, documents):
    """There is a row for each block of words, although they are made from one row a source."""
    plan = mix.Mix(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text"), **mix.DEFAULTS)
    for rows in (plan.times(), mix.assembled(documents), mix.mixed(documents)):
        assert not re.search("BroadcastHashJoin [^\n]*block_no", rows._jdf.queryExecution().toString())
        assert re.search("SortMergeJoin [^\n]*block_no", rows._jdf.queryExecution().toString())


def test_parts_of_documents_are_not_broadcast(documents):
    """There is a row for each document taken, and Spark would turn to a broadcast while it runs."""
    rows = mix.mixed(documents)
    assert rows.collect()
    joins = re.findall(r"(\w+Join) \[row#", rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    assert set(joins) == {"SortMergeJoin"}
