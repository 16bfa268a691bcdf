"""Near duplicates against a brute-force version: all pairs of all shingle sets."""

import random

import numpy as np

from ebbtide.llm import dedup
from ebbtide.llm.dedup import Signer, components
from ebbtide.llm.shingles import WordHashes, shingle_set


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    own = {i: i for i in sets}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                own[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def results(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert results(dedup.near_duplicates(documents, size=2)) == brute(rows, 2, 80)


def variants(seed):
    """Groups of near copies, short texts and a passage that many texts share."""
    rng, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(400)]
    shared = " ".join(rng.choices(words, k=30))
    for group in range(6):
        base = rng.choices(words, k=60)
        for _ in range(12):
            copy = list(base)
            for at in rng.sample(range(60), rng.choice([0, 1, 2, 3, 5])):
                copy[at] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [shared + " " + " ".join(rng.choices(words, k=rng.choice([3, 8, 30]))) for _ in range(40)]
    rows += [" ".join(rng.choices(words[:3], k=rng.choice([1, 2, 3]))) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_groups_passages_and_short_texts(spark):
    for seed in (1, 2):
        rows = variants(seed)
        found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
        assert results(found) == brute(rows, 2, 80)


def test_odd_rows(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    out = dedup.near_duplicates(odd_documents, size=5).collect()
    assert len(out) == odd_documents.count()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == brute(rows, 5, 80)
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    left = dedup.filtered(odd_documents, size=5)
    assert left.columns == odd_documents.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 12, 13, 14] and ids.count(None) == 2


def test_empty_table(no_documents):
    assert dedup.near_duplicates(no_documents).count() == 0
    assert dedup.filtered(no_documents).count() == 0


def test_pigeonhole_guarantee():
    """Signatures within the distance always share a key."""
    signer, rng = Signer(10, 6, 1, 7), np.random.default_rng(0)
    a = rng.integers(0, 2**16, (200, 60)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(60, 19, replace=False)] ^= 1
    assert all(set(x) & set(y) for x, y in zip(signer.bands(a), signer.bands(b)))


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in components(path).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_shorter_texts_are_one_shingle():
    memo = WordHashes()
    assert len(shingle_set([b"a"], 2, memo)) == 1 and len(shingle_set([], 2, memo)) == 0
    assert len(shingle_set([b"a", b"b", b"a", b"b"], 2, memo)) == 2
