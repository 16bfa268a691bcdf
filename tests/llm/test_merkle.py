"""Merkle manifests against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import merkle
from ebbtide.llm.queries import QUERIES, SQL
from workload.check import compare, connect

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][at:at + fanout]) for at in range(0, len(out[-1]), fanout)])
    return out


def path(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        first = at // fanout * fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])))
        at //= fanout
    return out


def tampered(row):
    if row[0] is None or row[3] is None or zlib.crc32(str(row[0]).encode()) % 7:
        return row
    return (*row[:3], row[3] + 1, row[4])


def plain_version(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]], fanout) for g in names}
    top = tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for j, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            steps, node = path(trees[g], i, fanout) + path(top, j, fanout), leaf(tampered(row))
            for before, behind in steps:
                node = h(before, node, behind)
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], h(*(b + a for b, a in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(docs, **options):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    rows = merkle.verified(docs, changed={"n_chars": changed}, **options)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows.collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3])
def test_tables(documents, odd_documents, fanout):
    for docs in (documents, odd_documents):
        rows = [tuple(r) for r in docs.select(FIELDS).collect()]
        assert found(docs, fanout=fanout, rows_per_range=37) == plain_version(rows, fanout)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33])
def test_sizes_around_a_block(spark, n):
    """One group beside groups of one row: full blocks, one node beyond them, lone leaves."""
    rows = [(k, "s", "big", k, f"t{k}") for k in range(n)] + [(100 + k, None, f"l{k}", None, None) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs) == plain_version(rows, 2)


def test_lone_leaf_is_the_root(spark):
    docs = spark.createDataFrame([(1, "s", None, 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.verified(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == h()


def test_empty_table(no_documents):
    assert merkle.verified(no_documents).count() == 0


def test_tampering_is_seen(documents):
    touched = {r.doc_id for r in documents.collect() if r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert {row[0] for row in found(documents) if not row[-1]} == touched


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op11_fill_in_middle", "op12_merkle_manifest"):
        ok, rows, message, _ = compare(spark, connect(sf), sf, QUERIES[name], SQL[name])
        assert ok and rows > 0, message
