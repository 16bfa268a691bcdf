"""Fill-in-middle against a plain version, and the exact way back."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import fim
from ebbtide.llm.queries import QUERIES


def numbers(key, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def plain_version(key, text, rate=100, spm_rate=50, seed=7):
    text, (h1, h2, h3, h4) = text or "", numbers(key, seed)
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_texts():
    rng = random.Random(2)
    pool = ["a", "\n", "é漢", "<P>", "<", "P>", "🙂", "\r\n", "\n\n", "xyz "]
    texts = [None, "", "\n", "a", "a\n", "\n\n", *("".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(2000))]
    drawn = [pa.array(h, pa.int64()) for h in zip(*(numbers(k) for k in range(len(texts))))]
    for rate, spm_rate in ((100, 50), (40, 0), (0, 50)):
        found = fim.transformed(pa.array(texts), *drawn, rate, spm_rate, fim.MARKS)
        assert list(zip(*(c.to_pylist() for c in found))) == [
            plain_version(k, t, rate, spm_rate) for k, t in enumerate(texts)]


@pytest.mark.parametrize("batch", [fim.BATCH, 50])
def test_tables(documents, odd_documents, batch):
    for docs in (documents, odd_documents):
        want = sorted(((r.doc_id, *plain_version(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=str)
        found = fim.fill_in_middle(docs.withColumn("text_", docs.text), batch=batch).withColumn("back", fim.restored())
        got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found.collect()]
        assert sorted(got, key=str) == want


def test_clashing_columns_stay_or_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a\nb\n", 9, "x", "old")], "doc_id long, text string, h1 int, `a.b` string, form string")
    found = fim.fill_in_middle(docs)
    assert found.columns == ["doc_id", "h1", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = found.first()
    assert (row.h1, row["a.b"]) == (9, "x") and row.form in ("psm", "spm")


def test_empty_table_and_bad_marks(no_documents):
    assert fim.fill_in_middle(no_documents).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "S", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(no_documents, marks=marks)


def test_other_marks(spark):
    docs = spark.createDataFrame([(k, "a|b\nc.d\n<P>\n") for k in range(40)], "doc_id long, text string")
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    found = fim.fill_in_middle(docs, marks=marks).withColumn("back", fim.restored(marks=marks))
    assert found.where("back = 'a|b\nc.d\n<P>\n' AND form != 'plain'").count() == 40


def test_plan_moves_nothing(documents):
    plan = fim.fill_in_middle(documents)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") >= 1


def test_query(spark, documents):
    rows = QUERIES["op11_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert len(rows) == documents.count()
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert documents.where(F.col("text").isNotNull()).count() > 0
