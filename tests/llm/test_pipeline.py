"""The stages one after the other, each against what its operator says about its own input."""

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from ebbtide.llm import dedup, lang, mix, quality
from ebbtide.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, documents):
    out, docs = [documents], documents
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages, documents):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "language", "dedup", "mix", "bpe"]
    assert all(df.columns == documents.columns for df in stages[:-1])


def test_quality(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = quality.classify(stages[0], labels).where("predicted = 1")
    assert ids(stages[1]) == ids(want)
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(clean & set(ids(stages[1]))) >= 0.95 * len(clean)


def test_language(stages):
    assert ids(stages[2]) == ids(lang.identify(stages[1]).where("not ambiguous"))
    assert len(ids(stages[2])) >= 0.97 * len(ids(stages[1]))


def test_dedup(stages):
    assert ids(stages[3]) == ids(dedup.near_duplicates(stages[2], size=5).where("kept"))


def test_mix(stages):
    taken = {r.doc_id: r.taken for r in mix.shares(stages[3]).collect() if r.taken}
    got = {}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == taken


def test_bpe(stages):
    reference = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, tuple(reference.encode(r.text, add_special_tokens=False).ids)) for r in stages[4].collect())
    got = [(r.doc_id, tuple(r.ids)) for r in stages[5].collect()]
    assert sorted(got) == want
    assert all(r.n_tokens == len(r.ids) for r in stages[5].collect())


def test_run_equals_the_stages(stages, spark):
    a, b = ([(r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in df.collect()] for df in (stages[5], pipeline.run(spark, SF)))
    assert sorted(a, key=str) == sorted(b, key=str)


def test_odd_and_empty_input(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), f"odd-{name}")
        assert docs.columns == ["doc_id", "source", "n_tokens", "ids"]


def test_queries_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_sql_of_urls(spark):
    from workload.check import compare, connect
    ok, rows, message, _ = compare(spark, connect(SF), SF, entry.queries()["op6_url_vocabulary"], entry.oracle_sql()["op6_url_vocabulary"])
    assert ok and rows, message


def test_values_are_plain(stages):
    assert all(isinstance(r.doc_id, (int, np.integer)) for r in stages[5].select("doc_id").limit(5).collect())
