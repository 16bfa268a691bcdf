"""Language and quality: held-out accuracy, defined results for odd rows, independence of inputs
that must not matter."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from ebbtide.llm import lang, quality


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_language_of_held_out_rows(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    out = lang.identify(documents).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in out)
    test = [r.lang_pred == truth[r.doc_id] for r in out if r.held_out]
    assert np.mean(test) > 0.97


def test_language_ignores_lang_of_held_out_rows(documents):
    hidden = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in lang.identify(d).collect()} for d in (documents, hidden))
    assert a == b


def test_language_of_odd_rows(odd_documents, no_documents):
    out = lang.identify(odd_documents).collect()
    assert len(out) == odd_documents.count()
    und = [r for r in out if r.doc_id in (4, 5, 6, 9)]
    assert len(und) == 4 and all(r.lang_pred == "und" and r.score == 0 and r.ambiguous for r in und)
    assert all(r.lang_pred != "und" for r in out if r.doc_id in (1, 7, 10, 12, 13, 14))
    assert lang.filtered(odd_documents).columns == odd_documents.columns
    assert lang.identify(no_documents).count() == 0 and lang.filtered(no_documents).count() == 0
    blank = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lang.identify(blank).collect()} == {"und"}


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 9, 30):
        code = lang.codewords(k)
        assert min(np.count_nonzero(code[i] != code[j]) for i in range(k) for j in range(i)) >= (1 if k == 2 else 2)
        assert (abs(code.sum(axis=0)) < k).all()


def test_wrong_bit_is_corrected():
    """One classifier that is wrong does not change the decoded language."""
    counts = np.eye(5).repeat(8, axis=1) * 50 + 1
    codes = lang.Codes(list("abcde"), counts)
    codes.weights[:, 3] *= -1
    assert [int(codes.losses(c).argmin()) for c in counts] == [0, 1, 2, 3, 4]


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    pos = labels.sum()
    return (order[labels == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    test = [(r.score, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    scores, known = np.array(test).T
    assert auc(scores, known) > 0.95
    assert (scores[known == 1] >= 0.3).mean() > 0.97


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = rng.random((60, 40))
    model = quality.Neighbours(rows, rng.integers(0, 2, 60).astype(float), 8)
    queries = rng.random((30, 40))
    got = model.scores(queries, 7, 4.0)
    q = model.project(queries)
    for k, vector in enumerate(q):
        cosine = model.vectors @ vector
        near = np.argsort(-cosine)[:7]
        weight = np.maximum(cosine[near], 1e-6) ** 4
        assert abs(got[k] - (weight * model.labels[near]).sum() / weight.sum()) < 1e-5
    assert model.scores(np.zeros((1, 40)), 7, 4.0)[0] == model.prior


def test_quality_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(i, i % 2, None, 1.0) for i in (1, 2, 3, 7, 8, 9, 10, 12, 13, 14)]
                                   + [(None, 1, 0, 1.0), (1, None, 0, 1.0), (2, 0, 0, 1.0)],
                                   "doc_id long, quality int, toxic int, score double")
    out = quality.classify(odd_documents, labels).collect()
    assert len(out) == odd_documents.count()
    assert len({r.score for r in out if r.doc_id in (4, 5)}) == 1
    assert all(not r.held_out for r in out if r.doc_id is None)
    assert {r.score for r in quality.classify(odd_documents, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_documents, labels).count() == 0
    assert quality.filtered(odd_documents, labels).columns == odd_documents.columns


def test_same_model_on_each_run(documents, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = ({r.doc_id: r.score for r in quality.classify(documents.repartition(n), labels).collect()} for n in (1, 5))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6
