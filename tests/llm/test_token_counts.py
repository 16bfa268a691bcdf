"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ebbtide.llm import token_counts as t
from ebbtide.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
POOL = ["a", "b", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "<|endoftext|>", "<|", "|>", "1", "23", ".", ",", "漢字",
        "。", "é", "ſ", "🙂", "'re", "don't", "\r\n", "\xa0", "한", "ー", "0a"]


def whole(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("piece,batch", [(1, 1), (7, 40), (t.PIECE, t.BATCH)])
def test_cutting_changes_no_count(piece, batch):
    rng = random.Random(piece)
    texts = ["".join(rng.choices(POOL, k=rng.randint(0, 80))) for _ in range(4000)] + [None, "", " ", "\n"]
    with open(PATH) as file:
        counter = t.Counter(file.read(), piece, batch)
    assert counter.piece == piece
    assert counter.counts(texts).tolist() == list(map(whole, texts))


def test_pieces_are_short_where_the_text_allows():
    text = "word " * 5000 + "漢字かな。" * 5000 + "x1" * 3000
    parts = list(t.cut(text, 100))
    assert "".join(parts) == text and max(map(len, parts)) <= 210
    assert list(t.cut("a" * 5000, 100)) == ["a" * 5000]


def test_endless_word():
    with open(PATH) as file:
        counter = t.Counter(file.read(), 64, 1000)
    text = "ab" * 20_000
    assert counter.counts([text, "x", text + " y"]).tolist() == [whole(text), 1, whole(text + " y")]


def test_other_tokenizers_get_whole_texts():
    """Lower-casing and word ends: the rules for cutting do not hold, the counts still do."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    with open(path) as file:
        counter = t.Counter(file.read(), 4, 100)
    texts = ["A  b\tc it's <|endoftext|> z", "", "é漢字 12.5"]
    assert counter.piece is None
    assert counter.counts(texts).tolist() == [len(own.encode(x, add_special_tokens=False).ids) for x in texts]


def test_tables(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        rows = t.over_limit(docs.withColumn("n_tokens_", docs.hits if "hits" in docs.columns else docs.n_chars), PATH).collect()
        want = sorted(((r.doc_id, len((r.text or "").encode()), whole(r.text), whole(r.text) > 512) for r in docs.collect()), key=str)
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows), key=str) == want
    assert t.over_limit(no_documents, PATH).count() == 0


def test_columns_kept(odd_documents):
    found = t.token_counts(odd_documents, PATH, keep=("hits", "text", "row"))
    assert found.columns == ["hits", "text", "row", "n_bytes", "n_tokens"]
    assert all(r.n_tokens == whole(r.text) for r in found.collect())
    assert t.token_counts(odd_documents, PATH, keep=()).columns == ["n_bytes", "n_tokens"]


def test_query(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == documents.count()
    for r in documents.collect():
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].over_limit) == (whole(r.text), whole(r.text) > 512)
