"""Encoding and decoding against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ebbtide.llm import bpe
from ebbtide.llm.transducer import Transducer, build, packed

PATH = public_tokenizers.path("word_bpe_49k.json")
REFERENCE = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(PATH)
MERGER = bpe.Merger(VOCABULARY)
SAMPLES = ["", "A  b\tc", "It's we'LL they've", "x<|endoftext|>y <|startoftext|>", "<|", "é É İı ſ ﬁ Σίσυφος",
           "한국어 漢字 🙂👍🏽 नमस्ते", "a\x1cb\x85c　d", "1234 ½ ²", "!!??.,", "ab" * 4000 + "xyz" * 900]


def ids(data):
    return np.frombuffer(data, np.int32).tolist()


def encoder(tmp_path_factory, words=()):
    path = tmp_path_factory.mktemp("lexicon") / "words.bin"
    path.write_bytes(packed(build((w, ids(x)) for w, x in zip(words, MERGER.merged(list(words))))))
    return bpe.Encoder(VOCABULARY, Transducer(str(path)))


def test_odd_texts(tmp_path_factory):
    found = encoder(tmp_path_factory, sorted([b"it", b"the", b"'", b"a"])).texts([*SAMPLES, None])
    for text, data in zip([*SAMPLES, ""], found):
        assert ids(data) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_any_text(tmp_path_factory):
    own = encoder(tmp_path_factory)

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(max_size=60))
    def check(text):
        assert ids(own.texts([text])[0]) == REFERENCE.encode(text, add_special_tokens=False).ids
    check()


def test_long_and_short_merging_agree():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeth", k=rng.randint(1, 64))).encode() for _ in range(200)]
    assert [ids(x) for x in MERGER.merged(words)] == [MERGER.long(w) for w in words]


def test_transducer_is_exact_and_shares_suffixes(tmp_path):
    rng = random.Random(5)
    pairs = {bytes(rng.choices(b"abc", k=rng.randint(1, 9))): [rng.randint(0, 9) for _ in range(rng.randint(0, 4))]
             for _ in range(1500)}
    path = tmp_path / "t.bin"
    path.write_bytes(packed(build(sorted(pairs.items()))))
    found = Transducer(str(path))
    assert all(ids(found.get(w)) == out for w, out in pairs.items())
    others = {bytes(rng.choices(b"abcd", k=rng.randint(0, 9))) for _ in range(2000)} - set(pairs)
    assert all(found.get(w) is None for w in others)
    same = [(bytes([a]) + b"xyzxyz", [a]) for a in range(97, 120)]
    (tmp_path / "s.bin").write_bytes(packed(build(same)))
    shared = Transducer(str(tmp_path / "s.bin"))
    assert len(shared.tails) == 2 * 8 and ids(shared.get(b"axyzxyz")) == [97]


def check_rows(df, rows):
    got = {(r.doc_id, r.text): (r.ids, r.decoded) for r in df.collect()}
    for doc, text in rows:
        want = REFERENCE.encode(text or "", add_special_tokens=False).ids
        assert got[doc, text] == (want, REFERENCE.decode(want, skip_special_tokens=False))


def test_tables(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = bpe.round_trip(docs.withColumn("ids", docs.doc_id), PATH, keep=("text",), share=1e-3)
        assert out.count() == len(rows)
        check_rows(out, rows)
    assert bpe.encode(no_documents, PATH).count() == 0


def test_decoded_alone(spark):
    rows = spark.createDataFrame([(1, [320, 49407]), (2, []), (3, None), (4, [-5, 70000])], "k int, ids array<int>")
    out = {r.k: r.decoded for r in bpe.decoded(rows, PATH).collect()}
    assert out == {1: REFERENCE.decode([320, 49407], skip_special_tokens=False), 2: "", 3: None, 4: ""}
