"""Byte-pair encoding through a lexicon of frequent words, and decoding.

Frequent words are found over the whole table: a word that makes up a share `share` of all words
makes up that share of some batch, so each batch hands on only such words and their counts. At most
`lexicon` words, with the ids that exact merging gives them, are compiled into a minimal acyclic
transducer. The file goes to the shared folder, Spark copies it to every executor, and all workers
of a machine map the same pages. Words outside the lexicon are merged exactly, so the lexicon
changes the speed and never the ids.

The tokenizer file is read on the driver from the path given; workers get its tables by broadcast.
"""

import heapq
import json
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebbtide.llm.sending import broadcast, received
from ebbtide.llm.transducer import Transducer, build, packed
from ebbtide.session import new_path

END = "</w>"
PLAIN = "ɏ"
MEMO_LIMIT = 200_000
LONG = 64
SLICE = 256
SEPARATORS = regex.compile("[\\s--\x1c-\x1f]+", regex.V1)
ODD_SPACES = regex.compile("[\x1c-\x1f]")


def byte_symbols():
    """The character that byte-level vocabularies use for each byte: printable Latin-1 stands for
    itself, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class Vocabulary:
    """Tables of a word-end BPE tokenizer file."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        symbols = byte_symbols()
        self.inner = [ids[symbols[b]] for b in range(256)]
        self.last = [ids[symbols[b] + END] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = split
        empty = {**spec, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}
        self.rules = json.dumps(empty)
        self.bytes = {c: b for b, c in symbols.items()}


class Pairs:
    """What each pair of ids merges to: (rank << 20 | id) by (left << 20 | right), looked up for
    whole arrays in an open hash table."""

    BITS, EMPTY, NONE = 18, -1, np.int64(1) << np.int64(60)

    def __init__(self, merges):
        size = 1 << self.BITS
        self.keys, self.values = np.full(size, self.EMPTY, np.int64), np.full(size, self.NONE, np.int64)
        keys, values = np.fromiter(merges.keys(), np.int64), np.fromiter(merges.values(), np.int64)
        slots = self.slot(keys)
        while len(keys):
            free = self.keys[slots] == self.EMPTY
            _, first = np.unique(slots, return_index=True)
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self.keys[slots[won]], self.values[slots[won]] = keys[won], values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) % size

    def slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, keys):
        slots = self.slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], self.NONE)
        todo = np.flatnonzero((held != keys) & (held != self.EMPTY))
        while len(todo):
            slots[todo] = (slots[todo] + 1) % len(self.keys)
            held = self.keys[slots[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (held != self.EMPTY)]
        return out


class Merger:
    """Splits pieces of text into words and merges words exactly."""

    def __init__(self, vocabulary):
        self.v = vocabulary
        self.pattern = regex.compile(vocabulary.pattern)
        self.rules = Tokenizer.from_str(vocabulary.rules)
        self.pairs = Pairs(vocabulary.merges)
        self.inner, self.last = np.array(vocabulary.inner, np.int64), np.array(vocabulary.last, np.int64)

    def split(self, piece):
        """Words (UTF-8 bytes) of a piece without white space. Latin letters are composed already
        and follow the same rules here; other scripts go to the tokenizer's own normalizer and
        splitter."""
        if piece.isascii() or max(piece) <= PLAIN:
            low = piece.lower()
            if low.isalpha():
                return [low.encode()]
            if low[-1] in ".," and low[:-1].isalpha():
                return [low[:-1].encode(), low[-1].encode()]
            return [w.encode() for w in self.pattern.findall(low)]
        text = self.rules.normalizer.normalize_str(piece)
        return [bytes(self.v.bytes[c] for c in word) for word, _ in self.rules.pre_tokenizer.pre_tokenize_str(text)]

    def merged(self, words):
        """Ids of each word as bytes of int32."""
        out = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = np.array(self.long(w), np.int32).tobytes()
        for k, ids in zip(short, self.together([words[k] for k in short])):
            out[k] = ids
        return out

    def together(self, words):
        """All words at once: in every round each word merges the first of its lowest-ranked pairs,
        until no word has a pair left."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        ids, own, ends = self.inner[data], np.repeat(np.arange(len(words)), lengths), np.cumsum(lengths) - 1
        ids[ends] = self.last[data[ends]]
        done_ids, done_own = [], []
        while len(ids):
            found = np.full(len(ids), Pairs.NONE)
            inside = np.flatnonzero(own[:-1] == own[1:])
            found[inside] = self.pairs.get(ids[inside] << 20 | ids[inside + 1])
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.repeat(np.minimum.reduceat(found, starts), sizes)
            stuck = least == Pairs.NONE
            if stuck.any():
                done_ids.append(ids[stuck]), done_own.append(own[stuck])
                ids, own, found, least = ids[~stuck], own[~stuck], found[~stuck], least[~stuck]
            at = np.flatnonzero(found == least)
            at = at[np.concatenate([[True], own[at[1:]] != own[at[:-1]]])] if len(at) else at
            ids[at] = found[at] & 0xFFFFF
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, own = ids[keep], own[keep]
        ids, own = np.concatenate(done_ids), np.concatenate(done_own)
        ids = ids[np.argsort(own, kind="stable")].astype(np.int32).tobytes()
        past = np.cumsum(np.bincount(own, minlength=len(words))) * 4
        return [ids[a:b] for a, b in zip([0, *past.tolist()], past.tolist())]

    def long(self, word):
        """The same merges in the same order from a heap, for one word of any length."""
        s = [self.v.inner[b] for b in word[:-1]] + [self.v.last[word[-1]]]
        get, n = self.v.merges.get, len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, k) for k in range(n - 1) if (m := get(s[k] << 20 | s[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            b = after[k]
            if s[k] is None or b >= n or get(s[k] << 20 | s[b]) != m:
                continue
            s[k], s[b] = m & 0xFFFFF, None
            after[k] = after[b]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (x := get(s[left] << 20 | s[after[left]])) is not None:
                    heapq.heappush(heap, (x, left))
        return [x for x in s if x is not None]


def spaced(text):
    """Pieces between white space. Python's split takes four control characters for white space
    that Unicode does not."""
    return SEPARATORS.split(text) if ODD_SPACES.search(text) else text.split()


def frequent(docs, share, most):
    """The `most` most frequent pieces of the table with their counts."""
    def run(batches):
        for batch in batches:
            counts = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(spaced(text))
            least = max(2, counts.total() * share)
            found = [(w, n) for w, n in counts.items() if n >= least]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()),
                                              pa.array([n for _, n in found], pa.int64())], ["piece", "n"])
    parts = docs.where("text is not null").select("text").mapInArrow(run, "piece string, n long")
    return parts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)


def write_file(spark, path, data):
    """Bytes to a file of any store that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()


def compiled(docs, vocabulary, lexicon, share, longest=48):
    """Name of the file, present on every executor, that holds the transducer of frequent words."""
    spark, merger, words = docs.sparkSession, Merger(vocabulary), Counter()
    for row in frequent(docs, share, lexicon).collect():
        for word in merger.split(row.piece):
            words[word] += row.n
    best = sorted(w for w, _ in words.most_common(lexicon) if len(w) <= longest)
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = f"{new_path(spark, 'lexicon')}/{name}"
    ids = [np.frombuffer(x, np.int32).tolist() for x in merger.merged(best)]
    write_file(spark, path, packed(build(zip(best, ids))))
    spark.sparkContext.addFile(path)
    return name


class Encoder:
    """Ids of texts in one task: recent pieces from a bounded memo, frequent words from the
    transducer, all others by merging."""

    def __init__(self, vocabulary, lexicon):
        self.merger, self.lexicon, self.memo = Merger(vocabulary), lexicon, {}
        self.special = {text: np.array([i], np.int32).tobytes() for text, i in vocabulary.special.items()}
        longest_first = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.marks = regex.compile(f"({'|'.join(longest_first)})") if self.special else None

    def pieces(self, text):
        """Pieces between white space; strings of special tokens are pieces of their own."""
        if not text:
            return []
        if self.marks is None or not self.marks.search(text):
            return spaced(text)
        return [p for part in self.marks.split(text) for p in ([part] if part in self.special else spaced(part))]

    def learn(self, pieces):
        """Put the ids of new pieces into the memo."""
        words, known, rest = {}, {}, []
        for piece in pieces:
            words[piece] = own = self.merger.split(piece)
            for word in own:
                if word not in known:
                    known[word] = ids = self.lexicon.get(word)
                    if ids is None:
                        rest.append(word)
        known.update(zip(rest, self.merger.merged(rest)))
        for piece, own in words.items():
            self.memo[piece] = known[own[0]] if len(own) == 1 else b"".join([known[w] for w in own])

    def texts(self, texts):
        """Ids of each text as bytes of int32; a null or empty text has none."""
        rows = [self.pieces(t) for t in texts]
        new = {p for row in rows for p in row if p not in self.memo}
        if len(self.memo) + len(new) > MEMO_LIMIT:
            self.memo = dict(self.special)
            new = {p for row in rows for p in row}
        self.memo.update((p, ids) for p, ids in self.special.items())
        new.difference_update(self.special)
        new.discard("")
        self.learn(new)
        self.memo[""] = b""
        out = [b"".join(map(self.memo.__getitem__, row)) for row in rows]
        for piece in new:
            if len(piece) > LONG:
                del self.memo[piece]
        return out


class Decoder:
    """Text of ids, special tokens kept. The vocabulary names no decoder, so tokens are joined by
    spaces; ids outside the vocabulary are passed over."""

    def __init__(self, vocabulary):
        self.get = vocabulary.tokens.get

    def text(self, ids):
        return " ".join([t for t in map(self.get, ids) if t is not None])


def run_encoder(docs, path, keep, decode, lexicon, share):
    vocabulary = Vocabulary(path)
    name = compiled(docs, vocabulary, lexicon, share)
    shared = broadcast(docs.sparkSession, vocabulary)
    rows = docs.select("text", "doc_id", *keep)
    names = [*rows.columns[1:], "ids", *["decoded"] * decode]

    def run(batches):
        encoder = Encoder(received(shared), Transducer(SparkFiles.get(name)))
        decoder = Decoder(received(shared))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = encoder.texts(part.column(0).to_pylist())
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                columns = [*part.columns[1:], ids]
                if decode:
                    columns.append(pa.array([decoder.text(np.frombuffer(x, np.int32).tolist()) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{kinds}, ids array<int>" + ", decoded string" * decode)


def encode(docs, path, keep=(), lexicon=65_536, share=4e-6):
    """(doc_id, columns to keep, ids) for docs (doc_id, text). A null or empty text has no ids."""
    return run_encoder(docs, path, keep, False, lexicon, share)


def round_trip(docs, path, keep=(), lexicon=65_536, share=4e-6):
    """`encode` with the column `decoded`, the text that the ids of each row give, made in the same
    task so that no second Python worker is needed."""
    return run_encoder(docs, path, keep, True, lexicon, share)


def decoded(rows, path):
    """rows with the column `decoded` for their column `ids`; null ids give null."""
    shared = broadcast(rows.sparkSession, Vocabulary(path))

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        decoder = Decoder(received(shared))
        return pa.array([None if x is None else decoder.text(x) for x in ids.to_pylist()], pa.string())
    return rows.withColumn("decoded", decode("ids"))
