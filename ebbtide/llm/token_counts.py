"""Token counts by batch encoding in Arrow functions that hand back lengths only.

Texts are cut into pieces of about `piece` characters at places where the tokenizer's own splitter always
ends a word, and pieces go to the library in batches of about `batch` bytes, so every call costs
alike, however long or short the texts are. The count of a text is the sum over its pieces; ids
never leave the call.

A place is safe if it lies before a blank, tab or line break that follows something else than white space:
a word of the byte-level splitter holds white space only at its start, and special tokens hold none.
Where no such place comes within another `piece` characters, the change from a letter to a digit, a comma
or a full stop is taken, and the change from a digit to a letter. A run with no safe place, such as
one endless word, is encoded whole. Tokenizers with another splitter, with a normalizer or with
special tokens that take in white space get whole texts.

A null or empty text has no tokens. Strings of special tokens inside texts count as the library
counts them. Rows are kept as they are, repeated rows and null ids too.
"""

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebbtide.llm.sending import broadcast, received

PIECE, BATCH = 8_192, 262_144
BLANK = regex.compile(r"(?<=\S)(?=[ \t\n])")
CHANGE = regex.compile(r"(?<=[A-Za-zぁ-んァ-ン一-龥가-힣])(?=[0-9,.、。])"
                       r"|(?<=[0-9])(?=[A-Za-zぁ-んァ-ン一-龥가-힣])")
RESULT = "n_bytes long, n_tokens long"


def splits_safely(spec):
    """Whether the rules of this module hold for the tokenizer: byte-level words, no normalizer."""
    splitter = spec.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    special = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not CHANGE.search(t["content"])
                  and not regex.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return bool(plain and special and not spec.get("normalizer"))


def cut(text, piece):
    """The text in pieces that begin at safe places."""
    at = 0
    while len(text) - at > piece:
        found = (BLANK.search(text, at + piece, min(len(text), at + 2 * piece))
                 or CHANGE.search(text, at + piece, min(len(text), at + 2 * piece))
                 or BLANK.search(text, at + 2 * piece) or CHANGE.search(text, at + 2 * piece))
        if not found or found.start() <= at:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


class Counter:
    """The tokenizer in one task."""

    def __init__(self, rules, piece, batch):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(rules)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.piece = piece if splits_safely(json.loads(rules)) else None
        self.batch = batch

    def pieces(self, texts):
        """(row, piece) of all texts; empty texts have none."""
        for row, text in enumerate(texts):
            if text:
                for part in (cut(text, self.piece) if self.piece else [text]):
                    yield row, part

    def counts(self, texts):
        """Number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        rows, parts, held = [], [], 0

        def count():
            found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            np.add.at(out, rows, [len(x) for x in found])
        for row, part in self.pieces(texts):
            rows.append(row), parts.append(part)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= self.batch:
                count()
                rows, parts, held = [], [], 0
        if parts:
            count()
        return out


def token_counts(docs, path, keep=("doc_id",), piece=PIECE, batch=BATCH):
    """The columns `keep` of docs with n_bytes (UTF-8) and n_tokens of the column text, by the tokenizer
    file at `path`, which is read on the driver. One pass over docs without a shuffle."""
    with open(path, encoding="utf-8") as file:
        shared = broadcast(docs.sparkSession, file.read())
    rows = docs.select(*(F.col(f"`{c}`").alias(f"in{k}") for k, c in enumerate([*keep, "text"])))
    kinds = ", ".join(f"`{name}` {kind}" for name, (_, kind) in zip(keep, rows.dtypes))

    def run(batches):
        counter = Counter(received(shared), piece, batch)
        for part in batches:
            *kept, texts = part.columns
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            found = pa.array(counter.counts(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, sizes, found], [*keep, "n_bytes", "n_tokens"])
    return rows.mapInArrow(run, ", ".join(filter(None, [kinds, RESULT])))


def over_limit(docs, path, limit=512, **options):
    """`token_counts` with over_limit: more than `limit` tokens."""
    return token_counts(docs, path, **options).withColumn("over_limit", F.col("n_tokens") > limit)
