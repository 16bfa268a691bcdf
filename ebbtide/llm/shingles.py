"""Words and word shingles of texts as 64-bit hashes, made batch by batch in Arrow tasks."""

import numpy as np
import pyarrow as pa
import xxhash

MEMO_LIMIT = 300_000
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
STEP = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(33)


class WordHashes(dict):
    """Hash of each word; forgets all words once the limit is reached, so memory stays bounded."""

    def __missing__(self, word):
        val = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_LIMIT:
            self.clear()
        self[word] = val
        return val


def mix(x):
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> SHIFT)) * MIX[0]
    x = (x ^ (x >> SHIFT)) * MIX[1]
    return x ^ (x >> SHIFT)


def texts(column):
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def words(text):
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; bytes.split and bytes.lower do just that."""
    return text.lower().split() if text else []


def shingle_set(tokens, size, memo):
    """Sorted distinct hashes of all runs of `size` words; a shorter text is one shingle."""
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, tokens), np.uint64, n)
    width = min(size, n)
    acc = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        acc = mix(acc * STEP + hashes[k:n - width + 1 + k])
    return np.unique(acc)
