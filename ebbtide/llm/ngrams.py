"""Hashed character n-grams of whole texts, counted piece by piece in fixed memory."""

import numpy as np

PIECE = 1 << 20
FACTOR = np.uint32(2654435761)
LETTER, UPPER, DIGIT, SPACE = 1, 2, 3, 4


def classes():
    """Class of every code point: letters, upper-case letters, digits, white space, others."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = UPPER if char.isupper() else LETTER
        elif char.isdigit():
            table[code] = DIGIT
        elif char.isspace():
            table[code] = SPACE
    return table


def pieces(text, overlap):
    """Code points of the text in overlapping pieces, so no n-gram is lost or counted twice."""
    for at in range(0, max(len(text), 1), PIECE):
        part = text[max(0, at - overlap):at + PIECE]
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(codes, width, buckets, salt):
    """Bucket of each run of `width` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    acc = np.full(n, np.uint32(salt * 2 + 1))
    for k in range(width):
        acc = (acc ^ codes[k:k + n]) * FACTOR
        acc ^= acc >> np.uint32(15)
    return (acc % np.uint32(buckets)).astype(np.int64)
