"""Hashes of words and of character windows over whole Arrow batches of texts, by prefix sums of a polynomial.

A text column is looked at as one array of bytes (or code points). With S[i] the running sum of (x[j] + 1) * P**j modulo
2**64, the hash of any piece [s, e) is (S[e] - S[s]) * P**-s: the same for equal pieces wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACES = (32, 9, 10, 11, 12, 13)
CHUNK_BYTES = 1 << 21

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0..P**n and P**-0..P**-n modulo 2**64, kept by the worker."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        steps = np.full((2, size), [[BASE], [INVERSE]], np.uint64)
        steps[:, 0] = 1
        _powers[:] = list(np.multiply.accumulate(steps, axis=1))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, last row + 1, bytes, offsets of the rows in them) of about `limit` bytes; whole rows only.
    Null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def pieces(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the pieces [start, end) of an integer array."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def classes(punctuation: bool) -> np.ndarray:
    """Class of every byte: 0 white space, 1 word, and 2 punctuation where that is to stand apart."""
    table = np.ones(256, np.uint8)
    table[list(SPACES)] = 0
    if punctuation:
        for c in range(33, 127):
            if not chr(c).isalnum() and c != 95:
                table[c] = 2
    return table


_WORDS, _WORDPUNCT = classes(False), classes(True)


def tokens(data: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each. With `punctuation`, runs of it are tokens of their own."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    kind = (_WORDPUNCT if punctuation else _WORDS)[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` successive tokens inside one row, and the index of the first token of each."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, _ = powers(width)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k:k + n] * up[k]
    inside = np.flatnonzero(rows[:n] == rows[width - 1:])
    return mix(out[inside]), inside


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of `width` words with the row of each; a row with fewer words has one shingle of all its words, and a row
    without words has none."""
    values, first = windows(hashes, rows, width)
    at = rows[first]
    count = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(rows, short)
        up, _ = powers(width)
        whole = np.array([mix((hashes[b:b + count[r]] * up[:count[r]]).sum(dtype=np.uint64, keepdims=True))[0]
                          for b, r in zip(begin, short)], np.uint64)
        values, at = np.concatenate([values, whole]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        values, at = values[order], at[order]
    return values, at


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes as code points, with the offsets of the rows in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    return points, begins[offsets]
