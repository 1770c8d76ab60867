"""Bytes, words and hashes of many texts at once, for tasks that read Arrow batches.

A *block* is a run of whole texts laid end to end as bytes. Hashes are prefix polynomials modulo 2**64 over a random byte
table: ``h(i, j) = (P[j] - P[i]) * base**-i`` gives the hash of any substring from two look-ups. Hashes choose what is
compared; where a result depends on equality of texts, either the bytes are compared as well or 128 bits are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that a task holds as one block; one longer text is a block of its own.
BLOCK = 1 << 19


def byte_table(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random odd 64-bit value per byte; with ``fold_case`` A-Z have those of a-z."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    if fold_case:
        table[65:91] = table[97:123]
    return table


#: Bytes of words: digits, letters and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
#: Bytes that are not white space.
DARK = np.ones(256, bool)
DARK[9:14] = DARK[32] = False
EXACT, FOLDED, SECOND = byte_table(1), byte_table(2, True), byte_table(3, True)

_POWERS: dict[U, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 2), base, U)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefixes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix polynomials, one more than there are bytes."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; the length is part of it."""
    inverse = powers(INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        column = column.cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) of runs of whole texts of about ``size`` bytes; every row is in one run."""
    data, offsets = column_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield slice(first, last), data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words; a word does not go on into the next text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the rows of each text in a sorted column of text numbers."""
    return np.searchsorted(values, np.arange(n + 1))


def shingles(word_hash: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and their text numbers; a shorter text, if not empty, is one shingle."""
    counts = np.bincount(text, minlength=n_texts)
    total = len(word_hash)
    at = np.concatenate([[0], np.cumsum(counts)])
    out, owner = [], []
    if total >= width:
        weight = powers(BASE, width)
        whole = np.zeros(total - width + 1, U)
        for j in range(width):
            whole += word_hash[j:total - width + 1 + j] * weight[j]
        keep = text[:total - width + 1] == text[width - 1:]
        out.append(mix(whole[keep]))
        owner.append(text[:total - width + 1][keep])
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        part = word_hash[at[t]:at[t + 1]]
        out.append(mix(np.sum(part * powers(BASE, len(part)), dtype=U, keepdims=True) + U(len(part))))
        owner.append(np.array([t]))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h, o = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return h[order], o[order]
