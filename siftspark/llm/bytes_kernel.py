"""Vectorised work on the bytes of a batch of texts (Python workers).

Hashes are taken of 8-byte words, each mixed before anything is added, so that
no arrangement of bytes (repeats, swaps, Thue-Morse words) makes sums cancel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MULT = np.random.default_rng(20240131).integers(1, 2**62, 64, dtype=np.uint64) * _U(2) + _U(1)
LONG_WORD = 256


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, in which every bit depends on every other."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _loads(x: np.ndarray, order: str) -> np.ndarray:
    """A view of the eight bytes at every place of x; zeros after its end."""
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    return np.ndarray(len(x) + 1, f"{order}u8", padded, strides=(1,))


def words_at(x: np.ndarray) -> np.ndarray:
    """The eight bytes at every place of x as a number that orders like them."""
    return _loads(x, ">").astype(np.uint64)


def block_hashes(x: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of the size bytes (a multiple of 8) at each place of x that has so many."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = mixed(_loads(x, "<").astype(np.uint64) + _U(salt))
    out = np.zeros(n, np.uint64)
    for k in range(size // 8):
        out += words[8 * k : 8 * k + n] * _MULT[k]
    return mixed(out)


def string_hashes(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each x[begin:end]; strings beyond LONG_WORD bytes go through blake2b."""
    size = end - begin
    load = _loads(x, "<")
    h = mixed(size.astype(np.uint64) * _MULT[0])
    left = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(left):
        rest = np.minimum(size[left] - at, 8)
        word = load[begin[left] + at].astype(np.uint64)
        word = np.where(rest < 8, word & ((_U(1) << (np.minimum(rest, 7).astype(np.uint64) * _U(8))) - _U(1)), word)
        h[left] = mixed((h[left] ^ mixed(word + _MULT[1])) * _MULT[2])
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(x[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def prefix(a: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... elements, modulo 2**64."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a, out=out[1:])
    return out


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers of them, and so on for each."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)


def parts(offsets: np.ndarray, chunk: int):
    """Runs of rows [a, b) whose bytes come to about chunk; a longer row is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + chunk, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def sliding_min(a: np.ndarray, q: int) -> np.ndarray:
    """The least of every q neighbours: blockwise prefix and suffix minima."""
    n = len(a) - q + 1
    if n <= 0:
        return a[:0]
    rows = -(-len(a) // q)
    full = np.full(rows * q, np.iinfo(a.dtype).max, a.dtype)
    full[: len(a)] = a
    full = full.reshape(rows, q)
    pre = np.minimum.accumulate(full, axis=1).ravel()
    suf = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[:n], pre[q - 1 : q - 1 + n])


def pieces(offsets: np.ndarray, chunk: int, overlap: int):
    """(rows, first byte, last byte, where each row starts, from the first byte) of about chunk bytes; long rows come in pieces that overlap."""
    for a, b in parts(offsets, chunk):
        begin, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - begin <= chunk + overlap:
            yield np.arange(a, b), begin, end, offsets[a:b] - begin
        else:
            for s in range(begin, end - overlap, chunk):
                yield np.array([a]), s, min(s + chunk + overlap, end), np.zeros(1, np.int64)


def cuts(x: np.ndarray, chunk: int, inside: np.ndarray):
    """Pieces [a, b) of x of about chunk bytes, or more where a word (bytes for which inside holds) would be cut."""
    a = 0
    while a < len(x):
        b = min(a + chunk, len(x))
        while b < len(x) and inside[x[b - 1]] and inside[x[b]]:
            more = np.flatnonzero(~inside[x[b : b + 4096]])
            b = b + int(more[0]) if len(more) else min(b + 4096, len(x))
        yield a, b
        a = b
