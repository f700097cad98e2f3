"""Numpy text primitives for Python stages: word hashes of many texts at once, packed integer arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).view(U) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
SEGMENT = 1 << 20


def _powers(p: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, U), np.full(n - 1, p & (2**64 - 1), U))), dtype=U)


_POW: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Splitmix finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _words(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one segment; a text's first byte always begins a word."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if not _POW or len(_POW[0]) < n:
        _POW[:] = [_powers(_P, max(n, SEGMENT)), _powers(_PINV, max(n, SEGMENT))]
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    cut = starts_of_docs[starts_of_docs < n]
    begin[cut] = solid[cut]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | begin[1:]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    total = np.cumsum(_TABLE[data] * _POW[0][:n], dtype=U)
    before = np.where(s > 0, total[s - 1], U(0))
    return mix((total[e] - before) * _POW[1][s]), s


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets) for runs of rows: words of row first+i are hashes[offsets[i]:offsets[i+1]].

    A-Z count as a-z; words are runs of bytes other than \\x20 and \\x09-\\x0D; null counts as empty. A run is about a
    megabyte of text, or a single longer text, which is hashed in pieces cut between words.
    """
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SEGMENT, "right")) - 1)
        lo, hi = int(offs[i]), int(offs[j])
        hashes, firsts = [], []
        at = lo
        while at < hi:
            to = hi
            if hi - at > 2 * SEGMENT:  # one long text: cut after a blank
                to = at + SEGMENT
                while to < hi and not _SPACE[raw[to - 1]]:
                    to += 1
            h, s = _words(raw[at:to], offs[i:j] - at if at == lo else np.zeros(0, np.int64))
            hashes.append(h)
            firsts.append(s + at)
            at = to
        h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        s = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        yield i, h, np.searchsorted(s, offs[i:j + 1])
        i = j


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows; of the whole sequence when it has fewer words; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, U)
    for j in range(k):
        h = mix(h * U(0xD6E8FEB86659FD93) + words[j:n - k + 1 + j] + U(k - j))
    return np.unique(h if k == 5 else mix(h + U(k)))


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes: small or slowly growing values take little room."""
    a = np.ascontiguousarray(a)
    width = a.dtype.itemsize
    planes = a.view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    width, size = b[0], int.from_bytes(b[1:9], "little")
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(b[9:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()
