"""Words of many texts at once: their places and hashes, computed over the bytes of a whole Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that end a word of the plain kind: space and the controls 9 to 13. Fixed values.
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

PLAIN = np.ones(256, dtype=bool)
PLAIN[list(SPACE)] = False

#: Letters, digits, and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x80:] = True
for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
    LETTERS[ord(first) : ord(last) + 1] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that are hashed at once, and so the length of the tables of powers.
STRETCH = 1 << 20


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the places where its values begin, with the end."""
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary()).cast(pa.binary()) if pa.types.is_binary_view(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.empty(0, np.uint8)
    return data, ends - ends[0]


def spans(data: np.ndarray, begins: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the first word of each text, with the end): words are runs of bytes in ``inside`` within a text."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(begins), np.int64)
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, begins)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INVERSE)):
            with np.errstate(over="ignore"):
                _powers[i] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, p, np.uint64))))
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + STRETCH, side="right")))
        n = int(ends[j - 1] - low)
        power, inverse = _tables(n + 1)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum((data[low : low + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mixed((total[b] - total[a]) * inverse[a] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes; run i begins at word i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for d in range(k):
            out = out * _P + h[d : d + n]
    return mixed(out)
