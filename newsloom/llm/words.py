"""Words and word shingles of Arrow text batches as 64-bit hashes, for use inside tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. Hashes are polynomials over a table of random
byte values, finished by a multiply-xor mix, all modulo 2**64 and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once. Powers are made anew for each call, as tables of this module would travel with every task.
_PIECE = 1 << 18


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, dtype=np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 places where each begins and ends; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def word_spans(data: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of its first word (n + 1 values).

    space tells for each of the 256 byte values whether it parts words.
    """
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(space[data], out=inside[1:-1])
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    # A text border inside a run of letters parts two words.
    borders = ends[(ends > 0) & (ends < len(data))]
    cut = borders[inside[borders] & inside[borders + 1]]
    first[cut], last[cut] = True, True
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    return begin, end, np.searchsorted(begin, ends)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), dtype=np.uint64)
    size = min(_PIECE, len(data) + 1)
    power, back = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
    at = 0
    while at < len(begin):
        base = begin[at]
        upto = max(at + 1, int(np.searchsorted(end, base + _PIECE - 1, side="right")))
        if end[upto - 1] - base >= _PIECE:  # one word longer than a piece
            value = 0
            for k in range(base, end[at], _PIECE - 1):
                part = data[k : min(k + _PIECE - 1, end[at])]
                value = (value * _BASE + int((_BYTE[part] * power[: len(part)]).sum(dtype=np.uint64))) & (2**64 - 1)
            out[at] = value
        else:
            part = data[base : end[upto - 1]]
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * power[: len(part)], out=total[1:])
            b, e = begin[at:upto] - base, end[at:upto] - base
            out[at:upto] = (total[e] - total[b]) * back[b]
        at = upto
    return mix(out + (end - begin).astype(np.uint64))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within each, and the n + 1 places where each set begins and ends.

    A text of fewer words than size has its whole sequence as one shingle; one without words has none.
    """
    data, ends = text_bytes(texts)
    begin, end, first = word_spans(data, ends)
    words = word_hashes(data, begin, end)
    counts = np.diff(first)
    sets: list[np.ndarray] = []
    if len(words) >= size:
        rolled = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            rolled = mix(rolled * _U(0xD6E8FEB86659FD93) + words[k : len(words) - size + 1 + k])
    for k, n in enumerate(counts):
        if n >= size:
            sets.append(np.unique(rolled[first[k] : first[k] + n - size + 1]))
        elif n:
            value = np.full(1, n + 1000, dtype=np.uint64)
            for w in words[first[k] : first[k] + n]:
                value = mix(value * _U(0xD6E8FEB86659FD93) + w)
            sets.append(value)
        else:
            sets.append(np.zeros(0, np.uint64))
    where = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=where[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), where


def sliced(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """The batch in slices of about limit bytes of text at most, one text at least."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    at = 0
    while at < batch.num_rows:
        total, upto = 0, at
        while upto < batch.num_rows and (upto == at or total + sizes[upto] <= limit):
            total += sizes[upto]
            upto += 1
        yield batch.slice(at, upto - at)
        at = upto


def binaries(values: np.ndarray, where: np.ndarray) -> pa.Array:
    """Runs of fixed-width numbers as one binary value each."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(where) - 1, [None, pa.py_buffer((where * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
