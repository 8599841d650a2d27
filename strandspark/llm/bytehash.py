"""Vectorised hashing of words and byte windows, for Arrow batches.

A polynomial over bytes modulo 2**64 with an odd base can be taken out of its prefix sums
for any range, because powers of the base have inverses. Bytes go through a table of random
words first and sums through a mixer afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Documents are hashed in groups of about so many bytes, which bounds the arrays of a step.
GROUP_BYTES = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER_TABLE = TABLE[_LOWER]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n, or of its inverse."""
    have = _powers.get(inverse)
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, 1 << 16), _INVERSE if inverse else _BASE, dtype=U)
        out[0] = 1
        _powers[inverse] = have = np.multiply.accumulate(out)
    return have[: n + 1]


def sums_of(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(len(values))[:-1], out=out[1:])
    return out


def prefix_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    return sums_of(table[data])


#: Low bits of a sort key that hold the place, the same for all texts, so that ties go to the first place everywhere.
_POS = 30


def anchor_spans(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Spans of a group of sequences of hashed symbols: row, first and last window, anchor's place, anchor hash, span hash.

    A window's anchor is the least hash of the runs of ``gram`` symbols in it, so equal windows
    have equal anchors at equal places; windows side by side with one anchor are a span.
    """
    none = np.zeros(0, dtype=np.int64)
    n = len(values)
    if n < window:
        return none, none, none, none, none.astype(U), none.astype(U)
    sums = sums_of(values)
    back = powers(n, True)
    grams = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    place = np.arange(len(grams), dtype=U)
    key = (grams >> U(_POS) << U(_POS)) | place
    need, have = window - gram + 1, 1
    least = key
    while have * 2 <= need:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < need:
        step = need - have
        least = np.minimum(least[:-step], least[step:])
    at = (least & U((1 << _POS) - 1)).astype(np.int64)
    starts = np.arange(len(at))
    row = np.searchsorted(offsets, starts, side="right") - 1
    valid = starts + window <= offsets[row + 1]
    starts, at, row = starts[valid], at[valid], row[valid]
    if not len(starts):
        return none, none, none, none, none.astype(U), none.astype(U)
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(starts)]]) - 1
    first, last, anchor, row = starts[head], starts[tail], at[head], row[head]
    end = last + window
    whole = mix(mix((sums[end] - sums[first]) * back[first]) + (anchor - first).astype(U) * U(0x9E3779B97F4A7C15) + (end - first).astype(U))
    base = offsets[row]
    return row, first - base, last - base, anchor - base, grams[anchor], whole


def groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows; null rows are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + GROUP_BYTES, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a group of texts, lower-cased in A-Z by the default table, and the row of each word."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    inside = ~IS_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    sums = prefix_sums(data, table)
    hashes = mix((sums[ends] - sums[starts]) * powers(n, True)[starts] + (ends - starts).astype(U))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of runs of ``width`` words, or of the whole row if it is shorter."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    odd = [U((0xD6E8FEB86659FD93 * (2 * k + 3)) & (2**64 - 1) | 1) for k in range(width)]
    n = max(len(words) - width + 1, 0)
    runs = np.zeros(n, dtype=U)
    for k in range(width):
        runs += mix(words[k : k + n] * odd[k])
    runs = mix(runs)
    out = []
    for r in range(n_rows):
        a, b = bounds[r], bounds[r + 1]
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            short = U(b - a)
            for k in range(b - a):
                short = mix(np.asarray([words[a + k]], dtype=U) * odd[k] + np.asarray([short], dtype=U))[0]
            out.append(np.asarray([short], dtype=U))
        else:
            out.append(np.zeros(0, dtype=U))
    return out
