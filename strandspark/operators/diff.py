"""Global alignment of two long similar sequences by furthest-reaching paths, IUPAC aware."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.seq import IUPAC_MASK

_BITS = np.zeros(256, dtype=np.uint8)
for _c, _m in IUPAC_MASK.items():
    _BITS[ord(_c)] = _BITS[ord(_c.lower())] = _m


#: Letters that a slide compares at once; signs without a base behind the ends of sequences stop it there.
_STEP = 64
#: Pairs that go through the wavefront together, and cells of its arrays that are compared at once.
PAIRS, _CELLS = 32, 1 << 15


def _padded(seqs: list[str]) -> np.ndarray:
    out = np.zeros((len(seqs), max(map(len, seqs)) + _STEP), dtype=np.uint8)
    for row, s in zip(out, seqs, strict=True):
        row[: len(s)] = _BITS[np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)]
    return out


def _slide(x: np.ndarray, y: np.ndarray, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far matches go on from (i, j) of each pair."""
    end, live, ahead = i.copy(), np.arange(len(i)), np.arange(_STEP)
    while len(live):
        more = []
        for part in (live[k : k + _CELLS] for k in range(0, len(live), _CELLS)):
            at, back = end[part, None] + ahead, (j - i)[part, None]
            bad = (x[pair[part, None], at] & y[pair[part, None], at + back]) == 0
            run = np.where(bad.any(axis=1), bad.argmax(axis=1), _STEP)
            end[part] += run
            more.append(part[run == _STEP])
        live = np.concatenate(more)
    return end


def align_pairs(pairs: list[tuple[str, str]], limits: list[int | None] | None = None) -> list[tuple[int, str, str] | None]:
    """For each pair (edit distance, gapped a, gapped b), or None if the distance is not below its limit.

    Symbols match when they share a base; a mismatch, an insertion and a deletion cost one.
    The default limit is a tenth of the longer sequence. All pairs take the same step of the
    furthest-reaching paths together, in arrays over pairs and diagonals, and leave when they
    are done. Time and memory of a pair follow the square of its distance, not its length.
    """
    out: list[tuple[int, str, str] | None] = [None] * len(pairs)
    for first in range(0, len(pairs), PAIRS):
        some = range(first, min(first + PAIRS, len(pairs)))
        bound = [max(map(len, pairs[k])) // 10 if limits is None or limits[k] is None else limits[k] for k in some]
        for k, reach in _wavefront([pairs[k] for k in some], bound):
            a, b = pairs[first + k]
            out[first + k] = (len(reach) - 1, *_back(a, b, reach))
    return out


def _wavefront(pairs: list[tuple[str, str]], limits: list[int]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(pair, its furthest cells by distance and diagonal) of the pairs that end below their limit; -1: no cell."""
    x, y = _padded([a for a, _ in pairs]), _padded([b for _, b in pairs])
    n, m = (np.asarray([len(p[side]) for p in pairs])[:, None] for side in (0, 1))
    limit, goal = np.asarray(limits), (n - m)[:, 0]
    live, reach = np.arange(len(pairs)), []
    for d in range(max(limits, default=0)):
        live = live[d < limit[live]]
        if not len(live):
            return
        k = np.arange(-d, d + 1)
        if d == 0:
            start = np.zeros((len(live), 1), dtype=np.int32)
        else:
            last = np.pad(reach[-1][live], ((0, 0), (2, 2)), constant_values=-1)
            options = np.stack([np.where(p >= 0, p + s, -1) for p, s in ((last[:, 1:-1], 1), (last[:, :-2], 1), (last[:, 2:], 0))])
            fits = (options >= 0) & (options <= n[live]) & (options - k >= 0) & (options - k <= m[live])
            start = np.where(fits, options, -1).max(axis=0)
        row, col = np.nonzero(start >= 0)
        i = start[row, col]
        now = np.full((len(pairs), 2 * d + 1), -1, dtype=np.int32)
        now[live[row], col] = _slide(x, y, live[row], i, i - k[col])
        reach.append(now)
        there = np.abs(goal[live]) <= d
        done = np.zeros(len(live), dtype=bool)
        done[there] = now[live[there], goal[live[there]] + d] == n[live[there], 0]
        for p in live[done]:
            yield int(p), [r[p] for r in reach]
        live = live[~done]


def align_pair(a: str, b: str, limit: int | None = None) -> tuple[int, str, str] | None:
    """:func:`align_pairs` of one pair."""
    return align_pairs([(a, b)], [limit])[0]


def _back(a: str, b: str, reach: list[np.ndarray]) -> tuple[str, str]:
    left, right = [], []
    i, k = len(a), len(a) - len(b)
    for d in range(len(reach) - 1, 0, -1):
        last = reach[d - 1]
        cells = [(int(last[q + d - 1]) + s, q, s, t) for q, s, t in ((k, 1, 1), (k - 1, 1, 0), (k + 1, 0, 1)) if abs(q) < d and last[q + d - 1] >= 0]
        start, q, s, t = max((c for c in cells if c[0] <= len(a) and 0 <= c[0] - k <= len(b)), key=lambda c: c[0])
        left.append(a[start:i][::-1])
        right.append(b[start - k : i - k][::-1])
        left.append(a[start - 1] if s else "-")
        right.append(b[start - k - 1] if t else "-")
        i, k = start - s, q
    left.append(a[:i][::-1])
    right.append(b[: i - k][::-1])
    return "".join(left)[::-1], "".join(right)[::-1]
