"""Semi-global alignment with affine gaps in numpy, a row of a batch at a time.

Rows are read bases, columns reference bases. Each cell reads only earlier rows, so a row is
computed for all columns and all reads of a batch at once: the best gap along the reference
is a running maximum over the row above, the best gap along the read one per column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import Settings
from ..functions.seq import HOMOPOLYMER_SHARES

LOW = np.int32(-(2**30))
#: Cells that reads of one length fill together when adapters are looked for.
TRIM_CELLS = 1_000_000
DIAGONAL, SKIP_REF, SKIP_READ, BEGIN, RUN_REF, RUN_READ = range(6)
_CODES = np.full(256, 4, dtype=np.int8)
for _k, _b in enumerate(b"ACGT"):
    _CODES[_b] = _k
_EITHER_CASE = _CODES.copy()
for _k, _b in enumerate(b"acgt"):
    _EITHER_CASE[_b] = _k


def letter_codes(letters: np.ndarray, either_case: bool = True) -> np.ndarray:
    """Codes of letters, 4 for all but A, C, G, T."""
    return (_EITHER_CASE if either_case else _CODES)[letters]


def codes(seq: str) -> np.ndarray:
    return _CODES[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)]


def letters_of(seqs: list[str]) -> np.ndarray:
    """The letters of sequences of one length, a row each."""
    return np.stack([np.frombuffer(x.encode("latin-1", "replace"), dtype=np.uint8) for x in seqs])


def runs_of(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the homopolymer run around each letter of each row."""
    count, size = letters.shape
    if not size:
        return np.zeros((count, 0), dtype=int), np.zeros((count, 0), dtype=int)
    new = np.ones((count, size), dtype=bool)
    new[:, 1:] = letters[:, 1:] != letters[:, :-1]
    start = np.maximum.accumulate(np.where(new, np.arange(size), 0), axis=1)
    number = start + np.arange(count)[:, None] * size
    return start, np.bincount(number.reshape(-1), minlength=count * size)[number]


def runs(seq: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the homopolymer run around each base."""
    start, size = runs_of(letters_of([seq]))
    return start[0], size[0]


def row_depth(row: int, length: int, depth: int = 15) -> int:
    if row < depth:
        return row
    after = length - row - 1
    return 2 * depth - after if after < depth else depth


@dataclass
class Filled:
    """Scores of all rows and the kind of each cell's best step.

    Where a gap began is not stored for each cell; a trace looks it up for the few it passes.
    ``source`` has it for gaps within homopolymers.
    """

    scores: np.ndarray
    step: np.ndarray
    allowed: np.ndarray
    extend: int
    source: np.ndarray | None = None


def fill(ref: np.ndarray, reads: np.ndarray, matrix: np.ndarray, settings: Settings = Settings(), mask: np.ndarray | None = None, pay_5: bool = True, ref_seq: str | np.ndarray | None = None, read_seqs: list[str] | None = None) -> Filled:
    """Align reads (B x L codes) to a reference (C codes, or B x C).

    ``mask`` (B x C) tells which columns may be used. With ``ref_seq`` (the letters of one
    reference, or B x C of them) and ``read_seqs`` gaps within homopolymers have their discount.
    """
    count, rows = reads.shape
    ref = np.ascontiguousarray(np.broadcast_to(ref, (count, ref.shape[-1])), dtype=np.int32)
    cols = ref.shape[1]
    gop, gep = settings.gap_open, settings.gap_extend
    at = np.arange(cols, dtype=np.int32)
    extend = gep * at
    scores = np.full((rows, count, cols), LOW, dtype=np.int32)
    step = np.zeros((rows, count, cols), dtype=np.int8)
    # A cell of a matrix lies at five times the reference base plus the read base.
    cells, reads, flat = ref * 5, reads.astype(np.int32), matrix.astype(np.int32).reshape(len(matrix), 25)
    first = flat[0].take(cells + reads[:, :1])
    scores[0] = first if mask is None else np.where(mask, first, LOW)
    step[0] = BEGIN
    best_row = np.full((count, cols), LOW, dtype=np.int32)
    hp = ref_seq is not None and read_seqs is not None
    source = np.zeros((rows, count, cols), dtype=np.int32) if hp else None
    if hp:
        col_run = np.broadcast_to(runs_of(letters_of([ref_seq]) if isinstance(ref_seq, str) else ref_seq)[0], (count, cols))
        read_runs = runs_of(letters_of(read_seqs))
    allowed = np.zeros((count, cols), dtype=bool)
    allowed[:, : max(cols - 2, 0)] = True if mask is None else mask[:, 2:]
    allowed[:, 0] = True
    pick = np.empty((count, cols), dtype=np.int32)
    for r in range(1, rows):
        above, kind = scores[r - 1], step[r]
        base = flat[row_depth(r, rows, settings.pssm_depth)].take(cells + reads[:, r : r + 1])
        pick[:, 0], pick[:, 1:] = LOW, above[:, :-1]
        # The best gap along the reference: a running maximum of score + extension.
        value = np.where(allowed, above + extend, LOW)
        np.maximum.accumulate(value, axis=1, out=value)
        along = value[:, :-2] - (gop + extend[1:-1])
        np.copyto(kind[:, 2:], SKIP_REF, where=along > pick[:, 2:])
        np.maximum(pick[:, 2:], along, out=pick[:, 2:])
        # The best gap along the read, per column.
        if r >= 2:
            np.maximum(best_row, scores[r - 2] + gep * (r - 2), out=best_row)
            along = best_row[:, :-1] - (gop + gep * (r - 1))
            np.copyto(kind[:, 1:], SKIP_READ, where=along > pick[:, 1:])
            np.maximum(pick[:, 1:], along, out=pick[:, 1:])
        if hp:
            for value, name, place in _homopolymer(r, scores, col_run, read_runs, reads, ref, at, settings):
                more = value > pick
                np.copyto(kind, name, where=more)
                np.copyto(source[r], place, where=more, casting="same_kind")
                np.maximum(pick, value, out=pick)
        begin = -(gop + gep * (r + 1)) if pay_5 else 0
        fresh = begin > pick
        total = np.where(fresh, np.int32(begin), base + pick)
        np.copyto(kind, BEGIN, where=fresh)
        total[:, 0], kind[:, 0] = base[:, 0] - (gop + gep * (r + 1) if pay_5 else 0), BEGIN
        np.maximum(total, LOW, out=total)
        scores[r] = total if mask is None else np.where(mask, total, LOW)
    return Filled(scores, step, allowed, gep, source)


def _homopolymer(r: int, scores: np.ndarray, col_run: np.ndarray, read_runs: tuple[np.ndarray, np.ndarray], reads: np.ndarray, ref: np.ndarray, at: np.ndarray, settings: Settings) -> list:
    """Discounted gaps: over the start of a reference run, and over the start of a read run.

    Where a gap comes from is a column of its own for each cell, or a row for each read, so
    the scores there are gathered by index.
    """
    start, length = read_runs[0][:, r], read_runs[1][:, r]
    shares = np.asarray([int(settings.gap_open * s) for s in HOMOPOLYMER_SHARES])
    penalty = settings.gap_extend * (at - col_run) + shares[np.minimum(length, len(shares)) - 1][:, None]
    same = ref == reads[:, r : r + 1]
    back = np.maximum(col_run - 1, 0)
    use = same & (start == r)[:, None] & (col_run != at) & (col_run > 0)
    over_ref = np.where(use, np.take_along_axis(scores[r - 1], back, axis=1) - penalty, LOW)
    row = np.where((start > 0) & (start != r), start - 1, 0)
    before = np.full(ref.shape, LOW, dtype=np.int64)
    before[:, 1:] = scores[row, np.arange(len(row)), :-1]
    use = same & ((start > 0) & (start != r))[:, None] & (col_run == at) & (at > 0)
    over_read = np.where(use, before - penalty, LOW)
    return [(over_ref.astype(np.int32), RUN_REF, back), (over_read.astype(np.int32), RUN_READ, np.broadcast_to(row[:, None], ref.shape))]


@dataclass
class Placed:
    """An alignment: cells (row, column) that pair bases, in order, and its score."""

    score: int
    rows: np.ndarray
    cols: np.ndarray


def trace(filled: Filled, read: int, row: int, col: int) -> Placed:
    scores, step, extend = filled.scores[:, read], filled.step[:, read], filled.extend
    score = int(scores[row, col])
    rows, cols = [row], [col]
    while row > 0 and (kind := step[row, col]) != BEGIN:
        if kind == DIAGONAL:
            row, col = row - 1, col - 1
        elif kind == SKIP_REF:
            # The least column of the greatest score + extension, as the running maximum kept it.
            value = np.where(filled.allowed[read, : col - 1], scores[row - 1, : col - 1] + extend * np.arange(col - 1), 2 * int(LOW))
            row, col = row - 1, int(np.argmax(value))
        elif kind == SKIP_READ:
            row, col = int(np.argmax(scores[: row - 1, col - 1] + extend * np.arange(row - 1))), col - 1
        else:
            arg = int(filled.source[row, read, col])
            row, col = (row - 1, arg) if kind == RUN_REF else (arg, col - 1)
        rows.append(row)
        cols.append(col)
    return Placed(score, np.asarray(rows[::-1]), np.asarray(cols[::-1]))


def best_ends(filled: Filled) -> tuple[np.ndarray, np.ndarray]:
    """The best score of the last row and its earliest column, for each read."""
    last = filled.scores[-1]
    col = np.argmax(last, axis=1)
    return last[np.arange(len(col)), col], col


def place(read: str, placed: Placed) -> tuple[int, int, str, dict[int, str]]:
    """First and last column, the read along the columns ('-' for skipped), and insertions.

    An insertion stands at the column that follows it.
    """
    first, last = int(placed.cols[0]), int(placed.cols[-1])
    out = ["-"] * (last - first + 1)
    inserts: dict[int, str] = {}
    for k, (r, c) in enumerate(zip(placed.rows.tolist(), placed.cols.tolist(), strict=True)):
        out[c - first] = read[r]
        if k and r - placed.rows[k - 1] > 1:
            inserts[c] = read[placed.rows[k - 1] + 1 : r]
    return first, last, "".join(out), inserts


def mirror(first: int, last: int, seq: str, inserts: dict[int, str], length: int, flip) -> tuple[int, int, str, dict[int, str]]:
    """The same placement seen from the other strand of a reference of ``length`` (before wrapping)."""
    start = length - (last % length) - 1
    end = start + last - first
    return start, end, flip(seq), {start + last - p + 1: flip(x) for p, x in inserts.items()}


def trim_points(reads: list[str], adapter: str, matrix: np.ndarray, settings: Settings = Settings()) -> list[int | None]:
    """For each read the last base before the adapter, -1 if all is adapter, or None if there is no adapter.

    Reads of one length share a call of :func:`fill`.
    """
    out: list[int | None] = [None] * len(reads)
    if not adapter:
        return out
    groups: dict[int, list[int]] = {}
    for k, read in enumerate(reads):
        if read:
            groups.setdefault(len(read), []).append(k)
    rows = codes(adapter)
    depths = [row_depth(r, len(rows), settings.pssm_depth) for r in range(len(rows))]
    most = matrix[depths, :, rows].max(axis=1)
    for size, all_ in groups.items():
        # A read that ends with all of the adapter at the best score of each letter needs no fill: no gap and no other row can score as much.
        if size >= len(rows) and most.min() > 0 and min(settings.gap_open, settings.gap_extend) >= 0:
            tails = np.stack([codes(reads[k][-len(rows) :]) for k in all_])
            ends = (matrix[depths, tails, rows] == most).all(axis=1)
            if most.sum() >= min(settings.trim_score, len(rows) * settings.flat_match):
                for k in np.asarray(all_)[ends].tolist():
                    out[k] = size - len(rows) - 1
                all_ = np.asarray(all_)[~ends].tolist()
        step = max(1, TRIM_CELLS // (size * len(rows)))
        for first in range(0, len(all_), step):
            part = all_[first : first + step]
            filled = fill(np.stack([codes(reads[k]) for k in part]), np.broadcast_to(rows, (len(part), len(rows))), matrix, settings, pay_5=True)
            for b, k in enumerate(part):
                row = int(np.argmax(filled.scores[:, b, -1]))
                found = trace(filled, b, row, size - 1)
                if found.score >= settings.trim_score or found.score >= (row - found.rows[0] + 1) * settings.flat_match:
                    out[k] = int(found.cols[0]) - 1
    return out


def trim_point(read: str, adapter: str, matrix: np.ndarray, settings: Settings = Settings()) -> int | None:
    return trim_points([read], adapter, matrix, settings)[0]


def classes(seq: str, inserts: dict[int, str], start: int, before: int = 0, total: int | None = None, depth: int = 15) -> list[int]:
    """Matrix class of each placed position, by read bases from either end; inserted bases count first."""
    own = sum(c != "-" for c in seq)
    total = own + sum(len(x) for x in inserts.values()) if total is None else total
    out, seen = [], before
    for k, c in enumerate(seq):
        seen += len(inserts.get(start + k, ""))
        after = total - seen - 1
        out.append(seen if seen <= depth else 2 * depth - after if after < depth else depth)
        seen += c != "-"
    return out


def split_at(start: int, end: int, seq: str, inserts: dict[int, str], length: int) -> list[tuple[str, int, int, str, dict[int, str]]]:
    """Segments of a placement on a circular reference: whole ('a'), or front 'f' and back 'b'."""
    if start >= length:
        start, end, inserts = start - length, end - length, {p - length: x for p, x in inserts.items()}
    if end < length:
        return [("a", start, end, seq, inserts)]
    cut = length - start
    front = ("f", start, length - 1, seq[:cut], {p: x for p, x in inserts.items() if p < length})
    back = ("b", 0, end - length, seq[cut:], {p - length: x for p, x in inserts.items() if p >= length})
    return [front, back]
