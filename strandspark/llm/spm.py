"""SentencePiece encoding and decoding in batched numpy.

A model file is read directly. Text is cut into units that no piece crosses: a run of space
marks with the characters up to the next mark. Distinct units of equal length advance
together: hashes of all their substrings are probed in the sorted hashes of the pieces,
which gives a table of pieces by start and end.

Unigram models: a Viterbi pass over ends takes the best start by a vectorised maximum and
stores it as a backpointer. BPE models: the score of a piece is its merge rank, not a log
probability, so the best path through scores is not what the model means. There the units
of one length merge together instead, each round the best pair of every unit by a vectorised
maximum over the same table, leftmost on ties. That takes a round for each merge, so a long
unit (a text without spaces) is merged by itself from a heap of pairs instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import U, mix

MARK = "\u2581"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct units that a worker remembers; beyond it the memory starts anew.
MEMORY = 400_000
#: Cells of a table of substrings that advance together.
CELLS = 1 << 21
#: Longer units are cut by themselves and not remembered.
LONG = 64
_FACTOR = 0x9DDFEA08EB382D69


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


@dataclass
class Pieces:
    """A vocabulary: ``texts``, ``scores`` and ``kinds`` by id, and the model's settings."""

    texts: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model_type: int = UNIGRAM
    dummy_prefix: bool = True
    trim_spaces: bool = False
    memory: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        usable = np.flatnonzero(np.isin(self.kinds, (NORMAL, USER_DEFINED)))
        keys = np.asarray([_hash_text(self.texts[i]) for i in usable], dtype=U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], usable[order]
        #: Marks the low bits of the keys, so that few substrings need a search.
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(self.keys & U((1 << 22) - 1)).astype(np.int64)] = True
        self.longest = max((len(self.texts[i]) for i in usable), default=1)
        self.least = float(self.scores[usable].min()) if len(usable) else 0.0
        #: Score and id of each usable piece, for long units.
        self.ranks = {self.texts[i]: (float(self.scores[i]), int(i)) for i in usable}
        self.byte_ids = np.full(256, -1)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.texts[i][3:5], 16)] = i
        self.unknown = next(iter(np.flatnonzero(self.kinds == UNKNOWN)), 0)
        raw = [b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else (" \u2047 " if k == UNKNOWN else t).encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        #: Bytes of all pieces side by side, for decoding.
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        inner = any(MARK in t.lstrip(MARK) for t in (self.texts[i] for i in usable))
        if inner:
            raise ValueError("a piece crosses a space mark; units would not be independent")

    @classmethod
    def read(cls, data: bytes) -> Pieces:
        texts, scores, kinds, out = [], [], [], {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                out["model_type"] = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(1, b"").decode() not in ("", "identity") or spec.get(2):
                    raise ValueError("only models that leave characters as they are can be used")
                out["dummy_prefix"], out["trim_spaces"] = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return cls(texts, np.asarray(scores, dtype=np.float64), np.asarray(kinds), **out)


#: Setting of a session that names the model file of the tokenizer, and where it lies unless set.
TOKENIZER_SETTING = "spark.strandspark.tokenizer"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def model_of(spark: SparkSession) -> bytes:
    """The model that the session names; a file of fixed size that the driver reads."""
    return Path(spark.conf.get(TOKENIZER_SETTING, TOKENIZER)).read_bytes()


@lru_cache(maxsize=2)
def load(data: bytes) -> Pieces:
    return Pieces.read(data)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U)


def _hash_text(text: str) -> int:
    value = U(0)
    for c in _codes(text):
        value = U((int(value) * _FACTOR + int(c) + 1) & (2**64 - 1))
    return int(mix(np.asarray([value + U(len(text))], dtype=U))[0])


def piece_table(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """table[w, s, n]: id of the piece that begins at s and has n + 1 characters, or -1."""
    count, size = codes.shape
    width = min(size, pieces.longest)
    table = np.full((count, size, width), -1, dtype=np.int32)
    value = np.zeros((count, size), dtype=U)
    for n in range(width):
        left = size - n
        value = value[:, :left] * U(_FACTOR) + codes[:, n : n + left] + U(1)
        key = mix(value + U(n + 1))
        row, start = np.nonzero(pieces.sieve[(key & U((1 << 22) - 1)).astype(np.int64)])
        key = key[row, start]
        at = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
        table[row, start, n] = np.where(pieces.keys[at] == key, pieces.ids[at], -1)
    return table


def viterbi(table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """starts[w, e]: where the last piece of the best path to e begins, by summed scores.

    A single character without a piece costs the least score less ten, as an unknown. Of
    equal paths the one with the earlier start, hence the longer last piece, wins.
    """
    count, size, width = table.shape
    penalty = pieces.scores[np.isin(pieces.kinds, (NORMAL, USER_DEFINED))].min() - 10.0
    best = np.full((count, size + 1), -np.inf)
    best[:, 0] = 0.0
    back = np.zeros((count, size + 1), dtype=np.int32)
    for e in range(1, size + 1):
        lengths = np.arange(min(e, width), 0, -1)
        ids = table[:, e - lengths, lengths - 1]
        cost = np.where(ids >= 0, pieces.scores[ids], np.where(lengths == 1, penalty, -np.inf))
        total = best[:, e - lengths] + cost
        pick = np.argmax(total, axis=1)
        best[:, e] = total[np.arange(count), pick]
        back[:, e] = e - lengths[pick]
    return back


def _cuts_by_path(table: np.ndarray, pieces: Pieces) -> np.ndarray:
    back = viterbi(table, pieces)
    count, size, _ = table.shape
    cuts = np.zeros((count, size + 1), dtype=bool)
    at = np.full(count, size)
    rows = np.arange(count)
    while (at > 0).any():
        cuts[rows, at] = True
        at = np.where(at > 0, back[rows, at], 0)
    cuts[:, 0] = True
    return cuts


def _cuts_by_merges(table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Borders of symbols after all merges; cuts[w, p] is true where a symbol begins (or the end)."""
    count, size, width = table.shape
    flat = table.reshape(count, size * width)
    starts = np.tile(np.arange(size + 1), (count, 1))
    number = np.full(count, size)
    rows = np.arange(count)
    active = rows[number > 1]
    while len(active):
        top = int(number[active].max())
        at = starts[active, : top + 1]
        span = at[:, 2:] - at[:, :-2]
        inside = (np.arange(top - 1) < number[active][:, None] - 1) & (span <= width)
        cell = np.where(inside, at[:, :-2] * width + span - 1, 0)
        ids = np.where(inside, np.take_along_axis(flat[active], cell, axis=1), -1)
        score = np.where(ids >= 0, pieces.scores[ids], -np.inf)
        pick = np.argmax(score, axis=1)
        found = score[np.arange(len(active)), pick] > -np.inf
        active, pick = active[found], pick[found]
        if not len(active):
            break
        moved = starts[active]
        where = np.arange(size + 1)[None, :]
        source = np.minimum(where + (where > pick[:, None]), size)
        starts[active] = np.take_along_axis(moved, source, axis=1)
        number[active] -= 1
        active = active[number[active] > 1]
    cuts = np.zeros((count, size + 1), dtype=bool)
    cuts[np.repeat(rows, size + 1), np.where(np.arange(size + 1) <= number[:, None], starts, 0).ravel()] = True
    return cuts


def _encode_units(units: list[str], pieces: Pieces) -> None:
    """Fill ``pieces.memory`` for units that it lacks, equal lengths together."""
    by_length: dict[int, list[str]] = {}
    for unit in units:
        if len(unit) > LONG:
            cut = _long_path if pieces.model_type == UNIGRAM else _long_merges
            starts, ids = cut(unit, pieces)
            pieces.memory[unit] = _with_bytes(unit, starts, ids, pieces) if (ids < 0).any() else ids
        else:
            by_length.setdefault(len(unit), []).append(unit)
    split = _cuts_by_path if pieces.model_type == UNIGRAM else _cuts_by_merges
    for size, same in by_length.items():
        step = max(1, CELLS // (size * min(size, pieces.longest)))
        for k in range(0, len(same), step):
            part = same[k : k + step]
            table = piece_table(_codes("".join(part)).reshape(len(part), size), pieces)
            _remember(part, table, split(table, pieces), pieces)


def _remember(units: list[str], table: np.ndarray, cuts: np.ndarray, pieces: Pieces) -> None:
    row, at = np.nonzero(cuts)
    inner = row[1:] == row[:-1]
    row, start, size = row[:-1][inner], at[:-1][inner], np.diff(at)[inner]
    ids = table[row, start, size - 1]
    bounds = np.searchsorted(row, np.arange(len(units) + 1))
    strange = set(row[ids < 0].tolist())
    for k, unit in enumerate(units):
        a, b = bounds[k], bounds[k + 1]
        got = ids[a:b]
        pieces.memory[unit] = _with_bytes(unit, start[a:b], got, pieces) if k in strange else got


def _with_bytes(unit: str, starts: np.ndarray, ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Ids with byte pieces, or the unknown piece, for single characters that have none."""
    out: list[int] = []
    for at, known in zip(starts.tolist(), ids.tolist(), strict=True):
        if known >= 0:
            out.append(known)
        elif pieces.byte_ids[0] >= 0:
            out += [int(pieces.byte_ids[x]) for x in unit[at].encode("utf-8", "surrogatepass")]
        elif not out or out[-1] != pieces.unknown:
            out.append(int(pieces.unknown))
    return np.asarray(out, dtype=np.int32)


def _long_merges(unit: str, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids) of a BPE unit: pairs wait in a heap by score, then place.

    Symbols are linked by their starts. A pair in the heap is stale when one of its symbols
    has merged since; its end tells. Time is n log n, memory a few numbers a character.
    """
    known, n = pieces.ranks, len(unit)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    longest = pieces.longest
    heap: list[tuple[float, int, int, int]] = []

    def pair(a: int, b: int) -> None:
        end = after[b]
        if end - a <= longest and (found := known.get(unit[a:end])) is not None:
            heapq.heappush(heap, (-found[0], a, b, end))

    for a in range(n - 1):
        pair(a, a + 1)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if not alive[a] or not alive[b] or after[a] != b or after[b] != end:
            continue
        alive[b], after[a] = False, end
        if end < n:
            before[end] = a
            pair(a, end)
        if before[a] >= 0:
            pair(before[a], a)
    starts = [a for a in range(n) if alive[a]]
    ids = [known.get(unit[a : after[a]], (0.0, -1))[1] for a in starts]
    return np.asarray(starts, dtype=np.int64), np.asarray(ids, dtype=np.int32)


def _long_path(unit: str, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids) of a unigram unit by the same Viterbi pass, a character at a time."""
    known, n = pieces.ranks, len(unit)
    penalty = pieces.least - 10.0
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    for e in range(1, n + 1):
        top, at = best[e - 1] + penalty, e - 1
        for s in range(e - 1, max(e - pieces.longest, 0) - 1, -1):
            if (found := known.get(unit[s:e])) is not None:
                total = best[s] + found[0]
                if total >= top or (s == e - 1):
                    top, at = total, s
        best[e], back[e] = top, at
    starts, e = [], n
    while e > 0:
        e = back[e]
        starts.append(e)
    starts.reverse()
    ends = [*starts[1:], n]
    ids = [known.get(unit[a:b], (0.0, -1))[1] for a, b in zip(starts, ends, strict=True)]
    return np.asarray(starts, dtype=np.int64), np.asarray(ids, dtype=np.int32)


def encode(texts: pa.Array, pieces: Pieces) -> pa.Array:
    """Lists of ids for an array of texts; null and empty texts have none."""
    texts = pc.fill_null(texts, "")
    if pieces.trim_spaces:
        texts = pc.replace_substring_regex(pc.utf8_trim(texts, " "), " +", " ")
    marked = pc.replace_substring(texts, " ", MARK)
    if pieces.dummy_prefix:
        marked = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(MARK, marked, ""))
    # A unit begins where a mark follows another character.
    lists = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{MARK}])({MARK})", "\\1\x00\\2"), "\x00") if not _has_zero(marked) else _split_slowly(marked)
    flat = lists.flatten().dictionary_encode()
    units = flat.dictionary.to_pylist()
    if len(pieces.memory) > MEMORY:
        pieces.memory.clear()
    fresh = [u for u in units if u and u not in pieces.memory]
    _encode_units(fresh, pieces)
    got = [pieces.memory[u] if u else np.zeros(0, dtype=np.int32) for u in units]
    for u in fresh:
        if len(u) > LONG:
            del pieces.memory[u]
    sizes = np.asarray([len(g) for g in got], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    pool = np.concatenate(got) if got else np.zeros(0, dtype=np.int32)
    use = flat.indices.to_numpy()
    total = sizes[use]
    ends = np.cumsum(total)
    ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[use] - (ends - total), total)]
    bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _has_zero(marked: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring(marked, "\x00")).as_py())


def _split_slowly(marked: pa.Array) -> pa.Array:
    """Units of texts that hold the character which otherwise separates units."""
    out = []
    for text in marked.to_pylist():
        units, start = [], 0
        for k in range(1, len(text)):
            if text[k] == MARK and text[k - 1] != MARK:
                units.append(text[start:k])
                start = k
        out.append([*units, text[start:]])
    return pa.array(out, pa.list_(pa.string()))


def decode(ids: pa.Array, pieces: Pieces) -> pa.Array:
    """Texts for lists of ids: pieces, byte pieces as UTF-8 (bad bytes replaced), marks as spaces.

    The bytes of all ids of all rows are gathered at once from the pieces side by side.
    """
    ids = ids.cast(pa.large_list(pa.int32()))
    bounds = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.to_numpy()[bounds[0] : bounds[-1]]
    sizes = pieces.raw_at[flat + 1] - pieces.raw_at[flat]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = int(ends[-1])
    source = np.arange(total) + np.repeat(pieces.raw_at[flat] - ends[:-1], sizes)
    data = pieces.raw[source].tobytes()
    cuts = ends[bounds - bounds[0]].tolist()
    mark, out = MARK.encode(), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if pieces.dummy_prefix and data.startswith(mark, a, b):
            a += len(mark)
        out.append(data[a:b].decode("utf-8", "replace").replace(MARK, " "))
    return pa.array(out, pa.string())


def encode_documents(documents: DataFrame, model: bytes, with_check: bool = True) -> DataFrame:
    """One row per row: ``doc_id``, ``token_ids``, ``n_tokens``, ``n_chars_decoded``, ``round_trip``.

    ``model`` is the content of a model file (a fixed size, sent with the task). Texts are
    encoded whole. Null and empty texts have no tokens, repeated rows are encoded alike, an
    empty table gives an empty result, and other columns are not carried, so their names
    cannot clash. A very long text costs time in proportion to its length, or n log n for
    each part of it without spaces. ``round_trip`` tells whether decoding gives the text
    back; it can only fail for texts that hold the space mark itself.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for whole in batches:
            for batch in _parts(whole):
                texts = batch.column(1)
                ids = encode(texts, pieces)
                back = decode(ids, pieces)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), ids, pc.cast(pc.list_value_length(ids), pa.int64()), pc.cast(pc.utf8_length(back), pa.int64()), pc.equal(back, pc.fill_null(texts, ""))],
                    ["doc_id", "token_ids", "n_tokens", "n_chars_decoded", "round_trip"],
                )

    kinds = "doc_id bigint, token_ids array<int>, n_tokens bigint, n_chars_decoded bigint, round_trip boolean"
    return documents.select(F.col("doc_id"), F.col("text")).mapInArrow(work, kinds)


def _parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
