"""Removal of long repeated byte strings with a run-length index.

Every window of WINDOW bytes has an anchor, the least k-gram hash in it; equal windows have
equal anchors at equal places. The windows of one anchor lie side by side, so a text falls
into spans, one for each anchor occurrence, and each window belongs to one span. Equal spans
are one string with a weight. The strings of one anchor meet in a task, unless there is just
one and it occurs once, and there an index is built over them.

The index is built from the Burrows-Wheeler transform of the strings: where its runs begin and
end, the suffix array is sampled, with the longest matches with the lexicographic neighbours.
Along the text a match that is not at a run end is one byte shorter than the one before, so
matching statistics stream from the samples, and nothing else of the transform is kept. The
sort that finds the runs holds a block's suffixes in full. A string with a weight above one
also stands elsewhere, so its own rest is a match at each of its places. A window is repeated
when its statistic reaches WINDOW.

An anchor with more than GROUP_STRINGS strings would make an index that outgrows a task. Its
windows are hashed and counted instead, which is exact as well and can be dealt anyhow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import TABLE, anchor_spans, groups, mix, powers, prefix_sums
from .common import cut, shared_dir

WINDOW = 400
GRAM = 32
#: Strings of one anchor up to which its task builds an index; more go by hashes of windows.
GROUP_STRINGS = 2000
#: Bytes of whole groups that share an index.
INDEX_BYTES = 1 << 17
#: Tasks of the index for each shuffle partition.
INDEX_TASKS = 4
#: Bytes of a long text that are taken at once; pieces overlap by a window less a byte.
PIECE_BYTES = 1 << 22
#: Texts that are stripped at once.
_ROWS = 256


def window_anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """:func:`anchor_spans` of the bytes of a group of texts."""
    return anchor_spans(TABLE[data], offsets, window, gram)


_SPANS = "k1 bigint, k2 bigint, anchor bigint, span bigint, p0 int, p1 int"


def _pieces(data: np.ndarray, offsets: np.ndarray, window: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in the text, bytes, offsets): a group as it is, or a long text piece by piece."""
    if len(data) <= most or len(offsets) > 2:
        yield 0, data, offsets
        return
    for at in range(0, len(data) - window + 1, most):
        part = data[at : at + most + window - 1]
        yield at, part, np.asarray([0, len(part)])


def _spans(keyed: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, whole, bounds in groups(batch.column(2)):
                for at, data, offsets in _pieces(whole, bounds, window, most):
                    row, first, last, _, anchor, span = window_anchors(data, offsets, window, gram)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[start + row]), pa.array(k2[start + row]), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array((first + at).astype(np.int32)), pa.array((last + at).astype(np.int32))],
                        ["k1", "k2", "anchor", "span", "p0", "p1"],
                    )

    return keyed.select("k1", "k2", "body").mapInArrow(work, _SPANS)


class RunLengthIndex:
    """Samples of several strings' suffix array at the run ends of their Burrows-Wheeler transform.

    The suffixes of a block are sorted to find the runs; only the samples are kept.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, weights: list[int] | None = None) -> None:
        """``data`` are bytes of strings one after the other, ``offsets`` their bounds, ``weights`` how often they occur."""
        count = len(offsets) - 1
        sizes = np.diff(offsets)
        # Each string gets a closing sign of its own, greater than any byte.
        text = np.empty(len(data) + count, dtype=np.int64)
        ends = offsets[1:] + np.arange(count)
        inner = np.ones(len(text), dtype=bool)
        inner[ends] = False
        text[inner] = data
        text[ends] = 256 + np.arange(count)
        self.text, self.ends, self.sizes = text, ends, sizes
        self.starts = np.concatenate([[0], ends[:-1] + 1])
        order = self._sort()
        before = text[order - 1]
        change = np.empty(len(order) + 1, dtype=bool)
        change[0] = change[-1] = True
        change[1:-1] = before[1:] != before[:-1]
        #: The suffixes at both ends of each run.
        run_start, run_end = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
        self.head, self.tail = order[run_start], order[run_end]
        above = order[np.maximum(run_start - 1, 0)]
        below = order[np.minimum(run_end + 1, len(order) - 1)]
        self.head_match = np.where(run_start > 0, self._common(self.head, above), 0)
        self.tail_match = np.where(run_end + 1 < len(order), self._common(self.tail, below), 0)
        self.size = len(text)
        self.often = np.asarray(weights or [1] * count) > 1
        del self.levels, self.text

    def _sort(self) -> np.ndarray:
        """The suffix array by prefix doubling; ranks of each power of two are kept for matches."""
        # Four symbols make the first key; a text has fewer than 2**15 different ones.
        n, step = len(self.text), 4
        key = np.zeros(n, dtype=np.int64)
        for k in range(4):
            key[: n - k] += (self.text[k:] + 1) << (15 * (3 - k)) if n > k else 0
        rank = self._ranks(key, np.argsort(key))
        self.levels = [rank.astype(np.int32)]
        while True:
            following = np.zeros(n, dtype=np.int64)
            following[: n - step] = rank[step:] + 1
            key = rank.astype(np.int64) * (n + 1) + following
            order = np.argsort(key)
            rank = self._ranks(key, order)
            step *= 2
            if not n or rank[order[-1]] == n - 1:
                return order
            self.levels.append(rank.astype(np.int32))

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        ordered = key[order]
        new = np.zeros(len(key), dtype=np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes of suffixes, from the ranks of each power of two."""
        a, b, n = a.copy(), b.copy(), len(self.text)
        total = np.zeros(len(a), dtype=np.int64)
        steps = [(rank, 4 << k) for k, rank in reversed(list(enumerate(self.levels)))] + [(self.text, 1)] * 3
        for rank, size in steps:
            fits = (a < n) & (b < n)
            same = fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            gain = np.where(same, size, 0)
            total, a, b = total + gain, a + gain, b + gain
        return total

    def matching_statistics(self) -> np.ndarray:
        """For each position of the text the longest match that begins anywhere else."""
        where = np.arange(self.size)
        best = np.zeros(self.size, dtype=np.int64)
        for at, match in ((self.head, self.head_match), (self.tail, self.tail_match)):
            value = np.full(self.size, -1, dtype=np.int64)
            value[at] = match
            last = np.maximum.accumulate(np.where(value >= 0, where, 0))
            best = np.maximum(best, np.where(value[last] >= 0, value[last] - (where - last), 0))
        rest = np.repeat(self.ends, self.sizes + 1) - where
        return np.where(np.repeat(self.often, self.sizes + 1), np.maximum(best, rest), best)

    def repeated(self, window: int) -> list[np.ndarray]:
        """Per string the places at which a window begins that also begins elsewhere."""
        long = self.matching_statistics() >= window
        return [np.flatnonzero(long[s : s + n]) for s, n in zip(self.starts, self.sizes, strict=True)]


_FOUND = "anchor bigint, span bigint, a int, b int"


def _found(anchor: list[int], span: list[int], places: list[np.ndarray]) -> pa.RecordBatch:
    """Ranges of neighbouring places, string by string."""
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    at = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(at)]])[: len(head)] - 1
    keys = [np.asarray(k, dtype=np.int64)[row[head]] for k in (anchor, span)]
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(at[head].astype(np.int32)), pa.array(at[tail].astype(np.int32))], ["anchor", "span", "a", "b"])


def _search(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the strings of each anchor; the rows come sorted by anchor."""
    waiting: list[tuple] = []
    held = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])
        return _found([r[0] for r in rows], [r[1] for r in rows], RunLengthIndex(data, offsets, [r[2] for r in rows]).repeated(window))

    # Rows that repeat id and text bring their strings once each.
    group, seen = [], set()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                waiting += group
                held += sum(len(g[3]) for g in group)
                group, seen = [], set()
                if held >= INDEX_BYTES:
                    yield flush(waiting)
                    waiting, held = [], 0
            if row[1] not in seen:
                seen.add(row[1])
                group.append(row)
    waiting += group
    if waiting:
        yield flush(waiting)


_STRINGS = "anchor bigint, span bigint, n bigint, body binary, strings bigint"


def _cut_strings(joined: DataFrame, window: int) -> DataFrame:
    """The bytes of the chosen spans of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                body, spans = batch.column(0)[row].as_buffer(), batch.column(1)[row].as_py()
                cols = [pa.array([s[k] for s in spans], pa.int64()) for k in ("anchor", "span", "n", "strings")]
                cols.insert(3, pa.array([body.slice(s["p0"], s["p1"] + window - s["p0"]).to_pybytes() for s in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "span", "n", "body", "strings"])

    return joined.select("body", "spans").mapInArrow(work, _STRINGS)


def _window_hashes(strings: DataFrame, window: int) -> DataFrame:
    """One row for each window of the strings of crowded anchors: its hash and where it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, span, n = (batch.column(c).to_numpy() for c in (0, 1, 2))
            for start, data, offsets in groups(batch.column(3)):
                sums, back = prefix_sums(data, TABLE), powers(len(data), True)
                counts = np.diff(offsets) - window + 1
                row = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = offsets[row] + place
                value = mix((sums[at + window] - sums[at]) * back[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(anchor[start + row]), pa.array(span[start + row]), pa.array(n[start + row]), pa.array(place.astype(np.int32))],
                    ["hash", "anchor", "span", "n", "p"],
                )

    return strings.select("anchor", "span", "n", "body").mapInArrow(work, "hash bigint, anchor bigint, span bigint, n bigint, p int")


def _counted(strings: DataFrame, window: int) -> DataFrame:
    """Repeated windows of crowded anchors, by counts of their hashes, as ranges."""
    hashed = _window_hashes(strings, window)
    twice = hashed.groupBy("hash").agg(F.count("*").alias("times"), F.max("n").alias("most")).filter("times > 1 OR most > 1").select("hash")
    each = hashed.join(twice, "hash").select("anchor", "span", "p")
    # Neighbouring places have one difference to their number; a string has few hundred windows.
    w = Window.partitionBy("anchor", "span").orderBy("p")
    run = each.withColumn("run", F.col("p") - F.row_number().over(w))
    return run.groupBy("anchor", "span", "run").agg(F.min("p").alias("a"), F.max("p").alias("b")).select("anchor", "span", "a", "b")


def repeated_windows(keyed: DataFrame, folder: str, window: int = WINDOW, gram: int = GRAM, group_strings: int = GROUP_STRINGS, piece: int = PIECE_BYTES) -> DataFrame:
    """(``k1``, ``k2``, ``p0``, ``p1``): ranges of first bytes of repeated windows, by content key of the text."""
    spans = cut(_spans(keyed, window, gram, piece), folder, "spans")
    # The string of an anchor and its weight, and one place where it stands.
    place = F.shiftleft(F.col("p0").cast("bigint"), 32).bitwiseOR(F.col("p1").cast("bigint"))
    kinds = spans.select("anchor", "span", "k1", "k2", place.alias("place")).groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min("k1").alias("k1"), F.min_by("k2", "k1").alias("k2"), F.min_by("place", "k1").alias("place"))
    kinds = cut(kinds, folder, "kinds")
    crowd = kinds.groupBy("anchor").agg(F.count("*").alias("strings"), F.max("n").alias("most")).filter("strings > 1 OR most > 1").select("anchor", "strings")
    at = kinds.join(crowd, "anchor").withColumns({"p0": F.shiftright("place", 32).cast("int"), "p1": F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")})
    lists = at.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "span", "n", "strings", "p0", "p1")).alias("spans"))
    # Copies of a text have one key; the least id of them brings the bytes.
    one = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("one"))
    texts = keyed.join(lists.join(one, ["k1", "k2"]), ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("one"))).select("body", "spans")
    strings = cut(_cut_strings(texts, window), folder, "strings")
    # The index costs far more a byte than a sort does, so its tasks are cut finer than a shuffle's.
    parts = INDEX_TASKS * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = strings.filter(F.col("strings") <= group_strings).select("anchor", "span", "n", "body")
    few = few.repartition(parts, "anchor").sortWithinPartitions("anchor")
    inside = few.mapInArrow(lambda b: _search(b, window), _FOUND)
    crowded = _counted(strings.filter(F.col("strings") > group_strings).dropDuplicates(["anchor", "span"]), window)
    marks = inside.unionByName(crowded)
    return spans.join(marks, ["anchor", "span"]).select("k1", "k2", (F.col("p0") + F.col("a")).alias("p0"), (F.col("p0") + F.col("b")).alias("p1")).distinct()


def _strip(data: bytes, ranges: list, window: int) -> tuple[bytes, list[dict[str, int]]]:
    """(what is left, removed runs) for ranges of first bytes of windows."""
    runs: list[dict[str, int]] = []
    for a, b in sorted((r["p0"], r["p1"] + window) for r in ranges):
        if runs and a <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], b)
        else:
            runs.append({"start": a, "end": b})
    if not runs:
        return data, runs
    bounds = [0, *(x for r in runs for x in r.values()), len(data)]
    return b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)), runs


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, group_strings: int = GROUP_STRINGS, piece: int = PIECE_BYTES) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``n_bytes``, ``kept`` and ``removed``.

    Texts are UTF-8 bytes. Each byte goes that is covered by a string of ``window`` bytes that
    also starts anywhere else, in another text or in the same. ``kept`` is what is left,
    ``removed`` the runs (start, end exclusive) that went. Null texts are empty; texts shorter
    than the window stay whole; repeated rows are copies of each other like any two equal
    texts, whatever their ids; an empty table gives an empty result; other columns are not
    carried, so their names cannot clash. Very long texts are cut into spans piece by piece.
    """
    folder = shared_dir(documents.sparkSession)
    body = F.coalesce("text", F.lit("")).cast("binary")
    keyed = documents.select("doc_id", body.alias("body"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(5), body).alias("k2"))
    found = repeated_windows(keyed, folder, window, gram, group_strings, piece)
    lists = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("p0", "p1")).alias("ranges"))
    joined = keyed.join(lists, ["k1", "k2"], "left").select("doc_id", "body", "ranges")
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, _ROWS) for k in range(0, batch.num_rows, _ROWS)):
                sizes = [len(x.as_buffer()) for x in part.column(1)]
                done = [_strip(body, ranges or [], window) for body, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                cols = [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], run)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "kept", "removed"])

    return joined.mapInArrow(work, "doc_id bigint, n_bytes bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")
