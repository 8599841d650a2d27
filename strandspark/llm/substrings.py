"""Removal of long repeated runs of words with suffix automata of reference shards.

Every window of WINDOW words has an anchor, the least hash of the runs of GRAM words in it;
equal windows have equal anchors at equal places. The windows of one anchor lie side by side,
so a text falls into spans, one for each anchor occurrence, and each window belongs to one span.
An anchor that occurs once has no repeated window. The spans of all others, equal ones once with
a weight, are the reference; it is cut into shards of whole anchors, and the spans go to the
shard of their anchor, since no other can hold their windows.

For each shard a suffix automaton of its strings is built, with the number of places at which
each state's words end. States met once are cut off; the words of each string then stream
through what is left, which gives at each word the longest run ending there that begins at two
places at least. Windows are repeated where that statistic reaches WINDOW.

An anchor with more than GROUP_STRINGS strings would make a shard that outgrows a task. Its
windows become strings of their own, dealt by their hash; those that occur once go first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import IS_SPACE, TABLE, anchor_spans, groups, mix, powers, sums_of, word_hashes
from .common import cut, shared_dir

WINDOW = 35
GRAM = 5
#: Strings of one anchor up to which they share a shard; the windows of more are dealt one by one.
GROUP_STRINGS = 1000
#: Words of whole anchors that share an automaton.
SHARD_WORDS = 2000
#: Bytes of a long text whose words are hashed at once.
PIECE_BYTES = 1 << 22
#: Words of a long text whose spans are taken at once; pieces overlap by a window less a word.
PIECE_WORDS = 1 << 18
#: Tasks of the automata for each shuffle partition.
SHARD_TASKS = 4
#: Texts that are stripped at once.
_ROWS = 256


def _words(data: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, bounds of the rows in words); a long text goes piece by piece between white space."""
    if len(data) <= most or len(offsets) > 2:
        values, rows = word_hashes(data, offsets, TABLE)
        return values, np.searchsorted(rows, np.arange(len(offsets)))
    out, at = [], 0
    while at < len(data):
        end = at + most
        while end < len(data) and not IS_SPACE[data[end - 1]]:
            gap = np.flatnonzero(IS_SPACE[data[end : end + most]])
            end = end + int(gap[0]) + 1 if len(gap) else end + most
        part = data[at:end]
        out.append(word_hashes(part, np.asarray([0, len(part)]), TABLE)[0])
        at = end
    values = np.concatenate(out)
    return values, np.asarray([0, len(values)])


_SPANS = "k1 bigint, k2 bigint, anchor bigint, span bigint, p0 int, p1 int"


def _spans(keyed: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    """The spans of each text: their anchor and content by hash, and their first and last window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, data, offsets in groups(batch.column(2)):
                values, bounds = _words(data, offsets)
                whole = len(bounds) > 2 or len(values) <= most
                for at in [0] if whole else range(0, len(values) - window + 1, most):
                    part = values if whole else values[at : at + most + window - 1]
                    row, first, last, _, anchor, span = anchor_spans(part, bounds if whole else np.asarray([0, len(part)]), window, gram)
                    cols = [k1[start + row], k2[start + row], anchor.view(np.int64), span.view(np.int64), (first + at).astype(np.int32), (last + at).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["k1", "k2", "anchor", "span", "p0", "p1"])

    return keyed.select("k1", "k2", "body").mapInArrow(work, _SPANS)


class SuffixAutomaton:
    """Suffix automaton of several sequences, each with a weight; its states know how often their words occur."""

    def __init__(self) -> None:
        self.moves: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, state: int, word: object, to: int) -> int:
        """The state of the longest run of ``state`` followed by ``word``: ``to``, or a copy that parts from it."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.moves[to].copy(), self.link[to], self.length[state] + 1)
        self.link[to] = copy
        while state >= 0 and self.moves[state].get(word) == to:
            self.moves[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list, weight: int = 1) -> None:
        """Take in a sequence that occurs ``weight`` times."""
        last = 0
        for word in words:
            to = self.moves[last].get(word)
            if to is not None:
                last = self._split(last, word, to)
            else:
                new, state = self._state({}, 0, self.length[last] + 1), last
                while state >= 0 and word not in self.moves[state]:
                    self.moves[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._split(state, word, self.moves[state][word])
                last = new
            self.count[last] += weight

    def prune(self, least: int = 2) -> None:
        """Add up the occurrences and cut off the states with fewer than ``least``; nothing can be added afterwards."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]
        count = self.count
        for state, moves in enumerate(self.moves):
            self.moves[state] = {w: to for w, to in moves.items() if count[to] >= least} if state == 0 or count[state] >= least else {}

    def statistics(self, words: list) -> list[int]:
        """For each word the length of the longest run ending there that the automaton holds."""
        moves, link, length = self.moves, self.link, self.length
        state = run = 0
        out = []
        for word in words:
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = moves[state].get(word)
            if to is None:
                run = 0
            else:
                state, run = to, run + 1
            out.append(run)
        return out


def repeated_starts(strings: list[list], weights: list[int], window: int) -> list[np.ndarray]:
    """Per string of a shard the words at which a window begins that also begins elsewhere."""
    automaton = SuffixAutomaton()
    for words, weight in zip(strings, weights, strict=True):
        automaton.add(words, weight)
    automaton.prune()
    return [np.flatnonzero(np.asarray(automaton.statistics(words), dtype=np.int64)[window - 1 :] >= window) for words in strings]


_FOUND = "anchor bigint, span bigint, a int, b int"


def _found(rows: list[tuple], places: list[np.ndarray]) -> pa.RecordBatch:
    """Ranges of neighbouring places, string by string."""
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    at = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(at)]])[: len(head)] - 1
    keys = [pa.array(np.asarray([r[k] for r in rows], dtype=np.int64)[row[head]]) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(at[head].astype(np.int32)), pa.array(at[tail].astype(np.int32))], ["anchor", "span", "a", "b"])


def _search(batches: Iterator[pa.RecordBatch], window: int, most: int = SHARD_WORDS) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the strings of each shard; the rows come sorted by a key that equal windows share."""
    rows: list[tuple] = []
    held, seen, last = 0, set(), None

    def flush() -> pa.RecordBatch:
        return _found(rows, repeated_starts([r[3] for r in rows], [r[2] for r in rows], window))

    for batch in batches:
        for key, anchor, span, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                if held >= most:
                    yield flush()
                    rows, held = [], 0
                last, seen = key, set()
            # Texts that share a key bring their strings once each.
            if (anchor, span) not in seen:
                seen.add((anchor, span))
                rows.append((anchor, span, n, body.split()))
                held += len(rows[-1][3])
    if rows:
        yield flush()


_STRINGS = "anchor bigint, span bigint, n bigint, crowded boolean, body binary"


def _cut_strings(joined: DataFrame, window: int) -> DataFrame:
    """The words of the chosen spans of each text, joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, spans = batch.column(0)[row].as_py().split(), batch.column(1)[row].as_py()
                cols = [pa.array([s[k] for s in spans], t) for k, t in (("anchor", pa.int64()), ("span", pa.int64()), ("n", pa.int64()), ("crowded", pa.bool_()))]
                cols.append(pa.array([b" ".join(words[s["p0"] : s["p1"] + window]) for s in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "span", "n", "crowded", "body"])

    return joined.select("body", "spans").mapInArrow(work, _STRINGS)


def _each_window(strings: DataFrame, window: int) -> DataFrame:
    """One row for each window of the strings of crowded anchors: its hash and where it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, span, n = (batch.column(c).to_numpy() for c in (0, 1, 2))
            for start, data, offsets in groups(batch.column(3)):
                values, bounds = _words(data, offsets)
                sums, back = sums_of(values), powers(len(values), True)
                counts = np.diff(bounds) - window + 1
                row = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = bounds[row] + place
                value = mix((sums[at + window] - sums[at]) * back[at])
                cols = [anchor[start + row], value.view(np.int64), span[start + row], n[start + row], place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["anchor", "hash", "span", "n", "p"])

    return strings.select("anchor", "span", "n", "body").mapInArrow(work, "anchor bigint, hash bigint, span bigint, n bigint, p int")


def _cut_windows(joined: DataFrame, window: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                anchor, words, chosen = batch.column(0)[row].as_py(), batch.column(1)[row].as_py().split(), batch.column(2)[row].as_py()
                cols = [pa.array([anchor] * len(chosen), pa.int64()), pa.array([c["hash"] for c in chosen], pa.int64()), pa.array([c["n"] for c in chosen], pa.int64())]
                cols.append(pa.array([b" ".join(words[c["p"] : c["p"] + window]) for c in chosen], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "span", "n", "body"])

    return joined.select("anchor", "body", "chosen").mapInArrow(work, "anchor bigint, span bigint, n bigint, body binary")


def _marked(strings: DataFrame, window: int, parts: int, key: str) -> DataFrame:
    """Ranges of repeated windows of strings; a shard has all strings of its values of ``key``."""
    dealt = strings.select(F.col(key).alias("key"), "anchor", "span", "n", "body").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda b: _search(b, window), _FOUND)


def repeated_windows(keyed: DataFrame, folder: str, window: int = WINDOW, gram: int = GRAM, group_strings: int = GROUP_STRINGS, piece: int = PIECE_WORDS) -> DataFrame:
    """(``k1``, ``k2``, ``p0``, ``p1``): ranges of first words of repeated windows, by content key of the text."""
    spans = cut(_spans(keyed, window, gram, piece), folder, "spans")
    # Counts are written, so that both sides of the joins are dealt anew and a crowded anchor can be split.
    again = cut(spans.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), folder, "again")
    spans = cut(spans.join(again, "anchor", "left_semi").select(*spans.columns), folder, "repeated")
    # The string of an anchor and its weight, and one place where it stands.
    place = F.shiftleft(F.col("p0").cast("bigint"), 32).bitwiseOR(F.col("p1").cast("bigint"))
    kinds = spans.select("anchor", "span", "k1", "k2", place.alias("place")).groupBy("anchor", "span")
    kinds = kinds.agg(F.count("*").alias("n"), F.min("k1").alias("k1"), F.min_by("k2", "k1").alias("k2"), F.min_by("place", "k1").alias("place"))
    kinds = cut(kinds, folder, "kinds")
    kinds = kinds.withColumns({"p0": F.shiftright("place", 32).cast("int"), "p1": F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")})
    crowd = cut(kinds.groupBy("anchor").agg(F.count("*").alias("strings")).filter(F.col("strings") > group_strings).select("anchor", F.lit(True).alias("crowded")), folder, "crowd")
    at = kinds.join(crowd, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    lists = at.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "span", "n", "crowded", "p0", "p1")).alias("spans"))
    # Copies of a text have one key; the least id of them brings the words.
    one = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("one"))
    texts = keyed.join(lists.join(one, ["k1", "k2"]), ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("one"))).select("body", "spans")
    strings = cut(_cut_strings(texts, window), folder, "strings")
    # An automaton costs far more a word than a sort does, so its tasks are cut finer than a shuffle's.
    parts = SHARD_TASKS * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = _marked(strings.filter("NOT crowded"), window, parts, "anchor")
    # Windows of crowded anchors: those that occur again by hash are strings of a window each.
    crowded = strings.filter("crowded").dropDuplicates(["anchor", "span"])
    each = _each_window(crowded, window)
    twice = each.groupBy("anchor", "hash").agg(F.sum("n").alias("n"), F.min("span").alias("span"), F.min_by("p", "span").alias("p")).filter("n > 1")
    chosen = twice.groupBy("anchor", "span").agg(F.collect_list(F.struct("hash", "n", "p")).alias("chosen"))
    alone = _cut_windows(crowded.join(chosen, ["anchor", "span"]), window)
    sure = _marked(alone, window, parts, "span").select("anchor", F.col("span").alias("hash"))
    marks = marks.unionByName(each.join(sure, ["anchor", "hash"]).select("anchor", "span", F.col("p").alias("a"), F.col("p").alias("b")))
    return spans.join(marks, ["anchor", "span"]).select("k1", "k2", (F.col("p0") + F.col("a")).alias("p0"), (F.col("p0") + F.col("b")).alias("p1")).distinct()


def _strip(words: list[bytes], ranges: list, window: int) -> tuple[bytes, list[dict[str, int]]]:
    """(the words that are left, removed runs) for ranges of first words of windows."""
    runs: list[dict[str, int]] = []
    for a, b in sorted((r["p0"], r["p1"] + window) for r in ranges):
        if runs and a <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], b)
        else:
            runs.append({"start": a, "end": b})
    bounds = [0, *(x for r in runs for x in r.values()), len(words)]
    return b" ".join(w for a, b in zip(bounds[::2], bounds[1::2], strict=True) for w in words[a:b]), runs


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, group_strings: int = GROUP_STRINGS, piece: int = PIECE_WORDS) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``n_words``, ``kept`` and ``removed``.

    Words are runs without ASCII white space, unchanged. Each word goes that is covered by a
    run of ``window`` words that also starts anywhere else, in another text or in the same;
    runs are judged on the input. ``kept`` are the words that are left, joined by one space,
    in UTF-8; ``removed`` the runs of words (start, end exclusive) that went. Null texts are
    empty; texts of fewer words than the window stay whole; repeated rows are copies of each
    other like any two equal texts, whatever their ids, null ids too; an empty table gives an
    empty result; other columns are not carried, so their names cannot clash. Very long texts
    are cut into spans piece by piece.
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
                sizes, kept, removed = [], [], []
                for body, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = body.split()
                    left, runs = _strip(words, ranges or [], window)
                    sizes.append(len(words))
                    kept.append(left)
                    removed.append(runs)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, run)], ["doc_id", "n_words", "kept", "removed"])

    return joined.mapInArrow(work, "doc_id bigint, n_words bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")
