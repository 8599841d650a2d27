"""Audit of how filters overlap, over every order in which they can be applied.

Each row fails a set of filters, which is one of 2**n masks; all that any order does follows
from the number of rows of each mask, so the rows are counted by part and mask and nothing
larger leaves the map side. The orders of the filters are then visited by swaps of two
neighbours. A swap changes the rows that reach only the two steps that it touches, so those two
are read anew from the cells and the others stay; what each filter removes is added up along the
walk, which gives its Shapley total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, shared_dir, words

#: Filters at most, since the result has a row for each order and step.
MOST_FILTERS = 7
#: Rows of a result batch, at the least those of one part.
_BATCH_ROWS = 1 << 16


def neighbour_swaps(n: int) -> list[int]:
    """Places k such that swapping k and k + 1, one after the other, visits all orders of n things once.

    The last thing sweeps through all places of an order of the others, then the others make
    one swap of their own, and it sweeps back.
    """
    if n < 2:
        return []
    inner, out = neighbour_swaps(n - 1), []
    for turn in range(len(inner) + 1):
        out += range(n - 1) if turn % 2 else range(n - 2, -1, -1)
        if turn < len(inner):
            out.append(inner[turn] + (turn % 2 == 0))
    return out


def walk(cells: np.ndarray, names: Sequence[str]) -> tuple[list[str], dict[str, np.ndarray]]:
    """(orders, figures by name) of the cells of several parts.

    ``cells`` is parts x masks x (rows, good, toxic). Each figure is parts x orders x steps.
    """
    n, parts = len(names), len(cells)
    swaps = neighbour_swaps(n)
    masks = np.arange(1 << n)
    fails = [cells[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(n)]
    order, orders = list(range(n)), []
    out = {k: np.zeros((parts, len(swaps) + 1, n), dtype=np.int64) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    removed, kept, total = np.zeros((n, parts, 3), dtype=np.int64), np.zeros((n + 1, parts), dtype=np.int64), np.zeros((n, parts), dtype=np.int64)
    kept[0] = cells[:, :, 0].sum(axis=1)

    def step(k: int) -> None:
        before = sum(1 << f for f in order[:k])
        reach = (masks & before == 0) & (masks >> order[k] & 1 == 1)
        removed[k] = cells[:, reach].sum(axis=1)
        kept[k + 1] = kept[k] - removed[k, :, 0]

    for k in range(n):
        step(k)
    for at in range(len(swaps) + 1):
        if at:
            k = swaps[at - 1]
            order[k], order[k + 1] = order[k + 1], order[k]
            step(k)
            step(k + 1)
        orders.append("".join(names[f] for f in order))
        for k, f in enumerate(order):
            lost = removed[k]
            total[f] += lost[:, 0]
            out["kept"][:, at, k], out["removed"][:, at, k], out["redundant"][:, at, k] = kept[k + 1], lost[:, 0], fails[f] - lost[:, 0]
            out["unique_fails"][:, at, k], out["good_lost"][:, at, k], out["toxic_lost"][:, at, k] = cells[:, 1 << f, 0], lost[:, 1], lost[:, 2]
    for at, text in enumerate(orders):
        for k, f in enumerate(text):
            out["shapley"][:, at, k] = total[names.index(f)]
    return orders, out


_FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(flagged: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per ``part``, order of the filters and step, zeros included.

    ``flagged`` has ``part`` (null counts as an empty string), a boolean column for each of
    ``names`` (one letter each; true: the row fails it, null: it does not), and booleans
    ``good`` and ``toxic`` (null: not); other columns are not read. The result is ``part``,
    ``filter_order``, ``step`` from 1, and counts of the part's rows: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (fail its filter but went before), ``unique_fails`` (fail
    its filter only), ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``, the
    removed of its filter summed over all orders. Repeated rows count each; no rows give no
    parts. A part is 2**n cells at most, however many rows it has.
    """
    n = len(names)
    if not 1 <= n <= MOST_FILTERS or len(set(names)) < n or any(len(x) != 1 for x in names):
        raise ValueError(f"give 1 to {MOST_FILTERS} filters, each with a letter of its own")
    mask = sum((F.when(F.col(x), 1 << k).otherwise(0) for k, x in enumerate(names)), F.lit(0)).cast("int")
    count = lambda c: F.count(F.when(F.col(c), 1))
    cells = flagged.select(F.coalesce("part", F.lit("")).alias("part"), mask.alias("mask"), "good", "toxic").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))
    # At most 2**n cells a part.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    each = n * math.factorial(n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            some = max(1, _BATCH_ROWS // each)
            for batch in (whole.slice(k, some) for k in range(0, whole.num_rows, some)):
                grid = np.zeros((batch.num_rows, 1 << n, 3), dtype=np.int64)
                for row, found in enumerate(batch.column(1).to_pylist()):
                    for c in found:
                        grid[row, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, figures = walk(grid, names)
                cols = [
                    pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each), pa.string()),
                    pa.array(np.tile(np.repeat(np.asarray(orders, dtype=object), n), batch.num_rows), pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), batch.num_rows * len(orders))),
                    *(pa.array(figures[k].reshape(-1)) for k in _FIGURES),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["part", "filter_order", "step", *_FIGURES])

    return parts.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{k} bigint" for k in _FIGURES))


#: The filters of :func:`text_flags`, by letter: few words, few distinct words, many capitals, signs, copies.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PER_CENT, CAPITALS_PER_CENT, SIGNS = 50, 65, 5, "[#$%&*|]"


def text_flags(documents: DataFrame, part: Column) -> DataFrame:
    """``doc_id``, ``part`` and a boolean for each of :data:`LETTERS`, one row per row of ``documents``.

    Null texts are empty. A copy is a row whose text a smaller ``doc_id`` has somewhere in the
    table; rows that share the smallest id are no copies of each other, and a null id is
    neither smaller nor larger. Texts are known by two hashes of 64 bits; one that very many
    rows share meets as partial minima. Very long texts are handled whole; other columns are
    not carried, so their names cannot clash.
    """
    body = F.coalesce("text", F.lit(""))
    counts = let(words(body), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    rows = documents.select(
        "doc_id",
        part.cast("string").alias("part"),
        counts.alias("words"),
        (100 * capitals.cast("bigint") > CAPITALS_PER_CENT * F.length(body).cast("bigint")).alias("C"),
        body.rlike(SIGNS).alias("D"),
        F.xxhash64(body).alias("h1"),
        F.xxhash64(F.lit(11), body).alias("h2"),
    )
    n, distinct = (F.col("words")[k].cast("bigint") for k in ("n", "distinct"))
    rows = rows.select("doc_id", "part", (n < LEAST_WORDS).alias("A"), (100 * distinct < DISTINCT_PER_CENT * n).alias("B"), "C", "D", "h1", "h2")
    # The flags are read twice; a row is some fifty bytes.
    rows = cut(rows, shared_dir(documents.sparkSession), "flags")
    # Rows meet the first of their text by its id and not by the text alone, so copies do not gather.
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h1", "h2", F.lit(True).alias("first"))
    copies = (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E")
    return rows.join(first, ["doc_id", "h1", "h2"], "left").select("doc_id", "part", "A", "B", "C", "D", copies)


def with_labels(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``flags`` with ``good`` and ``toxic``: whether any label row of the id has quality 1, toxic 1; false without one."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    return flags.join(known, "doc_id", "left")


def audit_texts(documents: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """:func:`audit` of the filters of :func:`text_flags` over ``documents``, by ``part``."""
    return audit(with_labels(text_flags(documents, part), labels), LETTERS)
