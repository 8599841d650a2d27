"""Near-duplicate documents by HyperMinHash.

Each set of shingles is dealt into 128 buckets. A bucket's register keeps the number of
leading zeros of its least hash and the ten bits that follow, sixteen bits in all. Runs of
consecutive non-empty registers are the bands. Pairs that share a band pass a size test and
the collision-corrected Jaccard estimate, and full sets confirm them.

Large groups are never paired off. Copies with equal sets are one class. Within a band, all
classes are held against its smallest one. Only classes that this leaves in different
components are looked at again, and they meet only where a rare shingle and the places of
that shingle in both sets leave the threshold within reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .bytehash import U, mix
from .common import cut, drop_table, shared_dir
from .components import connected_components

BUCKETS = 128
MANTISSA = 10
#: Non-empty registers in a band; of rows with few registers further, shorter bands are made.
BAND, SHORT_BAND, SHORT_ROWS = 4, 3, 16
#: Rows with more non-empty registers begin a band at each fourth register only.
DENSE, STEP = 96, 4
#: Estimates so many standard deviations below the threshold rule a pair out.
SIGMAS = 6.0

_SKETCH = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch array<bigint>, bands array<bigint>"
_SETS = "doc_id bigint, n bigint, shingles array<bigint>"


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BUCKETS registers for each set; 0 marks an empty bucket."""
    sizes = np.asarray([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
    least = np.full(len(sets) * BUCKETS, (1 << 64) - 1, dtype=U)
    np.minimum.at(least, np.repeat(np.arange(len(sets)), sizes) * BUCKETS + (flat & U(BUCKETS - 1)).astype(np.int64), flat >> U(7))
    empty = least == U((1 << 64) - 1)
    value = np.where(empty, U(1), np.maximum(least, U(1)))
    length = np.frexp((value >> U(6)).astype(np.float64))[1].astype(np.int64) + 6
    low = value < U(64)
    length[low] = np.frexp(value[low].astype(np.float64))[1]
    zeros = 57 - length
    tail = ((value << (zeros + 1).astype(U)) & U((1 << 57) - 1)) >> U(57 - MANTISSA)
    out = (zeros.astype(U) << U(MANTISSA)) + tail + U(1)
    out[empty] = 0
    return out.reshape(len(sets), BUCKETS)


def bands(row: np.ndarray) -> np.ndarray:
    """Keys of the runs of non-empty registers, around the end, each with the places of its registers."""
    at = np.flatnonzero(row)
    k = len(at)
    if not k:
        return np.zeros(0, dtype=U)
    item = mix((at.astype(U) << U(32)) + row[at] + U(0x5851F42D4C957F2D))
    out = []
    for width in (BAND, SHORT_BAND) if k <= SHORT_ROWS else (BAND,):
        width = min(width, k)
        around = np.concatenate([item, item[: width - 1]])
        key = np.full(k, width, dtype=U)
        for j in range(width):
            key = mix(key * U(0xD1342543DE82EF95) + around[j : j + k])
        out.append(key if k <= DENSE else key[at % STEP == 0])
    return np.unique(np.concatenate(out))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _each_group(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    ids, texts = batch.column(0), batch.column(1)
    for row, data, offsets in bytehash.groups(texts):
        n = len(offsets) - 1
        words, rows = bytehash.word_hashes(data, offsets)
        yield ids.slice(row, n), bytehash.shingle_sets(words, rows, n, width)


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """Per row its set's size, a 128-bit fingerprint of the set, the packed registers and the band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _each_group(batch, width):
                regs = registers(sets)
                packed = np.zeros((len(sets), BUCKETS // 4), dtype=U)
                for lane in range(4):
                    packed |= regs[:, lane::4] << U(16 * lane)
                f1 = np.asarray([mix(s + U(1)).sum(dtype=U) for s in sets], dtype=U)
                f2 = np.asarray([mix(s * U(0xAF251AF3B0F025B5)).sum(dtype=U) for s in sets], dtype=U)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        _lists(list(packed)),
                        _lists([bands(r) for r in regs]),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "sketch", "bands"],
                )

    return documents.select("doc_id", "text").mapInArrow(work, _SKETCH)


def shingle_table(documents: DataFrame, width: int) -> DataFrame:
    """Per row the full set of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in _each_group(batch, width):
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["doc_id", "n", "shingles"])

    return documents.select("doc_id", "text").mapInArrow(work, _SETS)


def jaccard_estimate(a: Column, b: Column, n_a: Column, n_b: Column) -> tuple[Column, Column]:
    """(estimate, registers compared) for two packed sketches.

    The share of equal registers among those filled in either sketch, less the equal ones
    that chance would give at these set sizes.
    """
    lanes = F.lit(0x0001000100010001)

    def filled(x: Column) -> Column:
        for k in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(lanes))

    add = lambda p, q: p + q
    used = F.aggregate(F.zip_with(a, b, lambda x, y: filled(x.bitwiseOR(y))), F.lit(0), add)
    other = F.aggregate(F.zip_with(a, b, lambda x, y: filled(x.bitwiseXOR(y))), F.lit(0), add)
    ratio = F.greatest(n_a, n_b) / F.least(n_a, n_b)
    # The constant of the published approximation for the expected collisions.
    chance = F.lit(0.169919487159739 * BUCKETS / 2**MANTISSA) * F.lit(4.0) * ratio / ((ratio + 1) * (ratio + 1))
    return (used - other - chance) / F.greatest(used, F.lit(1)), used


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("common"))
    return both.filter(f"100 * common >= {per_cent} * (n_a + n_b - common)").select("a", "b").distinct()


def near_duplicates(documents: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked when ``100 * intersection >= per_cent * union`` of their sets.
    ``component_id`` is the smallest ``doc_id`` that links reach, ``kept`` is true for that
    document. Documents without words (null, empty or blank) have an empty set and no link.
    Rows that share a ``doc_id`` are one node with the links of each; a row whose ``doc_id``
    is null has no link, a null component, and is kept. A very long text is one row, whose
    shingles are sketched and compared whole. An empty table gives an empty result. Other
    columns are not carried, so their names cannot clash.
    """
    folder = shared_dir(documents.sparkSession)
    all_rows = cut(sketches(documents, width), folder, "sketches")
    full = all_rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["n_shingles", "f1", "f2"]
    classes = cut(full.groupBy(*same).agg(F.min("doc_id").alias("rep")), folder, "classes")

    reps = full.join(classes.select(*same, F.col("rep").alias("doc_id")), [*same, "doc_id"], "left_semi")
    rows = cut(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode_outer("bands").alias("band")), folder, "bands")
    leaders = rows.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").drop("last")
    shared = cut(rows.join(leaders, "band"), folder, "shared")
    drop_table(documents.sparkSession, folder, "bands")

    ids = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(shingle_table(documents.select("doc_id", "text").join(ids, "doc_id", "left_semi"), width), folder, "sets")
    sketch = reps.select(F.col("doc_id"), F.col("n_shingles").alias("n"), "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        left = sketch.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("k_a"))
        right = sketch.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("k_b"))
        p = per_cent / 100
        est, used = jaccard_estimate(F.col("k_a"), F.col("k_b"), F.col("n_a"), F.col("n_b"))
        sized = f"100 * least(n_a, n_b) >= {per_cent} * greatest(n_a, n_b)"
        joined = pairs.join(left, "a").join(right, "b").filter(sized)
        return joined.filter(est >= p - SIGMAS * F.sqrt(F.lit(p * (1 - p)) / F.greatest(used, F.lit(1)))).select("a", "b").distinct()

    first = shared.filter("leader < rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(_confirmed(likely(first), sets, per_cent), folder, "links-1")
    found = connected_components(links, folder, "first")
    second = _left_over(shared, found, sets, per_cent, folder)
    more = cut(_confirmed(likely(second), sets, per_cent), folder, "links-2")
    found = connected_components(links.unionByName(more), folder, "second")

    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component"))
    # Rows that share a doc_id may lie in several classes; their node has one component.
    out = full.select("doc_id", *same).join(named, same).groupBy("doc_id").agg(F.min("component").alias("component"))
    done = all_rows.select("doc_id", "n_shingles").join(out, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _left_over(shared: DataFrame, found: DataFrame, sets: DataFrame, per_cent: int, folder: str) -> DataFrame:
    """Pairs of different components, both in bands that hold several, that may reach the threshold.

    The shingles of each such class are put in one order, rarest among these classes first.
    A pair |y| <= |x| must have ``need = t / (100 + t) * (|x| + |y|)`` shingles in common. Of
    those, let the first in the order be at place i of x and j of y (from 0): what is left
    of either set behind it must do, so ``|x| - i >= need`` and ``|y| - j >= need``. Rows of
    one shingle meet only if these hold, for sizes in classes of a twentieth. Copies whose
    own changes already exceed the threshold have only rare shingles at such places and so
    meet almost nothing, however large their group is.
    """
    t = per_cent
    labels = found.select(F.col("node").alias("rep"), "component")
    rows = shared.select("band", "rep").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
    ids = cut(rows.join(mixed, "band", "left_semi").groupBy("rep").agg(F.min("component").alias("component")), folder, "mixed")
    token = sets.join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", F.explode_outer("shingles").alias("token"))
    common = token.groupBy("token").agg(F.count("*").alias("df"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("token", "df")
    # Shingles of one class only come first in any order and meet nothing: their number is enough.
    ranked = token.join(common, "token").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    alone = F.col("n") - F.size("ranked")
    most = F.floor(F.col("n") * (100 - t) / 100).cast("int") + 1
    head = F.slice("ranked", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int"))
    places = ranked.select("doc_id", "n", alone.alias("alone"), F.posexplode_outer(head).alias("nth", "r")).filter("r IS NOT NULL")
    places = places.select(F.col("doc_id").alias("rep"), "n", (F.col("n") - F.col("alone") - F.col("nth")).alias("rest"), F.col("r.token").alias("token")).join(ids, "rep")
    places = cut(places.withColumn("size_class", F.floor(F.log("n") / F.log(F.lit(1.05)))), folder, "places")

    low, high = F.ceil(F.col("n") * t / 100), F.least(F.col("n"), F.floor(F.col("rest") * (100 + t) / t) - F.col("n"))
    of = lambda c: F.floor(F.log(F.greatest(c, F.lit(1))) / F.log(F.lit(1.05)))
    x = places.withColumn("size_class", F.explode_outer(F.when(low <= high, F.sequence(of(low), of(high))))).filter("size_class IS NOT NULL")
    x = x.select("token", "size_class", *[F.col(c).alias(f"x_{c}") for c in ("rep", "n", "rest", "component")])
    y = places.select("token", "size_class", *[F.col(c).alias(f"y_{c}") for c in ("rep", "n", "rest", "component")])
    able = f"x_component <> y_component AND (x_n > y_n OR (x_n = y_n AND x_rep < y_rep)) AND {100 + t} * least(x_rest, y_rest) >= {t} * (x_n + y_n)"
    met = x.join(y, (x["token"] == y["token"]) & (x["size_class"] == y["size_class"]) & F.expr(able))
    return met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def keep_one(documents: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of ``documents`` whose document is the smallest of its component, with their own columns, whatever their names.

    Rows without an id stay; rows that share an id stay or go together. All other cases are as
    in :func:`near_duplicates`.
    """
    gone = near_duplicates(documents, width, per_cent).filter("NOT kept").select(F.col("doc_id").alias("__gone"))
    return documents.join(gone, documents["doc_id"] == gone["__gone"], "left_anti")
