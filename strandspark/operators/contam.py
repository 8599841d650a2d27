"""Classification of reads by the positions where a contaminant differs from the sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import seq as S
from . import kernel
from . import ordered
from .pileup import bases

LABELS = {"unknown": "unclassified", "clean": "clean", "dirt": "polluting", "conflict": "conflicting", "nonsense": "nonsensical"}
WEAK, EFFECTIVE, STRONG = 1, 2, 3


def aligned_columns(pair: DataFrame) -> DataFrame:
    """(``col``, ``assembly``, ``contaminant``, ``pos``, ``dirt_pos``) of rows (``col``, ``assembly``, ``contaminant``).

    Positions count the letters before a column in either sequence.
    """
    letter = lambda c: F.when(F.col(c) != "-", F.lit(1)).otherwise(F.lit(0))
    out = ordered.running_sums(pair, "col", {"pos": letter("assembly"), "dirt_pos": letter("contaminant")}, inclusive=False)
    return out.select("col", "assembly", "contaminant", F.col("pos").cast("int").alias("pos"), F.col("dirt_pos").cast("int").alias("dirt_pos"))


def diagnostic(columns: DataFrame, transversions: bool = False, low: int | None = None, high: int | None = None) -> DataFrame:
    """(``pos``, ``assembly``, ``contaminant``, ``strength``): columns where the two differ and neither has a gap.

    Strong: no base in common. Weak: unlike letters that share a base. ``low`` and ``high``
    (from 1, inclusive) bound the assembly position.
    """
    a, c = F.col("assembly"), F.col("contaminant")
    found = columns.filter((a != "-") & (c != "-") & (F.upper(a) != F.upper(c)))
    if low is not None:
        found = found.filter(F.col("pos").between(low - 1, high - 1))
    if transversions:
        found = found.filter(S.is_transversion(a, c))
    strength = F.when(~S.compatible(a, c), F.lit(STRONG)).otherwise(F.lit(WEAK))
    return found.select("pos", "assembly", "contaminant", strength.alias("strength"))


def observations(bases: DataFrame, sites: DataFrame, ancient: bool = False, *more: str) -> DataFrame:
    """Reads' bases at diagnostic positions: (``id``, ``pos``, ``base``, ``strength``, ``clean``, ``dirt``).

    ``bases`` has (``id``, ``pos``, ``base``) and the columns ``more``. An equi-join on
    positions; Spark broadcasts the sites when they are small.
    """
    met = bases.join(sites, "pos")
    base = F.col("base")
    return met.select("id", "pos", "base", "strength", *more, S.consistent(F.col("assembly"), base, ancient).alias("clean"), S.consistent(F.col("contaminant"), base, ancient).alias("dirt"))


def site_counts(alns: DataFrame, sites: DataFrame, ancient: bool = False) -> DataFrame:
    """(``pos``, ``strength``, ``n``, ``clean``, ``dirt``): bases of placed reads at each site, and how many fit either sequence.

    Bases are counted by position and letter before they meet the sites, so the symbols are
    compared once for each letter of a site and not for each read.
    """
    seen = bases(alns).groupBy("pos", "base").agg(F.count("*").alias("times"))
    met = observations(seen.withColumn("id", F.lit("")), sites, ancient, "times")
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("times"))), F.lit(0)).cast("bigint").alias(c)
    return met.groupBy("pos", "strength").agg(F.sum("times").cast("bigint").alias("n"), total("clean"), total("dirt"))


def effective(observed: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites that stay: strong ones, and weak ones at which a read agrees with the contaminant alone."""
    seen = observed.filter("strength = 1 AND NOT clean AND dirt").select("pos").distinct().withColumn("seen", F.lit(True))
    joined = sites.join(seen, "pos", "left")
    upgraded = F.when((F.col("strength") == WEAK) & F.col("seen"), F.lit(EFFECTIVE)).otherwise(F.col("strength"))
    return joined.withColumn("strength", upgraded).filter(F.col("strength") > WEAK).drop("seen")


def class_of(n_clean: Column, n_dirt: Column, n_neither: Column) -> Column:
    """A read's class from counts of its sites; the order of sites does not matter."""
    return (
        F.when(n_neither > 0, "nonsense")
        .when((n_clean > 0) & (n_dirt > 0), "conflict")
        .when(n_clean > 0, "clean")
        .when(n_dirt > 0, "dirt")
        .otherwise("unknown")
    )


def classify(observed: DataFrame, least_sites: int = 1, *keys: str) -> DataFrame:
    """(keys, ``sites``, ``votes``, ``klass``, ``klass2``).

    ``klass`` hears strong sites only; ``klass2`` hears effective ones too and counts a base
    that fits both as clean. Reads with fewer than ``least_sites`` sites stay unknown.
    """
    keys = keys or ("id",)
    c, d, strong = F.col("clean"), F.col("dirt"), F.col("strength") == STRONG
    count = lambda x: F.count_if(x)
    sums = observed.groupBy(*keys).agg(
        F.count("*").alias("sites"),
        count(strong & c & ~d).alias("c1"), count(strong & ~c & d).alias("d1"), count(strong & ~c & ~d).alias("x1"),
        count(c).alias("c2"), count(~c & d).alias("d2"), count(~c & ~d).alias("x2"),
    )
    enough = F.col("sites") >= least_sites
    klass = F.when(enough, class_of(F.col("c1"), F.col("d1"), F.col("x1"))).otherwise("unknown")
    klass2 = F.when(enough, class_of(F.col("c2"), F.col("d2"), F.col("x2"))).otherwise("unknown")
    return sums.select(*keys, "sites", F.when(enough, F.col("c1") + F.col("d1")).otherwise(F.lit(0)).cast("bigint").alias("votes"), klass.alias("klass"), klass2.alias("klass2"))


def merge_classes(a: Column, b: Column) -> Column:
    """Two halves of a read: equal stays, unknown gives way, nonsense absorbs, else conflict."""
    return (
        F.when(a == b, a)
        .when(a == "unknown", b)
        .when(b == "unknown", a)
        .when((a == "nonsense") | (b == "nonsense"), F.lit("nonsense"))
        .otherwise(F.lit("conflict"))
    )


def merge_halves(halves: DataFrame) -> DataFrame:
    """(``name``, ``klass``, ``klass2``, ``sites``): fronts with their backs, by name; lone halves stay.

    ``halves`` has (``name``, ``segment`` a/f/b, ``klass``, ``klass2``, ``sites``).
    """
    back = halves.filter("segment = 'b'").select("name", F.col("klass").alias("bk"), F.col("klass2").alias("bk2"), F.col("sites").alias("bs"))
    front = halves.filter("segment <> 'b'")
    joined = front.join(back, "name", "left")
    zero = F.lit("unknown")
    return joined.select(
        "name",
        merge_classes(F.col("klass"), F.coalesce("bk", zero)).alias("klass"),
        merge_classes(F.col("klass2"), F.coalesce("bk2", zero)).alias("klass2"),
        (F.col("sites") + F.coalesce("bs", F.lit(0))).alias("sites"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Struct of the estimate and the 95 % interval, in per cent, within 0 and 100; null without reads."""
    p = k / F.nullif(n, F.lit(0))
    wide = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    mid, base = p + F.lit(z * z) / (2 * n), 1 + F.lit(z * z) / n
    bound = lambda x: F.least(F.greatest(F.lit(100.0) * x / base, F.lit(0.0)), F.lit(100.0))
    return F.when(n > 0, F.struct((p * 100).alias("estimate"), bound(mid - wide).alias("low"), bound(mid + wide).alias("high")))


def report(reads: DataFrame, by: str = "klass") -> DataFrame:
    """One row: reads of each class, and the contaminant's share of those decided, with its interval."""
    n = lambda name: F.count_if(F.col(by) == name)
    one = reads.agg(*[n(k).cast("bigint").alias(v) for k, v in LABELS.items()])
    return one.withColumn("w", wilson(F.col("polluting"), F.col("polluting") + F.col("clean"))).select(*LABELS.values(), "w.*")


_SEEN = "id string, pos int, base string"


def agreed_bases(alns: DataFrame, contaminant: str, dirt_pos: list[int], sites: list[int], matrix: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """(``id``, ``pos``, ``base``) where a read shows one base at a site by both alignments.

    Each placed read is aligned once more, to the part of the contaminant that lies over its
    place. ``dirt_pos`` gives the contaminant position of each assembly position, ``sites``
    the positions that are asked for; both are as long as a reference at most. A site where
    the two alignments disagree about the read's base says nothing about its origin.
    """
    asked = np.zeros(len(dirt_pos) + 1, dtype=bool)
    asked[sites] = True
    lifted = np.asarray([*dirt_pos, len(contaminant)])

    other = kernel.codes(contaminant.upper())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[int, int], list[tuple]] = {}
            for name, start, seq, ins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = start + np.flatnonzero(asked[start : start + len(seq)])
                if not len(here):
                    continue
                inserts = dict(ins or [])
                read = "".join(inserts.get(start + k, "") + c for k, c in enumerate(seq)).replace("-", "")
                low, high = int(lifted[start]), int(lifted[min(start + len(seq), len(lifted) - 1)])
                if read and high > low:
                    groups.setdefault((len(read), high - low), []).append((name, start, seq, here, read, low))
            out: list[tuple[str, int, str]] = []
            for (size, width), all_ in groups.items():
                # Reads of one length over parts of one width share a call of the kernel.
                step = max(1, kernel.TRIM_CELLS // (size * width))
                for k in range(0, len(all_), step):
                    part = all_[k : k + step]
                    filled = kernel.fill(np.stack([other[r[5] : r[5] + width] for r in part]), np.stack([kernel.codes(r[4]) for r in part]), matrix, settings)
                    _, ends = kernel.best_ends(filled)
                    for b, (name, start, seq, here, read, low) in enumerate(part):
                        path = kernel.trace(filled, b, size - 1, int(ends[b]))
                        by_dirt = dict(zip((path.cols + low).tolist(), path.rows.tolist(), strict=True))
                        for p in here.tolist():
                            row = by_dirt.get(int(lifted[p]))
                            letter = "-" if row is None else read[row]
                            if letter == seq[p - start]:
                                out.append((name, p, letter))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["id", "pos", "base"])

    return alns.select("id", "start", "seq", "ins").mapInArrow(work, _SEEN)
