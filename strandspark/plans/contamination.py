"""The contamination check of an assembly against a contaminant sequence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import seq as S
from ..operators import contam, diff, pileup

#: Fewer strong positions than this make the estimate unsafe.
LEAST_STRONG = 40


class TooFewSites(ValueError):
    """The estimate would rest on too few strong positions."""


@dataclass
class Check:
    """Sites, classes of reads, and the one-row reports for strong and for all sites."""

    distance: int
    sites: DataFrame
    reads: DataFrame
    strong: DataFrame
    both: DataFrame


def check(
    spark: SparkSession, alns: DataFrame, consensus: str, contaminant: str, ancient: bool = False, span: tuple[int, int] | None = None, least_sites: int = 1,
    limit: int | None = None, force: bool = False, transversions: bool = False, matrix: np.ndarray | None = None,
) -> Check:
    """``alns`` must be placed on ``consensus``; both sequences are small and held by the driver."""
    for seq in (consensus, contaminant):
        if not seq or set(seq.upper()) - set("ACGTBDHVMKYRSWUN"):
            raise ValueError("a sequence holds letters that are no IUPAC symbols")
    found = diff.align_pair(consensus, contaminant, limit)
    if found is None:
        raise ValueError("the sequences are too far apart; raise the limit")
    distance, left, right = found
    pair = spark.createDataFrame([(left, right)], "a string, c string").select(F.posexplode(F.arrays_zip(F.split("a", ""), F.split("c", ""))).alias("col", "x"))
    pair = pair.select("col", F.col("x.0").alias("assembly"), F.col("x.1").alias("contaminant")).filter("assembly <> ''")
    columns = contam.aligned_columns(pair)
    sites = contam.diagnostic(columns, transversions, *(span or (None, None)))
    if not force and sites.filter(F.col("strength") == contam.STRONG).count() < LEAST_STRONG:
        raise TooFewSites(f"fewer than {LEAST_STRONG} strong positions; force the estimate to have it anyway")
    named = alns.withColumn("name", S.plain_name(F.col("id")))
    # Positions of a reference: small, and needed by every alignment.
    lift = [r["dirt_pos"] for r in columns.filter("assembly <> '-'").orderBy("pos").select("dirt_pos").collect()]
    asked = [r["pos"] for r in sites.select("pos").collect()]
    keyed = named.select(F.concat_ws("\t", "name", "segment").alias("id"), "start", "seq", "ins")
    bases = contam.agreed_bases(keyed, contaminant, lift, asked, scoring.flat() if matrix is None else matrix)
    kept = contam.effective(contam.observations(bases, sites, ancient), sites)
    classes = contam.classify(contam.observations(bases, kept, ancient), least_sites)
    unknown = {"klass": "unknown", "klass2": "unknown", "sites": 0}
    halves = named.select("name", "segment").withColumn("id", F.concat_ws("\t", "name", "segment")).join(classes, "id", "left").fillna(unknown)
    reads = contam.merge_halves(halves.select("name", "segment", "klass", "klass2", "sites"))
    return Check(distance, kept, reads, contam.report(reads, "klass"), contam.report(reads, "klass2"))


def coverage_of(alns: DataFrame) -> DataFrame:
    """Depth by position, for a quick look before a check."""
    return pileup.coverage(alns.select("start", "end"))
