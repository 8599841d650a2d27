"""The assembly: align, filter, call, and repeat until the consensus stays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import scoring
from ..functions import seq as S
from ..operators import align, cutoff, dedup, pileup, seeds
from ..operators.steps import folder, tasks, written


@dataclass
class Assembly:
    """A finished or intermediate assembly; ``aligned`` counts the reads that each round aligned anew."""

    name: str
    reference: str
    alns: DataFrame
    forward: np.ndarray
    backward: np.ndarray
    consensus: str = ""
    rounds: int = 0
    aligned: list[int] = field(default_factory=list)
    settings: Settings = field(default_factory=Settings)

    def scores(self) -> DataFrame:
        return scoring.table(self.alns.sparkSession, self.forward, self.backward)


def reference_rows(spark: SparkSession, seq: str) -> DataFrame:
    """(``pos``, ``ref_base``) of a reference that the driver holds."""
    one = spark.createDataFrame([(seq,)], "seq string")
    return one.select(F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "ref_base"))


def clear_steps(spark: SparkSession) -> int:
    """Delete all ``assembly-*`` folders of the shared folder; their number. Assemblies read them lazily."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return 0
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/assembly-*")
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(glob) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)


def seeded_reads(spark: SparkSession, reads: DataFrame, reference: str, settings: Settings) -> DataFrame:
    """Reads with a seed, and the columns that their seeds open."""
    wrapped = reference + reference[: settings.max_read] if settings.circular else reference
    index = seeds.reference_index(spark, wrapped, settings.kmer, settings.soft_mask, settings.kmer_positions)
    open_ = seeds.windows(seeds.hits(reads, index, settings.kmer), len(wrapped), settings.mask_buffer, settings.kmer_saturate)
    per = open_.groupBy("ord").agg(*[F.first(F.when(F.col("strand") == s, F.col(c)), ignorenulls=True).alias(f"{c}_{s}") for s in ("f", "r") for c in ("spans", "whole")])
    return reads.join(per, "ord").withColumn("seeded", F.lit(True)).repartition(tasks(spark), "ord")


def _cull(placed: DataFrame, reference: str, settings: Settings) -> DataFrame:
    """Unique reads with their cut, as placed segments; ``cut`` stays for collapsing."""
    # One row for each read decides for all its segments.
    read_cols = ["ord", "read", "qual", "qual_sum", "num_inputs", "score", "rc", "trimmed", "strand_known", "as", "ae"]
    reads = placed.filter("segment <> 'b'").select(*read_cols)
    size = F.length("read")
    if settings.distant:
        ref = F.lit(reference)
        size = S.alignable_length(size, ref.substr(F.col("as") + 1, F.least("ae", F.lit(len(reference))) - F.col("as")), settings.min_alignable)
    reads = reads.withColumn("len", size)
    if settings.dedup:
        reads = dedup.flag_unique(reads, settings.dedup, settings.tolerance, not settings.adapter_aware)
    else:
        reads = reads.withColumns({"unique_best": F.lit(True), "cluster": F.col("ord")})
    reads = cutoff.with_cut(reads, settings, cutoff.fitted_line(reads, settings) if settings.hard_cut <= 0 else None)
    flags = reads.select("ord", "unique_best", "cluster", "cut", cutoff.below(F.col("score"), F.col("cut")).alias("dropped"))
    return placed.join(flags, "ord")


def _next_reads(culled: DataFrame, settings: Settings) -> DataFrame:
    """One row for each read of the next round, redundant ones merged if asked for."""
    reads = culled.filter("segment <> 'b'").withColumn("id", S.plain_name(F.col("id")))
    reads = reads.select("ord", "id", "desc", F.col("read").alias("seq"), "qual", "qual_sum", "num_inputs", "score", "rc", "trimmed", "strand_known", "as", "ae", "settled", "unique_best", "cluster", "cut")
    if settings.collapse:
        reads = dedup.collapse(reads, settings)
    return reads.withColumnRenamed("seq", "read")


def assemble(spark: SparkSession, reads: DataFrame, reference: str, name: str = "reference", matrix: np.ndarray | None = None, settings: Settings = Settings(), each: Callable[[Assembly], None] | None = None) -> Assembly:
    """Run an assembly. ``reads``: ``ord``, ``id``, ``desc``, ``seq``, ``qual``, ``qual_sum``.

    The first pass places reads by the forward matrices and seeds. Then each round places the
    oriented reads on the last consensus with the matrices of their strand, flags redundant
    reads, drops low ones and calls the consensus anew, until it is the one before or
    ``max_rounds`` are done. A read that stayed in its place, and around which the consensus
    stayed the same, is not aligned again, unless reads are merged (``collapse``). ``each`` is
    called with every round's state. Only the consensus comes to the driver.
    """
    forward = scoring.flat(settings) if matrix is None else matrix
    backward = scoring.reverse(forward)
    path = folder(spark)
    scores = scoring.table(spark, forward, backward)
    source = seeded_reads(spark, reads, reference, settings) if settings.kmer is not None else reads
    placed = written(align.first_pass(source, reference, forward, settings), f"{path}/first")
    culled = _cull(placed, reference, settings)
    current, last, rounds, aligned = reference.upper(), None, 0, []
    while True:
        again = _next_reads(culled, settings)
        if rounds == 0 and not settings.distant:
            again = again.filter("score > 0")
        stay = None
        if last is not None and settings.delta and not settings.collapse:
            again = align.with_redo(again, before, current, settings)
            stay = placed.join(again.filter("NOT redo").select("ord"), "ord", "left_semi").select(*placed.columns)
            again = again.filter("redo")
        again = written(again, f"{path}/again-{rounds}")
        aligned = [*aligned, again.count()]
        fresh = align.realign(again, current, forward, backward, settings)
        placed = written(fresh if stay is None else fresh.unionByName(stay), f"{path}/round-{rounds}")
        culled = written(_cull(placed, current, settings), f"{path}/culled-{rounds}")
        alns = culled.filter("unique_best")
        called = pileup.assembly_string(alns, scores, reference_rows(spark, current), settings.cons_code, settings)
        rounds += 1
        done = Assembly(name, current, alns, forward, backward, called, rounds, aligned, settings)
        if each is not None:
            each(done)
        if not settings.iterate or not called or called == last or called == current or rounds > settings.max_rounds:
            return done
        before, last, current = current, called, called
