"""Registered queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from . import fixtures as X
from .config import ADAPTERS, Settings
from .functions import scoring
from .functions import seq as S
from .operators import align, contam, cutoff, dedup, diff, kernel, ordered, pileup, seeds, steps
from .plans import assemble, contamination, report
from .sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def _scores(spark: SparkSession) -> DataFrame:
    return scoring.table(spark, X.matrix())


def _seen(spark: SparkSession, sf: str, scores: DataFrame) -> DataFrame:
    """``scores`` of the classes and letters that placed reads have, with their number ``n``."""
    cells = pileup.bases(X.placed(spark, sf)).groupBy("rc", "depth", S.base_index(F.col("base")).alias("read_b")).agg(F.count("*").alias("n"))
    return cells.join(scores, ["rc", "depth", "read_b"])


def _scratch(spark: SparkSession) -> str:
    return steps.folder(spark)


# Sources and sinks ---------------------------------------------------------------------


def _fasta_lines(spark: SparkSession, sf: str) -> DataFrame:
    return X.docs(spark, sf).select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" from text\n"), writers.wrapped(F.lower("dna"))).alias("value"))


def _fastq_lines(spark: SparkSession, sf: str) -> DataFrame:
    return writers.fastq_lines(X.reads(spark, sf).select("ord", "id", "seq", "qual", F.lit(False).alias("rc"), F.lit(False).alias("trimmed")))


@query("s1_input_kind")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """Files of documents and of reads, told apart by their first byte and read by the reader that fits."""
    path, out = _scratch(spark), None
    _fasta_lines(spark, sf).write.text(f"{path}/one")
    _fastq_lines(spark, sf).select("value").write.text(f"{path}/two")
    for name in ("one", "two"):
        kind = readers.sniff(spark, f"{path}/{name}")
        row = readers.reads(spark, f"{path}/{name}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("seq_len").alias("bases"))
        out = row if out is None else out.unionByName(row)
    return out


@query("s3_fasta_scan")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as FASTA files, read back: ids, cut sequences."""
    path = _scratch(spark) + "/fasta"
    _fasta_lines(spark, sf).write.text(path)
    return readers.fasta(spark, path).select("id", "desc", F.md5("seq").alias("seq_md5"), "seq_len")


@query("s4_fastq_scan")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Reads as FASTQ files, read back: quality sums by document."""
    path = _scratch(spark) + "/fastq"
    _fastq_lines(spark, sf).select("value").write.option("maxRecordsPerFile", 1_000_000).text(path, compression="gzip")
    got = readers.fastq(spark, path)
    return got.groupBy(F.substring("seq", 1, 4).alias("head")).agg(F.count("*").alias("n"), F.sum("qual_sum").alias("qual_sum"), F.sum("seq_len").alias("bases"))


@query("s5_qual_sum")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf).groupBy("doc_id").agg(F.sum(S.qual_sum(F.col("qual"))).alias("qual_sum"))


@query("s6_reference_scan")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark) + "/reference"
    text = X.reference(spark, sf)
    spark.createDataFrame([(f">ref all items\n{text[:41].lower()}{text[41:]}",)], "value string").write.text(path)
    name, rest, seq = readers.reference(spark, path)
    return spark.createDataFrame([(name, rest, seq)], "id string, desc string, seq string").select("id", "desc", F.md5("seq").alias("seq_md5"), F.length("seq").alias("len"), F.md5(S.reverse_complement(F.col("seq"))).alias("rc_md5"))


@query("s7_matrix_file")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix written as a file of 31 blocks, and read back for the letters of placed reads on both strands."""
    path = _scratch(spark) + "/matrix"
    depth, m = Settings().pssm_depth, X.matrix()
    names = [*range(1, depth + 1), "MIDDLE", *range(-depth, 0)]
    blocks = [f"# position: {n}\n" + "\n".join(" ".join(map(str, row)) for row in m[k, :4, :4].tolist()) for k, n in enumerate(names)]
    spark.createDataFrame([("\n".join(blocks),)], "value string").write.text(path)
    text = spark.read.text(path, wholetext=True).first()["value"]
    return _seen(spark, sf, scoring.table(spark, scoring.parse(text))).select("rc", "depth", "read_b", "sa", "sc", "sg", "st", "n")


@query("s15_options")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """A command line for each customer, what it sets, and whether it is refused."""
    lines = F.concat_ws(
        " ",
        F.concat(F.lit("-k "), (F.col("c_custkey") % 18).cast("string")),
        F.concat(F.lit("-H "), F.col("c_nationkey").cast("string")),
        F.when(F.col("c_custkey") % 2 == 0, "-c"),
        F.when(F.col("c_custkey") % 3 == 0, "-U").when(F.col("c_custkey") % 3 == 1, "-u"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("-C "), (F.col("c_nationkey") % 4).cast("string"))),
        F.when(F.col("c_custkey") % 7 == 0, "-D"),
    )
    kinds = "line string, fine boolean, kmer int, dedup string, collapse boolean, tolerance int, circular boolean, distant boolean, hard_cut int"

    def work(batches):
        import pandas as pd

        parser = cli.parser()
        for b in batches:
            out = []
            for line in b["line"]:
                try:
                    o = cli._settings(parser.parse_args(["assemble", "-r", "x", "-f", "y", *line.split()]))
                    out.append((line, True, o.kmer, o.dedup, o.collapse, o.tolerance, o.circular, o.distant, o.hard_cut))
                except ValueError:
                    out.append((line, False, *[None] * 7))
            yield pd.DataFrame(out, columns=[k.split(" ")[0] for k in kinds.split(", ")]).astype(dict.fromkeys(("kmer", "tolerance", "hard_cut"), "Int32") | dict.fromkeys(("collapse", "circular", "distant"), "boolean"))

    return X.table(spark, sf, "customer").select(lines.alias("line")).mapInPandas(work, kinds)


@query("s9_flat_matrix")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the letters of all placed reads, for each reference letter."""
    seen = _seen(spark, sf, scoring.table(spark, scoring.flat()))
    return seen.groupBy("rc", "read_b").agg(*[F.sum(F.col(c) * F.col("n")).cast("bigint").alias(c) for c in ("sa", "sc", "sg", "st")])


@query("s12_newest_sibling")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """Of saved states numbered by regions, the one with the greatest number is found from any of them."""
    path = _scratch(spark)
    numbers = [r["n"] for r in X.table(spark, sf, "region").select((F.col("r_regionkey") * 3 + 1).alias("n")).collect()]
    for n in numbers:
        spark.range(1).select(F.lit("x").alias("value")).write.text(f"{path}/state.{n}")
    found = [(n, readers.newest(spark, f"{path}/state.{n}").rsplit("/", 1)[-1]) for n in sorted(numbers)]
    return spark.createDataFrame(found, "number bigint, newest string")


@query("s10_id_list")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark) + "/ids"
    X.table(spark, sf, "labels").select(F.concat(F.lit("r"), (F.col("doc_id") * 100000).cast("string")).alias("value")).write.text(path)
    return readers.only_listed(X.reads(spark, sf), readers.id_list(spark, path)).select("id", "seq")


@query("s11_assembly_import")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """Placed reads saved as text (K1) and imported."""
    path = _scratch(spark) + "/assembly"
    alns = X.placed(spark, sf)
    ref = X.reference(spark, sf)
    writers.assembly_lines("ref", "", ref, [0] * len(ref), X.matrix(), scoring.reverse(X.matrix()), alns).write.text(path)
    _, got = readers.assembly_text(spark, path)
    ins = F.coalesce(F.get(F.map_values("ins"), F.lit(0)), F.lit(""))
    at = F.coalesce(F.get(F.map_keys("ins"), F.lit(0)), F.lit(-1))
    return got.groupBy("rc", "segment", "dropped").agg(
        F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum(F.length("seq")).alias("bases"),
        F.sum(F.aggregate("smp", F.lit(0), lambda a, x: a + x)).alias("smp"), F.sum(at).alias("ins_at"), F.sum(F.length(ins)).alias("ins_bases"),
    )


@query("k2_fastq_lines")
def k2(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.reads(spark, sf).withColumns({"rc": F.col("doc_id") % 2 == 1, "trimmed": F.col("doc_id") % 3 == 0})
    return writers.fastq_lines(rows).select("ord", F.md5("value").alias("record_md5"))


# Filters -------------------------------------------------------------------------------


@query("f1_id_semijoin")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    named = X.docs(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    ids = X.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return readers.only_listed(named, ids).select("doc_id", F.length("dna").alias("len"))


@query("f2_seed_filter")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    kept = seeds.seeded(X.reads(spark, sf), _index(spark, sf, 12), 12)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f3_soft_mask")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    masked = X.table(spark, sf, "benchmark").select(F.lit("f").alias("strand"), F.concat(F.lower(F.substring(S.dna(F.col("text")), 1, 40)), F.expr("substring(translate(upper(regexp_replace(text, '[^A-Za-z]', '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC'), 41)")).alias("seq"))
    return seeds.index(masked, 8, True, 1 << 30).groupBy("code").agg(F.count("*").alias("n"))


def _placed_items(spark: SparkSession, sf: str, settings: Settings) -> DataFrame:
    """Reads of all items on the whole reference where seeds open it."""
    ref = X.reference(spark, sf)
    return align.first_pass(assemble.seeded_reads(spark, X.item_reads(spark, sf), ref, settings), ref, scoring.flat(), settings)


@query("f4_f5_score_filters")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    """The first pass drops reads below its first score."""
    kept = _placed_items(spark, sf, Settings(kmer=12, first_score=12_000))
    return kept.groupBy("rc").agg(F.count("*").alias("n"), F.min("score").alias("low"))


@query("f7_alignable_length")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    part = F.replace("seq", F.lit("ACC"), F.lit("NNN"))
    r = X.reads(spark, sf).select("doc_id", S.alignable_length(F.col("len"), part).alias("n"))
    return r.groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("alignable"))


@query("f9_f11_overlap")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    p = X.placed(spark, sf)
    s, e = F.col("start"), F.col("end")
    return p.groupBy("rc").agg(
        F.count_if(S.covers(s, e, F.lit(1000))).alias("covering"), F.count_if(S.covers_gap(s, e, F.lit(1000))).alias("gap_covering"), F.count_if(S.overlaps(s, e, F.lit(900), F.lit(1100))).alias("overlapping")
    )


@query("f12_f16_symbols")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of symbols that stand side by side in texts, and what they have in common."""
    # Letters that are no symbol are gaps; what is no letter does not part its neighbours.
    symbols = "-ABCDGHKMNRSTVWY"
    number = np.full(256, -1, dtype=np.int64)
    for k in range(26):
        number[[65 + k, 97 + k]] = max(symbols.find(chr(65 + k)), 0)
    size = len(symbols)

    def work(batches):
        for batch in batches:
            counts = np.zeros(size * size, dtype=np.int64)
            for data, bounds in seeds.joined(batch.column(0)):
                codes = number[data]
                have = np.concatenate([[0], np.cumsum(codes >= 0)])
                codes = codes[codes >= 0]
                within = np.ones(len(codes), dtype=bool)
                within[(have[bounds] - 1)[have[bounds] > 0]] = False
                counts += np.bincount((codes[:-1] * size + codes[1:])[within[:-1]], minlength=size * size)
            found = np.flatnonzero(counts)
            letters = np.asarray(list(symbols))
            yield pa.RecordBatch.from_arrays([pa.array(letters[found // size], pa.string()), pa.array(letters[found % size], pa.string()), pa.array(counts[found])], ["a", "b", "n"])

    text = X.table(spark, sf, "documents").select("text").repartition(spark.sparkContext.defaultParallelism)
    pair = text.mapInArrow(work, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    a, b = F.col("a"), F.col("b")
    return pair.select("a", "b", "n", a.isin(*"ACGT").alias("valid"), S.compatible(a, b).alias("compatible"), S.is_transversion(a, b).alias("transversion"), S.consistent(a, b).alias("consistent"), S.consistent(a, b, True).alias("consistent_ancient"))


@query("f17_least_sites")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    return contam.classify(_observed(spark, sf), 3, "user_id").groupBy("klass").agg(F.count("*").alias("n"))


@query("f18_span")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of a span only, all of them and transversions only; the span is the feature."""
    columns = _site_columns(spark, sf)
    count = lambda only: contam.diagnostic(columns, only, 1001, 3000).groupBy("strength").agg(F.lit(only).alias("transversions_only"), F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return count(False).unionByName(count(True))


@query("f20_sequence_check")
def f20(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of each text: is it a sequence?"""
    words = X.table(spark, sf, "documents").select(F.explode(F.split("text", "[ \\t\\n\\f\\r]+")).alias("word")).filter("word <> ''")
    return words.groupBy(S.is_sequence(F.col("word")).alias("ok")).agg(F.count("*").alias("n"))


# Joins ---------------------------------------------------------------------------------


def _index(spark: SparkSession, sf: str, k: int) -> DataFrame:
    items = X.table(spark, sf, "benchmark").select(F.lit("f").alias("strand"), "item_id", S.dna(F.col("text")).alias("seq"))
    both = items.unionByName(items.select(F.lit("r").alias("strand"), "item_id", S.reverse_complement(F.col("seq")).alias("seq")))
    each = both.select("strand", "item_id", F.posexplode(S.kmers(F.col("seq"), k)).alias("at", "kmer"))
    return each.select("strand", S.kmer_code(F.col("kmer")).alias("code"), (F.col("item_id") * 100000 + F.col("at")).alias("pos"))


@query("j1_seed_join")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    index = seeds.first_places(_index(spark, sf, 12))
    found = seeds.hits(X.reads(spark, sf), index, 12)
    return found.groupBy("ord", "strand").agg(F.count("*").alias("hits"), F.min("pos").alias("first_pos"), F.max("offset").alias("last_offset"))


@query("j2_seed_windows")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    index = seeds.first_places(_index(spark, sf, 12).withColumn("pos", F.col("pos") % 100000))
    found = seeds.windows(seeds.hits(X.reads(spark, sf), index, 12), 400)
    wide = F.aggregate("spans", F.lit(0), lambda a, s: a + s["hi"] - s["lo"] + 1)
    return found.select("ord", "strand", F.size("spans").alias("spans"), wide.alias("width"), "whole")


@query("w8_kmer_cap")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    capped = seeds.first_places(_index(spark, sf, 4), 128)
    return capped.groupBy("strand", "code").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query("j4_strand_choice")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """Strands that the first pass chose, of reads of which every second one is reversed."""
    placed = _placed_items(spark, sf, Settings(kmer=12, distant=True))
    return placed.groupBy("rc", (F.col("ord") % 2 == 1).alias("reversed")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("j5_realign")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    """Oriented reads placed anew near where they were, by position-specific matrices of their strand."""
    reads = X.oriented_items(spark, sf)
    placed = align.realign(reads, X.reference(spark, sf), X.matrix(), scoring.reverse(X.matrix()))
    return placed.select("ord", "score", "rc", "start", "end", "seq", _insertions().alias("ins"), F.array_join("smp", ",").alias("smp"))


def _insertions() -> Column:
    return F.array_join(F.transform(F.sort_array(F.map_entries("ins")), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"])), ",")


@query("j6_interval_coverage")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.coverage(X.placed(spark, sf).select("rc", "start", "end"), "rc")


@query("j7_diagnostic_join")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    """Bases of all placed reads at the sites of the whole reference."""
    return contam.site_counts(X.placed(spark, sf), _sites(spark, sf), True)


@query("j8_half_merge")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    """All line items: each pair of lines of an order is a read's halves."""
    klass = F.element_at(F.array(*[F.lit(k) for k in contam.LABELS]), (F.col("l_partkey") % 5 + 1).cast("int"))
    klass2 = F.element_at(F.array(*[F.lit(k) for k in contam.LABELS]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    name = F.concat_ws(".", F.col("l_orderkey").cast("string"), F.expr("(l_linenumber + 1) div 2").cast("string"))
    rows = X.table(spark, sf, "lineitem").select(name.alias("name"), F.when(F.col("l_linenumber") % 2 == 1, "f").otherwise("b").alias("segment"), klass.alias("klass"), klass2.alias("klass2"), F.col("l_quantity").cast("bigint").alias("sites"))
    rows = rows.groupBy("name", "segment").agg(F.min("klass").alias("klass"), F.max("klass2").alias("klass2"), F.min("sites").alias("sites"))
    return contam.merge_halves(rows)


@query("j10_lift_over")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    ref = X.reference(spark, sf)
    pair = assemble.reference_rows(spark, ref).select(F.col("pos").alias("col"), F.when(F.col("pos") % 17 == 3, "-").otherwise(F.col("ref_base")).alias("assembly"), F.when(F.col("pos") % 23 == 5, "-").otherwise(F.col("ref_base")).alias("contaminant"))
    return contam.aligned_columns(pair).select("col", "pos", "dirt_pos")


@query("j11_score_lookup")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    counted = pileup.count_bases(pileup.bases(X.placed(spark, sf)), _scores(spark), "rc", "depth")
    return counted.select("rc", "depth", "cov", "gaps", "sa", "sc", "sg", "st")


# Aggregates ----------------------------------------------------------------------------


@query("a1_pileup")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.positions(X.placed(spark, sf), _scores(spark))


def _called(spark: SparkSession, sf: str, code: int) -> DataFrame:
    return pileup.call(pileup.positions(X.placed(spark, sf), _scores(spark)), code)


@query("a2_consensus")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return _called(spark, sf, 1).select("pos", "cons", F.round("frac_agree", 9).alias("frac_agree"))


@query("a2_consensus_strict")
def a2s(spark: SparkSession, sf: str) -> DataFrame:
    return _called(spark, sf, 2).select("pos", "cons")


@query("a3_phred")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        pileup.phred((F.col("l_quantity") * 10).cast("bigint"), (F.col("l_partkey") % 500).cast("bigint"), (F.col("l_suppkey") % 70 * 5).cast("bigint"), (F.col("l_linenumber") * 60).cast("bigint")).alias("phred"),
    )


@query("a4_insertions")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.call(pileup.insertions(X.placed(spark, sf), _scores(spark))).select("pos", "ins_idx", *pileup.COUNTS, "cons")


@query("a5_consensus_string")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    ref = assemble.reference_rows(spark, X.reference(spark, sf))
    c = pileup.columns(X.placed(spark, sf), _scores(spark), ref, only_kept=True).filter("NOT (pos = 0 AND ins_idx >= 0)")
    return pileup.consensus(c)


@query("a6_gapped_consensus")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    c = _columns(spark, sf)
    return pileup.consensus(c, gapped=True)


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.columns(X.placed(spark, sf), _scores(spark), assemble.reference_rows(spark, X.reference(spark, sf)))


@query("a7_gap_lengths")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.gap_lengths(X.placed(spark, sf))


@query("a8_start_end_hist")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.ends(X.placed(spark, sf))


@query("a9_summary")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.summary(X.placed(spark, sf), X.SPAN)


@query("a10_consensus_length")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.gap_lengths(X.placed(spark, sf)).agg((F.sum("gap") + X.SPAN).alias("length"))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return X.reads(spark, sf).withColumn("cluster", F.col("doc_id") % 200)


@query("a11_quality_collapse")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    sums = dedup.base_sums(_clusters(spark, sf))
    best = dedup.best_bases(sums).groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "base"))), lambda x: x["base"]), "").alias("called"))
    return best.join(sums.groupBy("cluster").agg(F.sum("weight").alias("weight")), "cluster")


@query("a12_collapse")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup.collapse(dedup.flag_unique(_coordinates(spark, sf).withColumns({"cut": F.lit(20.0), "num_inputs": F.lit(1), "qual": F.lit(None).cast("string"), "seq": F.lit("ACGT")})))
    return out.select("ord", "num_inputs", "unique_best")


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events")
    return e.select("user_id", F.when(F.col("event_id") % 3 == 0, 3).otherwise(2).alias("strength"), (F.col("event_id") % 4 != 1).alias("clean"), (F.col("event_id") % 7 < 2).alias("dirt"))


@query("a14_read_class")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return contam.classify(_observed(spark, sf), 1, "user_id")


@query("a15_class_histogram")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    c = contam.classify(_observed(spark, sf), 1, "user_id")
    return c.groupBy("klass", "klass2").agg(F.count("*").alias("n"))


@query("a16_wilson_interval")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    n = X.table(spark, sf, "labels").join(X.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    w = contam.wilson(F.col("k"), F.col("n"))
    return n.select("source", *[F.round(w[c], 9).alias(c) for c in ("estimate", "low", "high")])


def _site_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The whole reference beside a contaminant that has other letters at every third of nine positions."""
    ref = assemble.reference_rows(spark, X.reference(spark, sf))
    other = F.when(F.col("pos") % 9 == 0, F.translate("ref_base", "ACGT", "GTAC")).when(F.col("pos") % 9 == 4, F.translate("ref_base", "ACGT", "RMKB")).when(F.col("pos") % 9 == 7, F.translate("ref_base", "ACGT", "CAAA")).otherwise(F.col("ref_base"))
    return contam.aligned_columns(ref.select(F.col("pos").alias("col"), F.col("ref_base").alias("assembly"), other.alias("contaminant")))


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return contam.diagnostic(_site_columns(spark, sf))


@query("a17_diagnostic_sites")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    s = _sites(spark, sf)
    return s.groupBy("strength").agg(F.count("*").alias("n"), F.count_if(S.is_transversion(F.col("assembly"), F.col("contaminant"))).alias("transversions"))


@query("a18_majority")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return _majority(spark, sf, 70, "gaps")


@query("a18_majority_strict")
def a18s(spark: SparkSession, sf: str) -> DataFrame:
    return _majority(spark, sf, 50, "strict")


def _majority(spark: SparkSession, sf: str, per_cent: int, style: str) -> DataFrame:
    rows = X.reads(spark, sf).select((F.col("doc_id") % 50).alias("block"), F.replace("seq", F.lit("GAT"), F.lit("G-T")).alias("seq"))
    each = pileup.letters(rows, "seq", "block").withColumnRenamed("k", "pos").drop("seq")
    return pileup.majority(each, per_cent, style, "block")


@query("a19_symbol_sets")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    """The sets of letters of reads, twelve at a time, and their symbols."""
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("len") - 1) / 12)))
    part = X.reads(spark, sf).select("seq", k.alias("k")).select(F.substring("seq", (F.col("k") * 12 + 1).cast("int"), F.lit(12)).alias("part"))
    bases = F.concat(*[F.when(F.contains("part", F.lit(b)), b).otherwise("") for b in "ACGT"])
    table = F.create_map(*[F.lit(x) for item in pileup.AMBIGUITY.items() for x in item])
    return part.groupBy(bases.alias("bases")).agg(F.count("*").alias("n")).select("bases", F.element_at(table, F.col("bases")).alias("symbol"), "n")


# Order, windows, cutoff ----------------------------------------------------------------


def _coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned reads from line items: strand, start, end, score, quality."""
    li = X.table(spark, sf, "lineitem")
    return li.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("ord"), (F.col("l_returnflag") == "R").alias("rc"), (F.col("l_partkey") % 97).cast("int").alias("as"),
        (F.col("l_partkey") % 97 + 30 + F.col("l_suppkey") % 5).cast("int").alias("ae"), F.col("l_quantity").cast("int").alias("score"), (F.col("l_orderkey") % 61).cast("int").alias("qual_sum"), (F.col("l_linestatus") == "F").alias("trimmed"),
    )


@query("w1_read_order")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.numbered(_coordinates(spark, sf), _scratch(spark) + "/order", ["rc"], dedup.order()[1:]).select("ord", "place")


@query("w2_dedup_exact")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.flag_unique(_coordinates(spark, sf)).select("ord", "unique_best", "cluster")


@query("w1q_dedup_quality")
def w1q(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.flag_unique(_coordinates(spark, sf), by="quality").filter("unique_best").select("ord")


@query("w2_dedup_tolerance")
def w2t(spark: SparkSession, sf: str) -> DataFrame:
    rows = _coordinates(spark, sf).withColumns({"as": (F.col("ord") % 1000003).cast("int"), "ae": (F.col("ord") % 1000003 + 30 + F.col("ord") % 5).cast("int")})
    return dedup.flag_unique(rows, tolerance=40, outer_only=False).select("ord", "unique_best")


@query("w3_placed_order")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.placed(spark, sf).select("ord", "segment", "start", "end")
    return dedup.numbered(rows, _scratch(spark) + "/order", ["segment"], dedup.PLACED_ORDER).select("ord", "place")


@query("w4_homopolymers")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal bases as the kernel finds them, counted by base and length."""

    def work(batches):
        import pandas as pd

        for b in batches:
            # A sign between texts ends their runs.
            letters = kernel.letters_of(["\n".join(b["dna"].fillna(""))])
            start, size = kernel.runs_of(letters)
            heads = (start[0] == np.arange(letters.shape[1])) & (letters[0] != ord("\n"))
            pairs, n = np.unique(np.stack([letters[0][heads], size[0][heads]]), axis=1, return_counts=True)
            yield pd.DataFrame({"base": [chr(x) for x in pairs[0]], "len": pairs[1].astype("int32"), "n": n})

    each = X.docs(spark, sf).select("dna").mapInPandas(work, "base string, len int, n bigint")
    return each.groupBy("base", "len").agg(F.sum("n").alias("n"))


@query("w5_gap_prefix")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.gaps_before(pileup.gap_lengths(X.placed(spark, sf)))


@query("w7_matrix_class")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    each = X.placed(spark, sf).select(F.length("seq").alias("len"), F.posexplode_outer("smp").alias("k", "depth"))
    return each.groupBy("len", "depth").agg(F.count("*").alias("n"), F.sum("k").alias("places"))


@query("g4_cutoff_line")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    line = cutoff.fitted_line(_lengths(spark, sf), Settings(first_score=500))
    return line.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    li = X.table(spark, sf, "lineitem")
    score = (F.col("l_quantity") * 180 + F.col("l_partkey") % 1000).cast("int")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("len"), score.alias("score"), (F.col("l_linenumber") <= 3).alias("unique_best"))


@query("f6_length_score_cull")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff.cull(_lengths(spark, sf), Settings(first_score=500)).groupBy("dropped").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


# Scalars -------------------------------------------------------------------------------


@query("x1_base_index")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    each = pileup.letters(X.placed(spark, sf), "seq").select("base")
    return each.groupBy("base", S.base_index(F.col("base")).alias("inx")).agg(F.count("*").alias("n"))


@query("x2_kmer_index")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    each = X.docs(spark, sf).select("doc_id", F.explode(S.kmers(F.col("dna"), 8)).alias("kmer")).select("doc_id", S.kmer_code(F.col("kmer")).alias("code"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("code").alias("total"), F.max("code").alias("most"))


@query("x4_revcomp")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    return X.docs(spark, sf).select("doc_id", F.md5(S.reverse_complement(F.col("dna"))).alias("rc_md5"), F.md5(S.reverse_complement(S.reverse_complement(F.col("dna")))).alias("twice_md5"))


@query("x5_mirror_position")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "part").select("p_partkey", S.mirror_position(F.col("p_partkey") * 7, F.lit(500)).alias("mirrored"))


@query("x6_ref_wrap")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "benchmark").select("item_id", F.upper(S.wrap(S.dna(F.col("text")), 256)).alias("wrapped"))


@query("x8_iupac_bitmap")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    each = X.table(spark, sf, "benchmark").select("item_id", F.explode(letters).alias("c"))
    return each.groupBy("item_id").agg(F.sum(S.iupac_mask(F.col("c"))).alias("bits"))


@query("x9_homopolymer_penalty")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    li = X.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("gap"), (F.col("l_quantity") % 13).cast("int").alias("run")).distinct()
    return li.select("gap", "run", S.homopolymer_penalty(F.col("gap"), F.col("run")).alias("penalty"))


@query("x10_row_class")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    r = X.reads(spark, sf).select("len").distinct().select("len", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("row"))
    return r.select("len", "row", S.row_class(F.col("row"), F.col("len")).alias("depth"))


@query("x11_reverse_matrix")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    """Matrices of both strands at the classes and letters of placed reads."""
    return _seen(spark, sf, _scores(spark)).select("rc", "depth", "read_b", "sa", "sc", "sg", "st", "n")


@query("x12_adapter_trim")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    """Adapters joined to all reads of whole texts, and to whole items with negative orders, are found again."""
    flat = scoring.flat()

    def work(batches):
        import pandas as pd

        for b in batches:
            points = kernel.trim_points(b["seq"].tolist(), ADAPTERS["n"], flat)
            yield pd.DataFrame({"ord": b["ord"], "expected": b["cut"], "trim_point": points}).astype({"trim_point": "Int64"})

    texts = X.reads(spark, sf).select("ord", "seq")
    items = X.table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("ord"), S.dna(F.col("text")).alias("seq"))
    rows = texts.unionByName(items).select("ord", F.length("seq").cast("bigint").alias("cut"), F.concat("seq", F.lit(ADAPTERS["n"])).alias("seq"))
    return rows.mapInPandas(work, "ord bigint, expected bigint, trim_point bigint")


@query("x13_adapters")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    """What the first letters of texts stand for, from none to more than an adapter may have."""

    def work(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "adapter": [Settings(adapter=a).adapter_sequence for a in b["asked"]]})

    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    asked = X.table(spark, sf, "documents").select("doc_id", F.substring(letters, F.lit(1), (F.col("doc_id") % 140).cast("int")).alias("asked"))
    return asked.mapInPandas(work, "doc_id bigint, adapter string")


@query("x14_split")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    """Reads dealt over a circle of positions, cut where they pass its end."""

    def work(batches):
        import pandas as pd

        for b in batches:
            out = []
            for start, seq in zip(b["start"].tolist(), b["seq"].tolist(), strict=True):
                ins = {start + 3: seq[:2]} if len(seq) > 5 else {}
                out += [(g, s, e, t, *(next(iter(x.items())) if x else (-1, ""))) for g, s, e, t, x in kernel.split_at(start, start + len(seq) - 1, seq, ins, X.SPAN)]
            yield pd.DataFrame(out, columns=["segment", "start", "end", "seq", "at", "ins"])

    rows = X.reads(spark, sf).select(((F.col("doc_id") * 131 + F.col("i") * 50) % X.SPAN).cast("int").alias("start"), "seq")
    each = rows.mapInPandas(work, "segment string, start int, end int, seq string, at int, ins string")
    return each.groupBy("segment", F.substring("seq", 1, 2).alias("head"), "ins").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum(F.length("seq")).alias("bases"), F.sum("at").alias("at"))


@query("x17_plain_name")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.element_at(F.array(F.lit(""), F.lit("_f"), F.lit(",_b"), F.lit("_x")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return X.table(spark, sf, "part").select("p_partkey", S.plain_name(name).alias("name"))


# Reports -------------------------------------------------------------------------------


@query("k3_clustal")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    return report.clustal(_columns(spark, sf), "reference")


@query("k4_line")
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return report.line(_columns(spark, sf))


@query("k5_table")
def k5(spark: SparkSession, sf: str) -> DataFrame:
    return report.table(_columns(spark, sf), X.placed(spark, sf)).drop("place")


@query("k6_details")
def k6(spark: SparkSession, sf: str) -> DataFrame:
    return report.details(_columns(spark, sf)).withColumn("frac_agree", F.round("frac_agree", 9))


@query("k6_details_all")
def k6a(spark: SparkSession, sf: str) -> DataFrame:
    """Format 41: every column."""
    return report.details(_columns(spark, sf), False).withColumn("frac_agree", F.round("frac_agree", 9))


@query("k7_fasta")
def k7(spark: SparkSession, sf: str) -> DataFrame:
    return report.fasta(_columns(spark, sf))


def _assembly(spark: SparkSession, sf: str) -> assemble.Assembly:
    return assemble.Assembly("reference", X.reference(spark, sf), X.placed(spark, sf), X.matrix(), scoring.reverse(X.matrix()))


@query("k8_region")
def k8(spark: SparkSession, sf: str) -> DataFrame:
    return report.region(_assembly(spark, sf), 900, 960).select("start", "end", "name", "text")


@query("k8_region_fasta")
def k8f(spark: SparkSession, sf: str) -> DataFrame:
    """Format 61, with the ends of the region swapped."""
    return report.region(_assembly(spark, sf), 960, 900, fasta_style=True).select("start", "end", "value")


@query("k9_colour")
def k9(spark: SparkSession, sf: str) -> DataFrame:
    return report.region(_assembly(spark, sf), 900, 960, colour=True).select("start", "end", "value")


@query("x18_region")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as text, from either end."""

    def work(batches):
        import pandas as pd

        for b in batches:
            found = [cli.region(t) for t in b["t"]]
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "low": [x[0] for x in found], "high": [x[1] for x in found]})

    t = F.concat_ws(":", (F.col("c_custkey") % 97).cast("string"), (F.col("c_nationkey") * 4).cast("string"))
    return X.table(spark, sf, "customer").select("c_custkey", t.alias("t")).mapInPandas(work, "c_custkey bigint, low bigint, high bigint")


@query("k10_ace")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    return report.ace(_assembly(spark, sf))


@query("k11_contamination_report")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    r = contam.report(contam.classify(_observed(spark, sf), 1, "user_id"), "klass2")
    return r.select(*contam.LABELS.values(), *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")])


# Kernel and iteration ------------------------------------------------------------------


@query("j3_align")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of whole texts placed on the whole reference, where seeds open it; both strands are tried."""
    settings = Settings(kmer=12, distant=True)
    ref = X.reference(spark, sf)
    reads = X.reads(spark, sf).withColumn("qual_sum", S.qual_sum(F.col("qual")))
    placed = align.first_pass(assemble.seeded_reads(spark, reads, ref, settings), ref, scoring.flat(), settings)
    return placed.select("ord", "score", "rc", "start", "end", F.length("seq").alias("len"))


@query("i3_cull")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    """Placed reads of all items: which are the best of their place, and which fall below the line of scores."""
    settings = Settings(kmer=12, dedup="score")
    culled = assemble._cull(_placed_items(spark, sf, settings), X.reference(spark, sf), settings)
    return culled.select("ord", "unique_best", "cluster", "dropped")


@query("j3_align_items")
def j3i(spark: SparkSession, sf: str) -> DataFrame:
    """Edited reads of all items, of either strand, on the whole reference: places, letters and insertions."""
    placed = _placed_items(spark, sf, Settings(kmer=12, distant=True))
    return placed.select("ord", "score", "rc", "start", "end", "seq", _insertions().alias("ins"))


@query("x9_homopolymer_align")
def x9a(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a run of each read one letter short and one a letter long, under the discount for gaps within runs."""
    ref, settings = X.reference(spark, sf), Settings(kmer=12, distant=True, homopolymer=True)
    seq = F.regexp_replace(F.regexp_replace("seq", "^([ACGT]*?)AA", "$1A"), "^([ACGT]*?)CC", "$1CCC")
    reads = X.item_reads(spark, sf).withColumn("seq", seq).withColumn("len", F.length("seq"))
    placed = align.first_pass(assemble.seeded_reads(spark, reads, ref, settings), ref, scoring.flat(), settings)
    return placed.select("ord", "score", "rc", "start", "end", "seq", _insertions().alias("ins"))


@query("j9_pair_items")
def j9i(spark: SparkSession, sf: str) -> DataFrame:
    """Each whole item against the next: distance, and what the two gapped rows say about it."""

    def work(batches):
        import pandas as pd

        for b in batches:
            out, both = [], list(zip(b["dna"], b["other"], strict=True))
            found = diff.align_pairs(both, [len(one) + len(two) + 1 for one, two in both])
            for k, (one, two), (d, x, y) in zip(b["item_id"], both, found, strict=True):
                out.append((k, d, sum(p != q for p, q in zip(x, y, strict=True)), x.replace("-", "") == one and y.replace("-", "") == two))
            yield pd.DataFrame(out, columns=["item_id", "distance", "cost", "whole"])

    items = X.table(spark, sf, "benchmark").select("item_id", S.dna(F.col("text")).alias("dna"))
    numbered = ordered.running_sums(items, "item_id", {"number": F.lit(1)})
    following = numbered.select((F.col("number") - 1).alias("number"), F.col("dna").alias("other"))
    pairs = numbered.join(following, "number").filter("other IS NOT NULL")
    return pairs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(work, "item_id bigint, distance bigint, cost bigint, whole boolean")


@query("j9_pair_distance")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    ref = X.reference(spark, sf)
    other = "".join(c for k, c in enumerate(ref) if k % 211 != 7)
    d, a, b = diff.align_pair(ref, other)
    return spark.createDataFrame([(d, len(a), a.count("-"), b.count("-"))], "distance bigint, columns bigint, gaps_a bigint, gaps_b bigint")


@query("i2_iterate")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of whole texts, and reads over the whole reference, bring a changed reference back to the benchmark's letters."""
    truth = X.reference(spark, sf)
    changed = "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[c] if k % 60 == 31 else c for k, c in enumerate(truth))
    columns = ["ord", "id", "desc", "seq", "qual", "qual_sum"]
    texts = X.reads(spark, sf).withColumn("qual_sum", S.qual_sum(F.col("qual")).cast("int")).select(*columns)
    last = F.lit(len(truth) - 100)
    one = spark.createDataFrame([(truth,)], "t string").select("t", F.explode(F.array_union(F.sequence(F.lit(0), last, F.lit(5)), F.array(last))).alias("at"))
    # Texts have orders from 0 on, so reads of the reference have those below.
    own = one.select((-1 - F.col("at")).cast("bigint").alias("ord"), F.concat(F.lit("b"), F.col("at").cast("string")).alias("id"), F.lit("").alias("desc"), F.substring("t", F.col("at") + 1, F.lit(100)).alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit(None).cast("int").alias("qual_sum"))
    # Reads with less than 40 matching letters, as texts have by chance, do not vote.
    done = assemble.assemble(spark, texts.unionByName(own), changed, settings=Settings(kmer=10, first_score=8000))
    return spark.createDataFrame([(done.consensus, done.consensus == truth)], "consensus string, recovered boolean")


def _mixture(spark: SparkSession, sf: str) -> tuple[str, str, DataFrame]:
    """The whole reference, a contaminant, and placed reads of either, of both, and of neither."""
    truth = X.reference(spark, sf)
    strong, third, weak, other = (dict(zip("ACGT", x, strict=True)) for x in ("CATG", "GTAC", "RYRY", "GTAC"))
    at = range(len(truth))
    contaminant = "".join(strong[c] if k % 60 == 29 else weak[c] if k % 60 == 59 else c for k, c in zip(at, truth, strict=True))
    dirty = "".join(strong[c] if k % 60 == 29 else other[c] if k % 60 == 59 else c for k, c in zip(at, truth, strict=True))
    odd = "".join(third[c] if k % 60 == 29 else c for k, c in zip(at, truth, strict=True))
    one = spark.createDataFrame([(truth, dirty, odd)], "t string, d string, o string")
    each = one.select("t", "d", "o", F.explode(F.sequence(F.lit(0), F.lit((len(truth) - 100) // 50))).alias("k"))
    part = lambda c, a, n: F.substring(c, F.col("k") * 50 + a, F.lit(n))
    seq = F.when(F.col("k") % 4 == 0, part("t", 1, 100)).when(F.col("k") % 4 == 1, part("d", 1, 100)).when(F.col("k") % 4 == 2, F.concat(part("t", 1, 50), part("d", 51, 50))).otherwise(part("o", 1, 100))
    half = F.when(F.col("k") % 10 == 8, "f").when(F.col("k") % 10 == 9, "b").otherwise("a")
    name = F.concat(F.lit("q"), (F.col("k") - (half == "b").cast("int")).cast("string"), F.when(half == "f", "_f").when(half == "b", "_b").otherwise(""))
    alns = each.select(name.alias("id"), half.alias("segment"), (F.col("k") * 50).alias("start"), (F.col("k") * 50 + 99).alias("end"), seq.alias("seq"), F.expr("cast(map() AS map<int,string>)").alias("ins"))
    return truth, contaminant, alns


@query("i4_check_classes")
def i4(spark: SparkSession, sf: str) -> DataFrame:
    """The whole check: weak sites that a read upgrades, classes of reads, halves merged."""
    truth, contaminant, alns = _mixture(spark, sf)
    found = contamination.check(spark, alns, truth, contaminant)
    return found.reads.groupBy("klass", "klass2").agg(F.count("*").alias("n"), F.sum("sites").cast("bigint").alias("sites"))


@query("f19_safety_stop")
def f19(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of the reference from its start: too few strong positions stop the estimate, unless it is forced."""
    truth, contaminant, alns = _mixture(spark, sf)
    out = []
    for last in (600, 2369, 2370, len(truth)):
        for force in (False, True):
            try:
                contamination.check(spark, alns, truth, contaminant, span=(1, last), force=force)
                out.append((last, force, False))
            except contamination.TooFewSites:
                out.append((last, force, True))
    return spark.createDataFrame(out, "last bigint, force boolean, stopped boolean")
