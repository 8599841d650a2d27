"""Pileup of placed reads by position, the weighted vote, and ordered consensus strings.

The letters of a batch of reads are counted by position, and the counts are grouped; no
interval join is made. The sums are combined before the shuffle, so a deep position is no
hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import seq as S
from . import ordered

COUNTS = ["cov", "na", "nc", "ng", "nt", "gaps", "sa", "sc", "sg", "st"]


def letters(df: DataFrame, seq: str, *keep: str) -> DataFrame:
    """``keep`` with one row for each letter of a short sequence: ``k`` from 0 and ``base``.

    Places are generated and letters cut out by place, which stays in generated code; an
    array of letters would be built in interpreted steps.
    """
    each = df.filter(F.length(seq) > 0).select(*keep, seq, F.explode(F.sequence(F.lit(0), F.length(seq) - 1)).alias("k"))
    return each.withColumn("base", F.substring(F.col(seq), F.col("k") + 1, F.lit(1)))


def bases(alns: DataFrame) -> DataFrame:
    """(``pos``, ``base``, ``depth``, ``rc``): one row for each column of each placed read."""
    each = letters(alns, "seq", "start", "rc", "smp")
    return each.select((F.col("start") + F.col("k")).alias("pos"), "base", F.get("smp", F.col("k")).alias("depth"), "rc")


def inserted(alns: DataFrame) -> DataFrame:
    """(``pos``, ``ins_idx``, ``base``, ``depth``, ``rc``): one row for each inserted base."""
    each = alns.select("start", "rc", "smp", F.explode("ins").alias("pos", "text"))
    each = each.select("pos", "rc", F.get("smp", F.col("pos") - F.col("start")).alias("depth"), F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("ins_idx", "base"))
    return each.select("pos", "ins_idx", "base", "depth", "rc")


def count_bases(each: DataFrame, scores: DataFrame, *keys: str) -> DataFrame:
    """Counts and weighted score sums by ``keys``; every character counts as coverage, a gap has no score."""
    # One integer key lets the join use the fast table for long keys.
    key = lambda b: F.col("rc").cast("bigint") * 1000 + F.col("depth") * 5 + b
    fixed = scores.select(key(F.col("read_b")).alias("__key"), "sa", "sc", "sg", "st")
    joined = each.withColumn("__key", key(S.base_index(F.col("base")))).join(F.broadcast(fixed), "__key", "left")
    gap = F.col("base") == "-"
    score = lambda c: F.sum(F.when(gap, F.lit(0)).otherwise(F.col(c))).cast("bigint").alias(c)
    return joined.groupBy(*keys).agg(
        F.count("*").alias("cov"),
        *[F.count_if(F.col("base") == b).alias(f"n{b.lower()}") for b in "ACGT"],
        F.count_if(gap).alias("gaps"),
        *[score(c) for c in ("sa", "sc", "sg", "st")],
    )


def positions(alns: DataFrame, scores: DataFrame) -> DataFrame:
    """:func:`count_bases` by ``pos`` for all columns of placed reads, a row for each position and batch of reads."""
    rows = scores.select("rc", "depth", "read_b", "sa", "sc", "sg", "st").collect()
    depths = max((r["depth"] for r in rows), default=0) + 1
    # Scores of reference bases by strand, class and read base, of which 5 is a gap; an unknown class has none.
    table = np.zeros((4, 2, depths + 1, 6), dtype=np.float64)
    for r in rows:
        table[:, int(r["rc"]), r["depth"], r["read_b"]] = r["sa"], r["sc"], r["sg"], r["st"]
    table = table.reshape(4, -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, bounds = _read_bases(batch["seq"])
            if not len(bases):
                continue
            size = np.diff(bounds)
            k = np.arange(len(bases)) - np.repeat(bounds[:-1], size)
            pos = k + np.repeat(batch["start"].to_numpy().astype(np.int64), size)
            smp = batch["smp"]
            first = smp.offsets.to_numpy().astype(np.int64)
            known = k < np.repeat(np.diff(first), size)
            depth = np.full(len(bases), depths, dtype=np.int64)
            depth[known] = smp.values.fill_null(depths).to_numpy()[(k + np.repeat(first[:-1], size))[known]]
            depth[(depth < 0) | (depth > depths)] = depths
            # Many reads lie over few positions; where they are far apart, positions are numbered.
            low = int(pos.min())
            span = int(pos.max()) - low + 1
            if span <= 4 * len(pos):
                at, own = pos - low, np.arange(low, low + span)
            else:
                own, at = np.unique(pos, return_inverse=True)
            cell = (np.repeat(batch["rc"].to_numpy(zero_copy_only=False).astype(np.int64), size) * (depths + 1) + depth) * 6 + bases
            counts = np.bincount(at * 6 + bases, minlength=len(own) * 6).reshape(-1, 6)
            sums = [np.bincount(at, t[cell], len(own)).astype(np.int64) for t in table]
            have = np.flatnonzero(counts.sum(axis=1))
            cols = [own, counts.sum(axis=1), *counts[:, :4].T, counts[:, 5], *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c[have], pa.int32() if n == "pos" else pa.int64()) for n, c in zip(["pos", *COUNTS], cols, strict=True)], ["pos", *COUNTS])

    each = alns.select("start", "seq", "rc", "smp").mapInArrow(work, "pos int, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return each.groupBy("pos").agg(*[F.sum(c).alias(c) for c in COUNTS])


_BASES = np.full(256, 4, dtype=np.int64)
for _k, _b in ((0, "A"), (1, "C"), (2, "G"), (3, "T"), (5, "-")):
    _BASES[ord(_b)] = _k


def _read_bases(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of sequences by number, 4 for a letter that is no base and 5 for a gap, and their bounds."""
    text = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    # A letter of several bytes counts by its first.
    starts = (data & 0xC0) != 0x80
    if not starts.all():
        return _BASES[data[starts]], np.concatenate([[0], np.cumsum(starts)])[bounds - bounds[0]]
    return _BASES[data], bounds - bounds[0]


def gap_coverage(alns: DataFrame, asked: DataFrame) -> DataFrame:
    """(``pos``, ``cov_ins``) for the positions ``asked``: reads with a say about the gap before each.

    Depth is summed from change points, so no read is exploded; the asked positions are rows
    without a change. The running sum has as many rows as the reference at most.
    """
    ends = F.array(F.struct((F.col("start") + 1).alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))
    change = alns.filter("end > start").select(F.explode(ends).alias("x")).select("x.pos", "x.d", F.lit(0).alias("wanted"))
    both = change.unionByName(asked.select("pos", F.lit(0).alias("d"), F.lit(1).alias("wanted")))
    each = both.groupBy("pos").agg(F.sum("d").alias("d"), F.max("wanted").alias("wanted"))
    return ordered.running_sums(each, "pos", {"cov_ins": F.col("d")}).filter("wanted = 1").select("pos", "cov_ins")


def insertions(alns: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts by (``pos``, ``ins_idx``); reads that cover the gap with a shorter insertion vote '-'."""
    voiced = count_bases(inserted(alns.withColumn("ins", F.map_filter("ins", lambda p, _: p > F.col("start")))), scores, "pos", "ins_idx")
    lengths = gap_lengths(alns).filter("gap > 0")
    full = lengths.select("pos", F.explode(F.sequence(F.lit(0), F.col("gap") - 1)).alias("ins_idx"))
    # Coverage is asked only where there is an insertion.
    cov = gap_coverage(alns, lengths)
    joined = full.join(voiced, ["pos", "ins_idx"], "left").join(cov, "pos", "left")
    n = F.coalesce("cov", F.lit(0))
    out = joined.withColumn("__silent", F.greatest(F.coalesce("cov_ins", F.lit(0)) - n, F.lit(0)))
    cols = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in COUNTS}
    cols["cov"] = (n + F.col("__silent")).cast("bigint")
    cols["gaps"] = (F.coalesce("gaps", F.lit(0)) + F.col("__silent")).cast("bigint")
    return out.withColumns(cols).select("pos", "ins_idx", *COUNTS)


def gap_lengths(alns: DataFrame) -> DataFrame:
    """(``pos``, ``gap``): the longest insertion before each position that has one."""
    return alns.select(F.explode("ins").alias("pos", "text")).groupBy("pos").agg(F.max(F.length("text")).alias("gap"))


def gaps_before(gaps: DataFrame) -> DataFrame:
    """(``pos``, ``gap``, ``before``): prefix sums of gaps. One row for each insertion site of a reference."""
    return ordered.running_sums(gaps, "pos", {"before": F.col("gap")}, inclusive=False)


def call(df: DataFrame, code: int = 1, settings: Settings = Settings()) -> DataFrame:
    """Add ``cons``, ``frac_agree`` and ``phred`` to counts.

    No coverage gives N, gaps at or above their share '-', else the base of the best score,
    the later of A, C, G, T on ties. Code 1 wants the best at or above a floor; code 2 wants
    it at zero or above, or ahead of the second by a margin.
    """
    s = {b: F.col(f"s{b.lower()}") for b in "ACGT"}
    best = F.greatest(*s.values())
    base = F.when(s["T"] == best, "T").when(s["G"] == best, "G").when(s["C"] == best, "C").otherwise("A")
    second = F.get(F.sort_array(F.array(*s.values()), asc=False), F.lit(1))
    fair = (best >= 0) | (best - settings.min_cons_lead > second) if code == 2 else best >= settings.min_cons_score
    gap = F.col("gaps") * 100 >= F.col("cov") * settings.gap_per_cent
    cons = F.when(F.col("cov") == 0, "N").when(gap, "-").otherwise(F.when(fair, base).otherwise("N"))
    own = F.when(base == "A", F.col("na")).when(base == "C", F.col("nc")).when(base == "G", F.col("ng")).otherwise(F.col("nt"))
    frac = F.when(F.col("cov") == 0, F.lit(0.0)).when(gap, F.col("gaps") / F.col("cov")).otherwise(own / F.col("cov"))
    return df.withColumns({"cons": cons, "frac_agree": frac, "phred": phred(*s.values())})


def phred(a: Column, c: Column, g: Column, t: Column) -> Column:
    """10 log10 of the odds of the best base, cut to an integer; scores are hundredths of bits."""
    all_ = [a, c, g, t]
    best = F.greatest(*all_)
    # The best base counts once: of equal scores the earliest is the best, the others are against it.
    ratio = [F.pow(F.lit(2.0), (x - best) / 100.0) for x in all_]
    against = ratio[0] + ratio[1] + ratio[2] + ratio[3] - 1.0
    odds = F.when(against <= 0, F.lit(1e308)).otherwise(F.least(F.lit(1.0) / F.when(against <= 0, F.lit(1.0)).otherwise(against), F.lit(1e308)))
    return (F.lit(10.0) * F.log10(odds)).cast("int")


def columns(alns: DataFrame, scores: DataFrame, ref: DataFrame, code: int = 1, settings: Settings = Settings(), only_kept: bool = False) -> DataFrame:
    """All columns of an assembly in order: (``pos``, ``ins_idx``, ``ref_base``, counts, ``cons``, …).

    ``ref`` has (``pos``, ``ref_base``). ``ins_idx`` -1 is the reference column itself; the
    inserted columns 0, 1, … come before it. ``only_kept`` leaves dropped reads out of the
    votes on reference columns, not of those on insertions.
    """
    voters = alns.filter("NOT dropped") if only_kept else alns
    at = ref.join(positions(voters, scores), "pos", "left").fillna(0, COUNTS).withColumn("ins_idx", F.lit(-1))
    ins = insertions(alns, scores).join(ref.select("pos"), "pos", "left_semi").withColumn("ref_base", F.lit("-"))
    return call(at.unionByName(ins), code, settings).withColumn("place", F.when(F.col("ins_idx") < 0, F.lit(1 << 30)).otherwise(F.col("ins_idx")))


def consensus(called: DataFrame, gapped: bool = False) -> DataFrame:
    """One row with ``consensus``: the calls in order; gaps are left out unless ``gapped``."""
    text = ordered.texts(called, consensus="cons")
    return text if gapped else text.select(F.replace("consensus", F.lit("-"), F.lit("")).alias("consensus"))


def assembly_string(alns: DataFrame, scores: DataFrame, ref: DataFrame, code: int = 1, settings: Settings = Settings()) -> str:
    """The consensus that serves as the next reference. Insertions before position 0 are skipped."""
    called = columns(alns, scores, ref, code, settings, only_kept=True).filter("NOT (pos = 0 AND ins_idx >= 0)")
    return consensus(called).first()["consensus"]


def ends(alns: DataFrame) -> DataFrame:
    """(``pos``, ``fwd_starts``, ``rev_starts``, ``fwd_ends``, ``rev_ends``).

    A front half counts by its start only and a back half by its end only.
    """
    at = F.array(
        F.struct(F.col("start").alias("pos"), F.lit(True).alias("is_start"), (F.col("segment") != "b").alias("counts")),
        F.struct(F.col("end").alias("pos"), F.lit(False).alias("is_start"), (F.col("segment") != "f").alias("counts")),
    )
    each = alns.select("rc", F.explode(at).alias("x")).filter("x.counts").select("rc", "x.pos", "x.is_start")
    pick = lambda start, rc: F.count_if((F.col("is_start") == start) & (F.col("rc") == rc))
    return each.groupBy("pos").agg(
        pick(True, False).alias("fwd_starts"), pick(True, True).alias("rev_starts"), pick(False, False).alias("fwd_ends"), pick(False, True).alias("rev_ends")
    )


def summary(alns: DataFrame, ref_length: int) -> DataFrame:
    """One row (``fragments``, ``total_length``, ``mean_coverage``); back halves add length but no fragment."""
    total = F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("bigint")
    return alns.agg(F.count_if(F.col("segment") != "b").alias("fragments"), total.alias("total_length"), (total / F.lit(ref_length)).alias("mean_coverage"))


def coverage(intervals: DataFrame, *keys: str) -> DataFrame:
    """Depth of intervals ``start`` to ``end`` by change points: (keys, ``pos``, ``depth``), no join and no explode."""
    change = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))))
    each = intervals.select(*keys, change.alias("x")).groupBy(*keys, F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    return ordered.running_sums(each, "pos", {"depth": F.col("d")}, keys).select(*keys, "pos", "depth")


AMBIGUITY = {
    # The IUPAC symbol of each set of bases, in alphabetical order.
    "A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "GT": "K", "AC": "M", "CG": "S", "AT": "W",
    "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N",
}


def majority(columns: DataFrame, per_cent: int = 100, style: str = "gaps", *keys: str) -> DataFrame:
    """(keys, ``pos``, ``symbol``) for rows of (keys, ``pos``, ``base``) of a multiple alignment.

    Symbols A, C, G, T and '-' are counted, the most frequent first and the greater symbol on
    ties, and taken until they make up ``per_cent`` of the count. The set gives an IUPAC
    symbol. ``style``: ``gaps`` writes lower case where the set holds a gap, ``iupac``
    upper case, ``strict`` N for anything but a single base. A column without any of the
    five is N. A set of gaps only is '-'.
    """
    counted = columns.filter("base IN ('A','C','G','T','-')").groupBy(*keys, "pos", "base").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "pos").orderBy(F.col("n").desc(), F.col("base").desc())
    run = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(*keys, "pos"))
    taken = counted.withColumns({"before": F.coalesce(run, F.lit(0)), "need": F.ceil(F.lit(per_cent) * total / 100)}).filter("before < need")
    sets = taken.groupBy(*keys, "pos").agg(F.array_join(F.sort_array(F.collect_set("base")), "").alias("set"))
    plain = F.replace("set", F.lit("-"), F.lit(""))
    table = F.create_map(*[x for k, v in AMBIGUITY.items() for x in (F.lit(k), F.lit(v))])
    symbol = F.when(plain == "", F.lit("-")).otherwise(F.element_at(table, plain))
    if style == "strict":
        symbol = F.when((plain == "") | (F.length("set") == 1), symbol).otherwise("N")
    elif style == "gaps":
        symbol = F.when((plain != "") & F.contains("set", F.lit("-")), F.lower(symbol)).otherwise(symbol)
    every = columns.select(*keys, "pos").distinct()
    return every.join(sets.select(*keys, "pos", symbol.alias("symbol")), [*keys, "pos"], "left").fillna("N", ["symbol"])
