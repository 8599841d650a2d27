"""Sequences, placed reads and scores made from the text tables, the same way in Spark and in SQL.

The registered queries run the operators on them; each SQL text below builds the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import seq as S
from .operators import kernel, ordered

#: Placements are dealt over so many positions.
SPAN = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``doc_id``, ``dna``) of whole texts.

    What follows makes a hundred rows of each text, so texts are dealt over all cores first;
    a small table is one row group, hence one task.
    """
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)
    return texts.select("doc_id", S.dna(F.col("text")).alias("dna"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 100 letters at steps of 50 over whole texts, with qualities."""
    d = docs(spark, sf_dir).filter("length(dna) > 0").select("doc_id", "dna", F.length("dna").alias("size"))
    # A substring walks from the start of its text, so texts are cut into runs of 2000 letters first, and reads out of those.
    runs = d.select("doc_id", "dna", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / 2000))).alias("run"))
    runs = runs.select("doc_id", "size", "run", F.substring("dna", (F.col("run") * 2000 + 1).cast("int"), F.lit(2050)).alias("part"))
    each = runs.select("doc_id", "run", "part", F.explode(F.sequence(F.col("run") * 40, F.least(F.col("run") * 40 + 39, F.floor((F.col("size") - 1) / 50)))).alias("i"))
    seq = F.substring("part", ((F.col("i") - F.col("run") * 40) * 50 + 1).cast("int"), F.lit(100))
    each = each.select("doc_id", "i", (F.col("doc_id") * 100000 + F.col("i")).alias("ord"), seq.alias("seq"))
    return each.select("ord", "doc_id", "i", F.concat(F.lit("r"), F.col("ord").cast("string")).alias("id"), F.lit("").alias("desc"), "seq", F.translate("seq", "ACGT", "5?DI").alias("qual"), F.length("seq").alias("len"))


def _edited(t: str) -> Column:
    """100 letters with a change, a gap and an insertion."""
    part = lambda a, n: F.substring(t, a, n)
    return F.concat(part(1, 30), F.translate(part(31, 1), "ACGT", "CATG"), part(32, 20), part(54, 17), F.when(F.length(t) >= 71, "CA").otherwise(""), part(71, 100))


def _item_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``ord``, ``i``, ``at``, ``t``): 100 letters at steps of 50 over all items, and their place in the reference."""
    items = table(spark, sf_dir, "benchmark").select("item_id", S.dna(F.col("text")).alias("dna"))
    items = ordered.running_sums(items, "item_id", {"before": F.length("dna")}, inclusive=False).filter("length(dna) > 0")
    each = items.select("item_id", "dna", "before", F.explode(F.sequence(F.lit(0), F.floor((F.length("dna") - 1) / 50))).alias("i"))
    t = F.substring("dna", (F.col("i") * 50 + 1).cast("int"), F.lit(100))
    return each.select((F.col("item_id") * 1000 + F.col("i")).alias("ord"), "i", (F.col("before") + F.col("i") * 50).cast("int").alias("at"), t.alias("t"))


def _as_reads(parts: DataFrame, *more: str) -> DataFrame:
    none = F.lit(None)
    return parts.select("ord", F.concat(F.lit("i"), F.col("ord").cast("string")).alias("id"), F.lit("").alias("desc"), "seq", none.cast("string").alias("qual"), none.cast("int").alias("qual_sum"), F.length("seq").alias("len"), *more)


def item_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited reads over all items; every second one is reversed."""
    seq = _edited("t")
    return _as_reads(_item_parts(spark, sf_dir).withColumn("seq", F.when(F.col("i") % 2 == 1, S.reverse_complement(seq)).otherwise(seq)))


def oriented_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads as an earlier round leaves them: oriented, with a strand and a place."""
    parts = _item_parts(spark, sf_dir).select("ord", _edited("t").alias("seq"), (F.col("i") % 2 == 1).alias("rc"), F.col("at").alias("as"), (F.col("at") + F.length("t") - 1).alias("ae"), F.lit(0).alias("score"), F.lit(False).alias("trimmed"), F.lit(True).alias("strand_known"))
    return _as_reads(parts, "rc", "as", "ae", "score", "trimmed", "strand_known")


#: The matrix classes of reads of 1 to 100 letters, a constant that rows look up.
_CLASSES = "array(" + ", ".join("array(" + ", ".join(str(c) for c in kernel.classes("A" * n, {}, 0)) + ")" for n in range(1, 101)) + ")"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with a start, a strand, gaps, insertions and matrix classes."""
    r = reads(spark, sf_dir)
    start = ((F.col("doc_id") * 131 + F.col("i") * 50) % SPAN).cast("int")
    text = F.replace("seq", F.lit("GAT"), F.lit("G-T"))
    k = F.element_at(F.expr(_CLASSES), F.col("len"))
    none = F.expr("cast(map() AS map<int,string>)")
    ins = F.when((F.col("doc_id") % 10 == 0) & (F.col("len") > 5), F.create_map(start + 3, F.substring("seq", 1, 2))).when((F.col("doc_id") % 10 == 5) & (F.col("len") > 5), F.create_map(start + 3, F.substring("seq", 1, 1))).otherwise(none)
    segment = F.when(F.col("i") % 11 == 3, "f").when(F.col("i") % 11 == 4, "b").otherwise("a")
    return r.select(
        "ord", "id", "desc", (F.col("len") * 150 + F.col("doc_id") % 100).cast("int").alias("score"), F.lit(1).alias("num_inputs"), start.alias("start"), (start + F.col("len") - 1).alias("end"),
        (F.col("doc_id") % 2 == 1).alias("rc"), (F.col("doc_id") % 3 == 0).alias("trimmed"), (F.col("doc_id") % 7 == 0).alias("dropped"), segment.alias("segment"), text.alias("seq"), k.alias("smp"), ins.alias("ins"),
    )


def matrix() -> np.ndarray:
    """A matrix that differs in every position class and pair of bases."""
    d, x, b = np.meshgrid(np.arange(31), np.arange(5), np.arange(5), indexing="ij")
    out = np.where(b == 4, -100, np.where(x == 4, -10, np.where(x == b, 200 - d, -600 + 7 * d + 11 * x + 3 * b)))
    return out.astype(np.int32)


def reference(spark: SparkSession, sf_dir: str) -> str:
    """The letters of all benchmark items in order; a small table."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", S.dna(F.col("text")).alias("dna"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "dna"))), lambda x: x["dna"]), "").alias("s")).first()["s"]


DNA_SQL = "translate(upper(regexp_replace({0}, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
DOCS_SQL = f"docs AS (SELECT doc_id, {DNA_SQL.format('text')} AS dna FROM documents)"
READS_SQL = f"""{DOCS_SQL},
reads0 AS (SELECT doc_id, dna, unnest(range(0, (length(dna) + 49) // 50)) AS i FROM docs WHERE length(dna) > 0),
reads AS (SELECT doc_id * 100000 + i AS ord, doc_id, i, 'r' || (doc_id * 100000 + i) AS id, substr(dna, 1 + 50 * i, 100) AS seq,
  translate(substr(dna, 1 + 50 * i, 100), 'ACGT', '5?DI') AS qual, length(substr(dna, 1 + 50 * i, 100))::INTEGER AS len FROM reads0)"""
PLACED_SQL = f"""{READS_SQL},
placed AS (SELECT ord, id, (len * 150 + doc_id % 100)::INTEGER AS score, ((doc_id * 131 + i * 50) % {SPAN})::INTEGER AS start,
  ((doc_id * 131 + i * 50) % {SPAN} + len - 1)::INTEGER AS "end", doc_id % 2 = 1 AS rc, doc_id % 3 = 0 AS trimmed, doc_id % 7 = 0 AS dropped,
  CASE WHEN i % 11 = 3 THEN 'f' WHEN i % 11 = 4 THEN 'b' ELSE 'a' END AS segment, replace(seq, 'GAT', 'G-T') AS seq, len,
  CASE WHEN len > 5 AND doc_id % 10 = 0 THEN substr(seq, 1, 2) WHEN len > 5 AND doc_id % 10 = 5 THEN substr(seq, 1, 1) END AS ins,
  ((doc_id * 131 + i * 50) % {SPAN} + 3)::INTEGER AS ins_pos FROM reads)"""
#: Matrix class of place k in a read of len.
CLASS_SQL = "CASE WHEN {k} <= 15 THEN {k} WHEN {len} - {k} - 1 < 15 THEN 30 - ({len} - {k} - 1) ELSE 15 END"


def score_sql(x: int, base: str = "b", depth: str = "d", rc: str = "rc") -> str:
    """Score of reference base ``x`` for an observed base index, on either strand."""
    fwd = f"CASE WHEN {base} = 4 THEN -100 WHEN {base} = {x} THEN 200 - {depth} ELSE -600 + 7 * {depth} + {11 * x} + 3 * {base} END"
    y = 3 - x
    rev = f"CASE WHEN {base} = 4 THEN -100 WHEN {base} = {x} THEN 200 - (30 - {depth}) ELSE -600 + 7 * (30 - {depth}) + {11 * y} + 3 * (3 - {base}) END"
    return f"CASE WHEN {rc} THEN {rev} ELSE {fwd} END"


_COUNTS = "count(*) AS cov, " + ", ".join(f"count(*) FILTER (WHERE c = '{b}') AS n{b.lower()}" for b in "ACGT") + ", count(*) FILTER (WHERE c = '-') AS gaps, "
_COUNTS += ", ".join(f"sum(CASE WHEN c = '-' THEN 0 ELSE {score_sql(k)} END)::BIGINT AS s{b}" for k, b in enumerate("acgt"))
BASES_SQL = f"""bases0 AS (SELECT start, rc, seq, len, dropped, unnest(range(0, length(seq))) AS k FROM placed),
bases AS (SELECT (start + k)::INTEGER AS pos, substr(seq, k + 1, 1) AS c, CASE WHEN instr('ACGT', substr(seq, k + 1, 1)) > 0 THEN instr('ACGT', substr(seq, k + 1, 1)) - 1 ELSE 4 END AS b,
  {CLASS_SQL.format(k='k', len='len')} AS d, rc, dropped FROM bases0)"""
PILE_SQL = f"""{PLACED_SQL}, {BASES_SQL},
pile AS (SELECT pos, {_COUNTS} FROM bases GROUP BY pos)"""
INS_SQL = f"""ins0 AS (SELECT ins_pos AS pos, rc, ins, unnest(range(0, length(ins))) AS ins_idx, {CLASS_SQL.format(k='3', len='len')} AS d FROM placed WHERE ins IS NOT NULL),
ins1 AS (SELECT pos, ins_idx::INTEGER AS ins_idx, substr(ins, ins_idx + 1, 1) AS c, instr('ACGT', substr(ins, ins_idx + 1, 1)) - 1 AS b, d, rc FROM ins0),
voiced AS (SELECT pos, ins_idx, {_COUNTS} FROM ins1 GROUP BY pos, ins_idx),
gap AS (SELECT ins_pos AS pos, max(length(ins))::INTEGER AS gap FROM placed WHERE ins IS NOT NULL GROUP BY 1),
full0 AS (SELECT pos, unnest(range(0, gap))::INTEGER AS ins_idx FROM gap),
change AS (SELECT start + 1 AS pos, 1 AS d FROM placed WHERE "end" > start UNION ALL SELECT "end" + 1, -1 FROM placed WHERE "end" > start),
steps AS (SELECT pos, sum(sum(d)) OVER (ORDER BY pos) AS depth FROM change GROUP BY pos),
covi AS (SELECT g.pos, s.depth AS cov_ins FROM gap g ASOF LEFT JOIN steps s ON g.pos >= s.pos),
pile_ins AS (SELECT f.pos, f.ins_idx, (coalesce(v.cov, 0) + greatest(coalesce(cov_ins, 0) - coalesce(v.cov, 0), 0))::BIGINT AS cov,
  {", ".join(f"coalesce(v.n{b}, 0)::BIGINT AS n{b}" for b in "acgt")},
  (coalesce(v.gaps, 0) + greatest(coalesce(cov_ins, 0) - coalesce(v.cov, 0), 0))::BIGINT AS gaps, {", ".join(f"coalesce(v.s{b}, 0)::BIGINT AS s{b}" for b in "acgt")}
  FROM full0 f LEFT JOIN voiced v USING (pos, ins_idx) LEFT JOIN covi c ON c.pos = f.pos)"""
_BEST = "greatest(sa, sc, sg, st)"
BASE_SQL = f"CASE WHEN st = {_BEST} THEN 'T' WHEN sg = {_BEST} THEN 'G' WHEN sc = {_BEST} THEN 'C' ELSE 'A' END"
_ODDS = f"(pow(2.0, (sa - {_BEST}) / 100.0) + pow(2.0, (sc - {_BEST}) / 100.0) + pow(2.0, (sg - {_BEST}) / 100.0) + pow(2.0, (st - {_BEST}) / 100.0) - 1.0)"
PHRED_SQL = f"trunc(10.0 * log10(CASE WHEN {_ODDS} <= 0 THEN 1e308 ELSE least(1.0 / {_ODDS}, 1e308) END))::INTEGER"


def call_sql(code: int) -> str:
    fair = f"({_BEST} >= 0 OR {_BEST} - 2400 > list_sort([sa, sc, sg, st], 'DESC')[2])" if code == 2 else f"{_BEST} >= -399"
    return f"CASE WHEN cov = 0 THEN 'N' WHEN gaps * 100 >= cov * 50 THEN '-' WHEN {fair} THEN {BASE_SQL} ELSE 'N' END"


FRAC_SQL = f"CASE WHEN cov = 0 THEN 0.0 WHEN gaps * 100 >= cov * 50 THEN gaps / cov ELSE (CASE {BASE_SQL} WHEN 'A' THEN na WHEN 'C' THEN nc WHEN 'G' THEN ng ELSE nt END) / cov END"
REF_SQL = f"refseq AS (SELECT string_agg({DNA_SQL.format('text')}, '' ORDER BY item_id) AS s FROM benchmark), ref AS (SELECT (i - 1)::INTEGER AS pos, substr(s, i, 1) AS ref_base FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM refseq))"
COLUMNS_SQL = f"""{PILE_SQL}, {INS_SQL}, {REF_SQL},
cols0 AS (SELECT ref.pos, -1 AS ins_idx, ref_base, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("cov", "na", "nc", "ng", "nt", "gaps", "sa", "sc", "sg", "st"))} FROM ref LEFT JOIN pile USING (pos)
  UNION ALL SELECT p.pos, ins_idx, '-', cov, na, nc, ng, nt, gaps, sa, sc, sg, st FROM pile_ins p JOIN ref USING (pos)),
cols AS (SELECT *, {call_sql(1)} AS cons, {FRAC_SQL} AS frac_agree, {PHRED_SQL} AS phred, CASE WHEN ins_idx < 0 THEN 1073741824 ELSE ins_idx END AS place FROM cols0)"""
