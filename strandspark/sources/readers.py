"""Readers: FASTA, FASTQ, reference, id list, saved assemblies. All give DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import seq as S

READS = "ord bigint, id string, desc string, seq string, qual string, qual_sum int, seq_len int"


def sniff(spark: SparkSession, path: str) -> str:
    """``fastq`` if the first byte is '@', else ``fasta``."""
    first = spark.read.text(path).limit(1).collect()
    return "fastq" if first and first[0][0].startswith("@") else "fasta"


def _named(header: Column, settings: Settings) -> tuple[Column, Column]:
    name = F.regexp_extract(header, r"^\S*", 0)
    rest = F.regexp_extract(header, r"^\S*\s+(.*)$", 1)
    return F.substring(name, 1, settings.max_id), F.substring(rest, 1, settings.max_desc)


def fasta(spark: SparkSession, path: str, settings: Settings = Settings(), keep_case: bool = False, longest: int | None = None) -> DataFrame:
    """One row per record, in file order by ``ord``; sequences over the limit are cut, as reads are.

    Records are split by Spark's own line reader at lines that begin with '>', so a file is
    read in parallel pieces and no record is assembled by hand.
    """
    raw = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace("value", "^\\s*>", "")).filter("trim(value) <> ''")
    head = F.regexp_replace(F.regexp_extract("value", r"^[^\n]*", 0), r"\r$", "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    name, rest = _named(head, settings)
    body = body if keep_case else F.upper(body)
    most = settings.max_read if longest is None else longest
    body = F.substring(body, 1, most) if most else body
    df = raw.select(F.monotonically_increasing_id().alias("ord"), name.alias("id"), rest.alias("desc"), body.alias("seq"))
    return df.select("ord", "id", "desc", "seq", F.lit(None).cast("string").alias("qual"), F.lit(None).cast("int").alias("qual_sum"), F.length("seq").alias("seq_len"))


_LINES = ["head", "seq", "plus", "qual"]


def _four_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of which four lines (``ord``, ``k``, ``value``) follow each other as rows; the lines of others as rows of their own."""
    held = [pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.string())]
    for batch in chain(batches, [None]):
        cols = held if batch is None else [pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns, strict=True)]
        of = cols[0].to_numpy()
        first = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1]).astype(np.int64)
        # The last record may go on in the next batch.
        end = len(of) if batch is None else int(first[-1])
        if batch is not None:
            held, first = [c.slice(end) for c in cols], first[:-1]
        if not end:
            continue
        at = first[np.diff(np.append(first, end)) == 4]
        whole = [cols[0].take(pa.array(at)), pa.array(np.ones(len(at), dtype=bool)), *[cols[2].take(pa.array(at + k)) for k in range(4)]]
        yield pa.RecordBatch.from_arrays(whole, ["ord", "whole", *_LINES])
        alone = np.ones(end, dtype=bool)
        alone[(at[:, None] + np.arange(4)).reshape(-1)] = False
        if alone.any():
            left = [c.slice(0, end).filter(pa.array(alone)) for c in cols]
            lines = [pc.if_else(pc.equal(left[1], k), left[2], pa.scalar(None, pa.string())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([left[0], pa.array(np.zeros(len(left[0]), dtype=bool)), *lines], ["ord", "whole", *_LINES])


def fastq(spark: SparkSession, path: str, settings: Settings = Settings(), mode: str = "FAILFAST") -> DataFrame:
    """Four-line records. ``mode``: FAILFAST raises on a bad record, DROPMALFORMED skips it.

    A record is found by its header at the start of a line: the text is split before lines
    that begin with '@' and are followed, two lines on, by a line that begins with '+'.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r"\s+$", "").alias("value"))
    # Line numbers within each file: rows of a block are numbered in a run, so counts of the
    # blocks before it and the first number of its own give the place. No row is gathered.
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("size"), F.min("line").alias("first"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    number = F.dense_rank().over(Window.orderBy("file"))
    base = sizes.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("base"), number.cast("bigint").alias("number"))
    # A row for each block of a file, so the lines stay where they are read.
    numbered = lines.join(F.broadcast(base), ["file", "block"])
    n = F.col("base") + F.col("line") - F.col("first")
    each = numbered.select((F.shiftleft("number", 40) + F.floor(n / 4)).alias("ord"), (n % 4).cast("int").alias("k"), "value").filter("value <> '' OR k <> 0")
    # Only the records that lie in two blocks, or that lack a line, meet in a shuffle.
    parts = each.mapInArrow(_four_lines, "ord bigint, whole boolean, head string, seq string, plus string, qual string")
    rest = parts.filter("NOT whole").groupBy("ord").agg(*[F.max(c).alias(c) for c in _LINES])
    rec = parts.filter("whole").select("ord", *_LINES).unionByName(rest)
    good = F.coalesce(F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")), F.lit(False))
    if mode == "FAILFAST":
        rec = rec.withColumn("head", F.when(good, F.col("head")).otherwise(F.raise_error(F.concat(F.lit("bad record "), F.col("ord").cast("string")))))
    else:
        rec = rec.filter(good)
    name, rest = _named(F.substring("head", 2, 1 << 20), settings)
    df = rec.select("ord", name.alias("id"), rest.alias("desc"), F.upper(F.substring("seq", 1, settings.max_read)).alias("seq"), F.substring("qual", 1, settings.max_read).alias("qual"))
    return df.select("ord", "id", "desc", "seq", "qual", S.qual_sum(F.col("qual"), settings.qual_offset).alias("qual_sum"), F.length("seq").alias("seq_len"))


def reads(spark: SparkSession, path: str, settings: Settings = Settings(), kind: str = "auto") -> DataFrame:
    kind = sniff(spark, path) if kind == "auto" else kind
    return fastq(spark, path, settings) if kind == "fastq" else fasta(spark, path, settings)


def reference(spark: SparkSession, path: str, settings: Settings = Settings()) -> tuple[str, str, str]:
    """(id, description, sequence with its case) of the first record; one row reaches the driver."""
    row = fasta(spark, path, settings, keep_case=True, longest=0).orderBy("ord").limit(1).collect()
    if not row:
        raise ValueError(f"no sequence in {path}")
    return row[0]["id"], row[0]["desc"], row[0]["seq"]


def id_list(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    return spark.read.text(path).select(F.substring(F.trim("value"), 1, settings.max_id).alias("id")).filter("id <> ''").distinct()


def only_listed(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """Reads whose id is listed."""
    return reads.join(ids.select("id").distinct(), "id", "left_semi").select(*reads.columns)


ALNS = (
    "ord bigint, id string, desc string, score int, num_inputs int, start int, end int, rc boolean, trimmed boolean, "
    "dropped boolean, segment string, seq string, smp array<int>, ins map<int,string>"
)


def assembly_text(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Import a saved assembly in its text form: header values, and the placed reads.

    The header has the reference and the matrices and is small; placed reads are parsed as
    records of tagged lines. Older files without NUM_INPUTS or DR give 1 and false.
    """
    head_lines: list[str] = []
    marked = spark.read.text(path).filter(F.col("value").startswith("/* map_alignment")).select("_metadata.file_path").limit(1).collect()
    for row in spark.read.text(marked[0][0] if marked else path).select("value").toLocalIterator():
        if row[0].startswith("__ALNSEQS__"):
            break
        head_lines.append(row[0])
    if not head_lines or not head_lines[0].startswith("/*"):
        raise ValueError("not a saved assembly")
    head: dict = {"forward": [], "backward": []}
    into = None
    for line in head_lines[1:]:
        key, _, value = line.partition(" ")
        if key in ("FPSM:", "RPSM:"):
            into = head["forward" if key[0] == "F" else "backward"]
        elif into is not None and re.match(r"^-?\d", line):
            into.append([int(x) for x in line.split()])
        elif key == "GAPS":
            head["gaps"] = [int(x) for x in value.split()]
        elif key in ("ID", "DESC", "SEQ", "LEN", "MALN_COC", "MALN_NAS"):
            head[key.lower()] = value
    raw = spark.read.text(path, lineSep="\nID ").withColumn("ord", F.monotonically_increasing_id()).filter(F.col("value").contains("\nSEG "))
    one = lambda tag: F.regexp_extract("value", rf"\n{tag} ?([^\n]*)", 1)
    number = lambda tag, other: F.coalesce(F.expr(f"try_cast(regexp_extract(value, '\\n{tag} (-?[0-9]+)', 1) AS INT)"), F.lit(other))
    parts = F.filter(F.split(one("INS_POS"), " "), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda k: F.struct(F.get(parts, k * 2).cast("int") + number("START", 0), F.get(parts, k * 2 + 1)))
    none = F.expr("cast(map() AS map<int,string>)")
    df = raw.select(
        "ord",
        F.regexp_extract("value", r"^(?:ID )?([^\n]*)", 1).alias("id"),
        one("DESC").alias("desc"),
        number("SCORE", 0).alias("score"),
        number("NUM_INPUTS", 1).alias("num_inputs"),
        number("START", 0).alias("start"),
        number("END", 0).alias("end"),
        (number("RC", 0) != 0).alias("rc"),
        (number("TR", 0) != 0).alias("trimmed"),
        (number("DR", 0) != 0).alias("dropped"),
        one("SEG").alias("segment"),
        one("SEQ").alias("seq"),
        F.transform(F.filter(F.split(one("SMP"), ""), lambda c: c != ""), lambda c: F.ascii(c) - 65).alias("smp"),
        F.when(F.size(parts) >= 2, F.map_from_entries(pairs)).otherwise(none).alias("ins"),
    )
    return head, df


def newest(spark: SparkSession, path: str) -> str:
    """The sibling with the greatest number at its end, if any has one above 1; else ``path``."""
    stem = re.sub(r"\d+$", "", path)
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(stem + "*")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    names = [f.getPath().toString() for f in found]
    tail = re.escape(stem.rsplit("/", 1)[-1])
    numbered = [(int(m[1]), n) for n in names if (m := re.search(rf"(?:^|/){tail}(\d+)$", n))]
    best = max(numbered, default=(0, path))
    return best[1] if best[0] > 1 else path
