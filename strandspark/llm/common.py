"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as characters and as a regex class.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


#: The temporary folder of each local application that has no shared one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Only a session whose one process is the driver, and without that setting, gets a
    temporary folder; a cluster of processes on this machine does not.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL[app] = _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="strandspark-")
    return f"{base.rstrip('/')}/strand-{uuid.uuid4().hex}"


def clear_steps(spark: SparkSession) -> int:
    """Delete all ``strand-*`` folders of the session's shared folder; their number.

    Results of this package read these folders lazily, so write what you need first.
    """
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).getParent()
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(parent, "strand-*")) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)


def cut(df: DataFrame, folder: str, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back, which ends its lineage."""
    path = f"{folder}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_where(df: DataFrame, flag: str) -> DataFrame:
    """The rows where the computed column ``flag`` is true.

    A plain filter would be pushed below the projections that compute the flag and make
    Spark evaluate them twice, inside lambdas once per element; an outer generator is a
    step that filters do not cross.
    """
    return df.withColumn("__flag", F.explode_outer(F.array(F.col(flag)))).filter("__flag").drop("__flag")


def drop_table(spark: SparkSession, folder: str, tag: str = "") -> None:
    """Delete a table that :func:`cut` wrote and no later read needs."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{tag}" if tag else folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its source gives fewer tasks than there are cores.

    A small table is one row group, hence one task, whatever its rows cost. A table of many
    files is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the corpus, or ``columns`` of it, spread over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, WS_CLASS + "+"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where the optimizer copies the expression.

    Lambdas that refer to a computed column would otherwise evaluate it for each element as
    soon as projections are merged or a filter is pushed down.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items that one fold of :func:`running_sums` goes over.
_FOLD = 128


def running_sums(lengths: Column, levels: int = 3) -> Column:
    """Sums of the items before each item of an array of longs, as an array of the same size.

    A fold that appends copies its array at each step, which costs the square of the size. So
    runs of 128 items are folded by themselves, and their totals are summed in the same way
    one level up; with three levels two million items cost little more than their number.
    """
    zero = F.lit(0).cast("bigint")

    def fold(items: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(items, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")))

    if levels <= 1:
        return fold(lengths)["before"]

    def cut_up(items: Column) -> Column:
        last = F.floor((F.size(items) - 1) / _FOLD)
        runs = F.transform(F.sequence(zero, last), lambda b: fold(F.slice(items, (b * _FOLD + 1).cast("int"), F.lit(_FOLD))))
        return F.when(F.size(items) <= _FOLD, fold(items)["before"]).otherwise(let(runs, joined))

    def joined(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: r["at"])
        both = F.struct(runs.alias("runs"), running_sums(totals, levels - 1).alias("base"))
        return let(both, lambda x: F.flatten(F.transform(x["runs"], lambda r, i: F.transform(r["before"], lambda v: v + F.get(x["base"], i)))))

    return let(lengths, cut_up)


def ngram_hashes(items: Column, width: int, seed: int | None = None) -> Column:
    """64-bit hashes of all runs of ``width`` items; an empty array if there are fewer."""
    extra = [] if seed is None else [F.lit(seed)]
    none = F.array().cast("array<bigint>")

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (width - 1))
        return F.when(F.size(w) >= width, F.transform(at, lambda i: F.xxhash64(*extra, F.slice(w, i, F.lit(width))))).otherwise(none)

    return let(items, runs)


def repeat_positions(hashes: Column, later_only: bool = False) -> Column:
    """Ascending 0-based positions of values that occur twice or more in an array of hashes.

    With ``later_only`` the first position of each value is left out. The position goes into
    the low bits of a sorted key, so one sort brings equal hashes together in order; the full
    hashes of neighbours are compared before a position counts.
    """
    none = F.array().cast("array<bigint>")

    def search(s: Column) -> Column:
        low, h = s["low"], s["h"]

        def same(keys: Column, k: Column, j: Column) -> Column:
            other = F.get(keys, j)
            return F.coalesce(F.get(h, k.bitwiseAND(low).cast("int")) == F.get(h, other.bitwiseAND(low).cast("int")), F.lit(False))

        def pick(keys: Column) -> Column:
            found = F.filter(keys, lambda k, j: same(keys, k, j - 1) if later_only else same(keys, k, j - 1) | same(keys, k, j + 1))
            return F.sort_array(F.transform(found, lambda k: k.bitwiseAND(low)))

        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))
        return let(F.sort_array(packed), pick)

    def start(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h).cast("bigint")))
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.struct(h.alias("h"), low.alias("low")), search)).otherwise(none)

    return let(hashes, start)
