"""Line deduplication over overlapping windows of three lines.

Windows are hashed inside their row, only hashes cross the network, and the text travels
once, in the join that brings back what to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ngram_hashes, repeat_positions

WINDOW = 3
#: A row is known by its id and a hash of its text.
_KEY = ["doc_id", "text_hash"]


def _windows(documents: DataFrame) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    df = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines"))
    df = df.select(*_KEY, "lines", ngram_hashes(F.col("lines"), WINDOW).alias("h1"), ngram_hashes(F.col("lines"), WINDOW, 7).alias("h2"))
    df = df.withColumn("again", repeat_positions(F.col("h1"), later_only=True))
    worded = F.transform(F.col("h1"), lambda h, i: F.array_join(F.slice("lines", i + 1, F.lit(WINDOW)), "").rlike("[^\\x20\\x09-\\x0D]"))
    return df.select(*_KEY, "again", F.arrays_zip(F.col("h1"), F.col("h2"), worded.alias("worded")).alias("w"))


def repeated_positions(documents: DataFrame) -> DataFrame:
    """(``doc_id``, ``text_hash``, ``at``): first lines of windows that occurred before.

    The order of occurrences is that of ``doc_id``, then of the text's hash, then of the line.
    Windows without a word never count. Rows that share both id and text are one document: a
    line that goes in one goes in all of them, and they are no repeats of each other. Rows
    that share an id only are different documents. A null ``doc_id`` is left alone. A hot
    window is a partial minimum on each map side, and in the join back its rows lie on the
    side that adaptive execution can split.
    """
    w = _windows(documents.filter("doc_id IS NOT NULL AND text IS NOT NULL"))
    each = w.select(*_KEY, F.posexplode_outer("w").alias("at", "x")).filter("x.worded").select(*_KEY, "at", "x.h1", "x.h2")
    place = F.struct(*_KEY)
    first = each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h1", "h2", "first")
    across = each.join(first, ["h1", "h2"]).filter(place > F.col("first")).select(*_KEY, "at")
    again = F.filter("again", lambda p: F.get("w", p.cast("int"))["worded"])
    inside = w.select(*_KEY, F.explode_outer(again).alias("at")).filter("at IS NOT NULL").select(*_KEY, F.col("at").cast("int"))
    return across.unionByName(inside)


def _shortened(documents: DataFrame) -> DataFrame:
    """(``row``, ``text``, ``n_lines``, ``n_removed``): ``row`` holds all columns as they came, so no name can clash."""
    covered = repeated_positions(documents.select("doc_id", "text")).groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + (WINDOW - 1))))).alias("covered"))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    df = documents.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), row).join(covered, _KEY, "left").select("row", "covered")
    df = df.withColumn("lines", F.split(F.col("row")["text"], "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    old = F.col("row")["text"]
    return df.select(
        "row",
        F.when(F.col("covered").isNull() | old.isNull(), old).otherwise(kept).alias("text"),
        F.when(old.isNull(), F.lit(0)).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.when(old.isNull() | F.col("covered").isNull(), F.lit(0)).otherwise(F.size("covered")).cast("bigint").alias("n_removed"),
    )


def line_counts(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: ``doc_id``, ``text`` as it stays, ``n_lines``, ``n_removed``.

    A line goes if any window that covers it occurred before (:func:`repeated_positions` has
    the order). Null texts stay null with no lines, empty texts are one empty line, texts of
    fewer than three lines have no window and stay whole. A very long text is one row of one
    task, as it is in the input. An empty table gives an empty result.
    """
    return _shortened(documents.select("doc_id", "text")).select(F.col("row")["doc_id"].alias("doc_id"), "text", "n_lines", "n_removed")


def dedup_lines(documents: DataFrame, length: str | None = None, drop_emptied: bool = False) -> DataFrame:
    """All rows and columns of ``documents``, whatever their names, with ``text`` shortened.

    ``length`` names a column that follows the length of a shortened text. With
    ``drop_emptied`` a document goes if no word is left of it after a line was removed. All
    other cases are as in :func:`line_counts`.
    """
    df = _shortened(documents)
    changed = F.col("n_removed") > 0
    if drop_emptied:
        gone = changed & F.coalesce(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
        # A plain filter would be pushed below the projection and make Spark evaluate it twice.
        df = df.withColumn("stay", F.explode_outer(F.array(~gone))).filter("stay")
    out = []
    for c in documents.columns:
        value = F.col("row")[c]
        if c == "text":
            value = F.col("text")
        elif c == length:
            value = F.when(changed, F.length("text").cast(documents.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return df.select(*out)
