"""Quality rules: a threshold table compiled into one projection.

Every metric is a Spark expression over the whole text; there are no user functions, no
shuffle and no state between rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, keep_where, let, ngram_hashes, repeat_positions, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "au aux dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine ist mit nicht sich sie und von zu im "
    "al con del el es las lo los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.col(self.metric)
        tests = [value >= self.low] if self.low is not None else []
        tests += [value <= self.high] if self.high is not None else []
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return F.coalesce(out, F.lit(False))


#: The production table. Ratios are a word's or a line's share.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 24.0),
    Rule("symbols", "symbol_ratio", None, 0.15),
    Rule("shouting", "bang_ratio", None, 0.30),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
    Rule("bullets", "bullet_ratio", None, 0.90),
    Rule("ellipses", "ellipsis_ratio", None, 0.30),
)


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and the ratios.

    Null and empty texts have zero counts and zero ratios. Columns that begin with ``__q`` are
    reserved while the function runs.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"__qw": words(F.col(text)), "__ql": F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    df = df.withColumn("__qh", ngram_hashes(F.col("__qw"), WINDOW))
    wide = F.lit(WINDOW).cast("bigint")
    covered = let(repeat_positions(F.col("__qh")), lambda at: F.transform(at, lambda p, i: F.least(wide, F.coalesce(F.get(at, i + 1) - p, wide))))
    lines = F.size("__ql")
    df = df.withColumns(
        {
            "n_words": F.size("__qw").cast("bigint"),
            "word_chars": F.length(F.array_join("__qw", "")).cast("bigint"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": (lines - F.size(F.array_distinct("__ql"))).cast("bigint"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x),
            "__qn_lines": lines.cast("bigint"),
            "__qstop": F.size(F.filter("__qw", lambda w: F.lower(w).isin(STOP_WORDS))),
            "__qbang": F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit(""))),
            "__qbullet": F.size(F.filter("__ql", lambda x: x.rlike(f"^{WS_CLASS}*[-*•]"))),
            "__qdots": F.size(F.filter("__ql", lambda x: x.rlike(f"(\\.\\.\\.|…){WS_CLASS}*$"))),
        }
    )
    per_word, per_line = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("__qn_lines"), F.lit(1))
    df = df.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / per_word,
            "symbol_ratio": F.col("n_symbols") / per_word,
            "bang_ratio": F.col("__qbang") / per_word,
            "stop_ratio": F.col("__qstop") / per_word,
            "dup_line_ratio": F.col("n_dup_lines") / per_line,
            "bullet_ratio": F.col("__qbullet") / per_line,
            "ellipsis_ratio": F.col("__qdots") / per_line,
        }
    )
    return df.drop("__qw", "__ql", "__qh", "__qn_lines", "__qstop", "__qbang", "__qbullet", "__qdots")


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` (names) and ``kept`` to the output of :func:`with_metrics`."""
    base = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    df = df.withColumns({"base_failed": base, "failed_rules": failed})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``doc_id``, the counts, the ratios, ``base_failed``, ``failed_rules``, ``kept``.

    Null texts have no words and so fail the base rule, as do empty ones; a null id is judged
    like any other; repeated rows are judged alike; very long texts are judged whole, at a
    cost in proportion to their words; an empty table gives an empty result; other columns of
    the input are not carried, so their names cannot clash.
    """
    return apply_rules(with_metrics(documents.select("doc_id", "text")), rules).drop("text")


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``documents`` that pass, with their own columns, whatever their names. All other cases are as in :func:`judge`."""
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row")
    judged = apply_rules(with_metrics(documents.select(own, F.col("text").alias("text"))), rules)
    return keep_where(judged, "kept").select("__row.*")
