"""Chat formatting with Spark expressions only.

A conversation's turns are collected, sorted by turn (ties by role, then text), runs of one
role become one block, and the blocks are concatenated:

    <|im_start|>role\\ntext<|im_sep|>text of the next turn of that role<|im_end|>\\n

Texts may hold control strings. ``~`` becomes ``~0``; a ``<`` or ``[`` that opens a control
string becomes ``~1`` or ``~2``; a line feed in a role becomes ``~3``. Undoing ``~3``, ``~2``
and ``~1`` before ``~0`` gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_sums

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ANGLE = r"<(?=/?s>|\|)"
SQUARE = r"\[(?=/?INST\])"
#: Code points of the runs out of which spans are read.
_RUN = 512


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    out = F.regexp_replace(out, ANGLE, "~1")
    return F.regexp_replace(out, SQUARE, "~2")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~3"))


def unescape(text: Column) -> Column:
    for code, char in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_chats(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """One row per ``conv_id``: ``formatted`` and ``loss_spans`` (code points, end exclusive).

    ``loss_spans`` covers the escaped text of each ``train_role`` turn and no marker. Null
    roles and texts count as empty, a null ``conv_id`` is a conversation of its own, repeated
    rows are turns like any other. Other columns are not carried, so their names cannot clash.
    Very long texts and conversations are handled whole; a conversation is one row, and its
    cost grows with its length. An empty table gives an empty result.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    at = F.col("turns")

    def piece(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(at, i - 1)["role"] != t["role"])
        head = F.concat(F.when(i == 0, F.lit("")).otherwise(F.lit(END)), F.lit(START), escape_role(t["role"]), F.lit("\n"))
        return F.struct(
            F.when(opens, head).otherwise(F.lit(SEP)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == train_role).alias("train"),
        )

    df = df.select("conv_id", F.transform(at, piece).alias("pieces"))
    both = F.transform("pieces", lambda p: F.concat(p["head"], p["body"]))
    sizes = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"])).cast("bigint"))
    df = df.select("conv_id", F.concat(F.array_join(both, ""), F.lit(END)).alias("formatted"), "pieces", running_sums(sizes).alias("starts"))
    spans = F.filter(
        F.transform(
            "pieces",
            lambda p, i: F.struct(
                p["train"].alias("train"),
                (F.get("starts", i) + F.length(p["head"])).alias("start"),
                (F.get("starts", i) + F.length(p["head"]) + F.length(p["body"])).alias("end"),
            ),
        ),
        lambda s: s["train"],
    )
    return df.select("conv_id", "formatted", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"))


def spans_of(text: Column, spans: Column) -> Column:
    """The parts of a text at an array of spans (``start``, ``end`` exclusive, in code points).

    A substring is found by walking from the start of its text, so the text is cut into runs
    of equal length once, and each part is taken out of the few runs that it touches.
    """

    def part(runs: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / _RUN), F.floor((s["end"] - 1) / _RUN)
        near = F.array_join(F.slice(runs, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.when(s["end"] <= s["start"], F.lit("")).otherwise(F.substring(near, (s["start"] - first * _RUN + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_RUN}}}"), F.lit(0))
    return let(F.struct(runs.alias("runs"), spans.alias("spans")), lambda x: F.transform(x["spans"], lambda s: part(x["runs"], s)))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read ``turns`` (role, text) and ``loss_text`` back out of the output of :func:`format_chats`.

    The cost grows with the length of a conversation and the number of its turns.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda b: b != "")

    def read(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    under = F.transform(spans_of(F.col("formatted"), F.col("loss_spans")), unescape)
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, read)), "loss_text": F.array_join(under, "")})
