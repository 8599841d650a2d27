"""Secret scan with corpus-wide ownership frequency, in Spark expressions only.

Each text is searched once for each kind, and once more where it has a match. Candidate hashes are
then counted over distinct repositories and owners. A value that many owners share is a
copied example, and so is one that a few owners have in many repositories. A value of one
owner is taken for a live credential, however many repositories of that owner hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, running_sums, shared_dir


@dataclass(frozen=True)
class Kind:
    """``group`` holds the value; matches whose value or whole is too short are dropped."""

    name: str
    pattern: str
    group: int = 0
    min_value: int = 0
    base: bool = False


#: The base kinds, in the order in which ties are listed.
BASE_KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Kind("hex", r"[0-9a-f]+", 0, 24, True),
)
#: Further shapes of credentials; only owner-specific ones give a span.
MORE_KINDS = (
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}", 0, 60),
    Kind("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk-|glpat-)[A-Za-z0-9_-]{16,}", 0, 20),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 30),
)
#: A value with at least so many distinct owners counts as a copied example.
SHARED_OWNERS = 3
#: So does a value of two owners or more in at least so many distinct repositories.
SHARED_REPOSITORIES = 5

_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean,h1:bigint,h2:bigint>>"


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """All matches of a kind, leftmost and non-overlapping, that pass its length test.

    Spark has no expression for match positions, so the text is split at the matches and
    the lengths of pieces and matches are summed. The value of a match is taken from the match.
    """
    # A run of one class is found whole or not at all, so its length test can stand in the pattern.
    pattern = kind.pattern if kind.group or not kind.base else kind.pattern[:-1] + "{%d,}" % (kind.min_value - (4 if kind.name == "access" else 0))
    none = F.array().cast(_SPAN)

    def ends(z: Column) -> Column:
        sizes = F.transform(z["found"], lambda m, i: (F.length(F.get(z["gaps"], i)) + F.length(m)).cast("bigint"))
        return let(sizes, lambda n: let(F.struct(running_sums(n).alias("before"), n.alias("size"), z["found"].alias("found")), spans))

    def spans(x: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            value = F.regexp_extract(m, pattern, kind.group) if kind.group else m
            end = F.get(x["before"], i) + F.get(x["size"], i)
            return F.struct(
                (end - F.length(m)).alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind.name).alias("kind"),
                end.alias("end"),
                F.lit(kind.base).alias("base"),
                F.when(F.length(value) >= kind.min_value, F.xxhash64(value)).alias("h1"),
                F.xxhash64(F.lit(11), value).alias("h2"),
            )

        return F.filter(F.transform(x["found"], span), lambda s: s["h1"].isNotNull())

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(whole, lambda m: F.when(F.size(m) > 0, let(F.struct(F.split(text, pattern, -1).alias("gaps"), m.alias("found")), ends)).otherwise(none))


def scan(documents: DataFrame, repository: Column, owner: Column, kinds: tuple[Kind, ...] = BASE_KINDS + MORE_KINDS) -> DataFrame:
    """(``doc_id``, ``repository``, ``owner``, ``found``): candidate spans of each row, by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    found = F.sort_array(F.concat(*[_spans(text, kind, rank) for rank, kind in enumerate(kinds)]))
    return documents.select("doc_id", repository.alias("repository"), owner.alias("owner"), found.alias("found"))


def ownership(scanned: DataFrame) -> DataFrame:
    """(``h1``, ``h2``, ``n_repositories``, ``n_owners``, ``n_found``) over the whole corpus.

    Rows are first summed by value, repository and owner, so one hot value is spread over
    its owners before they are counted.
    """
    each = scanned.select("repository", "owner", F.explode("found").alias("s")).select("repository", "owner", "s.h1", "s.h2")
    first = each.groupBy("h1", "h2", "owner", "repository").agg(F.count("*").alias("n"))
    second = first.groupBy("h1", "h2", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return second.groupBy("h1", "h2").agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n_found"))


def find_secrets(
    documents: DataFrame, repository: Column, owner: Column, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES, kinds: tuple[Kind, ...] = BASE_KINDS + MORE_KINDS
) -> DataFrame:
    """One row per row of ``documents``: ``doc_id`` and ``found``, an array of spans with a verdict.

    Each span has start, kind, end (code points, end exclusive), base, n_owners,
    n_repositories and live. Spans of the further kinds stay only where live. Null texts count
    as empty and have no span, null owners and repositories count as one each, repeated rows
    are scanned alike, other columns are not carried, so their names cannot clash, and an
    empty table gives an empty result. Very long texts are scanned whole; the cost of a text
    grows with its length and its matches. The scan is written to the shared folder once, with
    a row number, since two later steps read it.
    """
    folder = shared_dir(documents.sparkSession)
    scanned = cut(scan(documents, repository, owner, kinds).withColumn("row", F.monotonically_increasing_id()), folder, "secrets")
    counts = ownership(scanned).select("h1", "h2", "n_owners", "n_repositories")
    copied = (F.col("n_owners") >= shared_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repositories") >= shared_repositories))
    each = scanned.select("row", F.explode("found").alias("s"))
    judged = each.withColumns({"h1": F.col("s.h1"), "h2": F.col("s.h2")}).join(counts, ["h1", "h2"]).withColumn("live", ~copied)
    judged = judged.filter("s.base OR live")
    span = F.struct("s.start", "s.rank", "s.kind", "s.end", "s.base", "n_owners", "n_repositories", "live")
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"))
    out = scanned.select("doc_id", "row").join(per_row, "row", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean,n_owners:bigint,n_repositories:bigint,live:boolean>>")
    return out.select("doc_id", F.coalesce("found", none).alias("found"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
