"""Trie of the shared openings of conversations.

Each conversation's turns pass through a task in order and are chained: the digest of a prefix
is SHA-256 over the digest before it and the turn, so equal openings have equal digests however
they are dealt. Every prefix is a row; rows of one (depth, digest) are a node. A node belongs to
its smallest member, on whose path all its ancestors lie; what it adds to its ancestors is
summed along that path first, so a path sends a row to each ancestor and not one for each pair
of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: Characters of joined ids that go on together to the task that hashes a node's ids.
PIECE_CHARS = 1 << 16
#: Rows of a batch that the chaining task hands on.
_ROWS = 10_000


def share_openings(turns: DataFrame, block: int = 100, sizes: int = 6) -> DataFrame:
    """(``conv_id``, ``turn``, ``role``, ``text``): conversations that open with turns of their block's first one.

    Conversation c gets the first h turns of conversation ``c - c % block`` (all if it has
    fewer, none if there is no such conversation), then its own turns after its first h; h is
    the unsigned CRC-32 of c in decimal, modulo ``sizes``. Turns go by ``turn``, null first,
    then role and text, and are numbered anew from 1. A conversation may be left without
    turns and then has no row here.
    """
    t = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    t = t.select("conv_id", number.cast("bigint").alias("turn"), "role", "text")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % sizes
    own = t.filter(F.col("turn") > h)
    base = turns.filter("conv_id IS NOT NULL").select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), h.alias("h"))
    # A base gives fewer than ``sizes`` turns, each to fewer than two blocks of conversations.
    opening = t.filter(F.col("turn") < sizes).withColumnRenamed("conv_id", "base")
    lent = base.join(opening, "base").filter("turn <= h").select("conv_id", "turn", "role", "text")
    return own.unionByName(lent)


_PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("chars", pa.int64()), ("ends", pa.bool_())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix rows of conversations whose rows follow one another, the root's first; only the last digest is held."""
    out: list[tuple] = []
    last: tuple | None = None

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PREFIXES)], schema=_PREFIXES)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if role is None:
                new = (conv, 0, hashlib.sha256().digest(), 0)
            else:
                name = role.encode()
                new = (conv, last[1] + 1, hashlib.sha256(last[2] + len(name).to_bytes(8, "big") + name + text.encode()).digest(), len(text))
            if last:
                out.append((*last, last[0] != conv))
            last = new
            if len(out) >= _ROWS:
                yield pack(out)
                out = []
    if last:
        yield pack([*out, (*last, True)])


def prefixes(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(``conv_id``, ``depth``, ``digest``, ``chars``, ``ends``): every prefix of every conversation, the empty one included."""
    t = turns.filter("conv_id IS NOT NULL").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ids = t.select("conv_id")
    if conversations is not None:
        ids = ids.unionByName(conversations.select("conv_id").filter("conv_id IS NOT NULL"))
    none = F.lit(None)
    roots = ids.distinct().select(F.col("conv_id").cast("bigint").alias("conv_id"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    # Only a root has no role, so it stands first among the rows that have no turn, and those stand first.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text")]
    rows = t.unionByName(roots).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")
    return rows.mapInArrow(_chain, "conv_id bigint, depth bigint, digest binary, chars bigint, ends boolean")


def _pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Comma-joined runs of sorted ids of one node, in pieces."""
    done: list[tuple] = []
    key, first, part, size = None, None, [], 0

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["depth", "digest", "first", "ids"])

    for batch in batches:
        for depth, digest, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if part and (key != (depth, digest) or size >= most):
                done.append((*key, first, ",".join(part)))
                part, size = [], 0
            if not part:
                key, first = (depth, digest), conv
            part.append(str(conv))
            size += len(part[-1]) + 1
        if len(done) >= _ROWS:
            yield pack(done)
            done = []
    if part:
        done.append((*key, first, ",".join(part)))
    if done:
        yield pack(done)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which follow one another; a piece is held at a time."""
    out: list[tuple] = []
    key, engine = None, hashlib.sha256()

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["depth", "digest", "ends_sha256"])

    for batch in batches:
        for depth, digest, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key == (depth, digest):
                engine.update(b",")
            else:
                if key:
                    out.append((*key, engine.hexdigest()))
                key, engine = (depth, digest), hashlib.sha256()
            engine.update(ids.encode())
        if len(out) >= _ROWS:
            yield pack(out)
            out = []
    if key:
        yield pack([*out, (*key, engine.hexdigest())])


def end_digests(found: DataFrame) -> DataFrame:
    """(``depth``, ``digest``, ``ends_sha256``) for the nodes at which conversations end.

    The ids are dealt by ranges of node and id, so a node with very many of them is joined up
    in many tasks; one task then reads its pieces in order, since SHA-256 has one order.
    """
    ends = found.filter("ends").select("depth", "digest", "conv_id").repartitionByRange("depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id")
    pieces = ends.mapInArrow(_pieces, "depth bigint, digest binary, first bigint, ids string")
    ordered = pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").select("depth", "digest", "ids")
    return ordered.mapInArrow(_digests, "depth bigint, digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per distinct opening of the conversations in ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    A conversation's turns go by ``turn``, null first, then role and text; null roles and texts
    are empty, rows without a ``conv_id`` are left out, repeated rows are turns like any other.
    ``conversations`` may name further ids, which have no turns if ``turns`` has none. Nodes
    are the distinct sequences of the first d turns (role and text), from the root at d = 0;
    no conversations give no nodes, not even the root.

    ``digest`` names the opening. ``conv_id`` is its smallest member, ``parent_conv_id`` that
    of its parent (null at the root). ``n_convs`` counts members, ``n_children`` child nodes,
    ``n_leaves`` childless nodes in the subtree, ``saved_tokens`` sums (``n_convs`` - 1) times
    the code points of the last text over the subtree, ``ends_sha256`` hashes the ascending
    ids of members that end here. A conversation passes through one task as a stream, since
    its chain has one order; its rows may be any number and its texts any length. Other
    columns are not carried, so their names cannot clash.
    """
    folder = shared_dir(turns.sparkSession)
    found = cut(prefixes(turns, conversations), folder, "prefixes")
    nodes = found.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.count(F.when(F.col("ends"), 1)).alias("n_ends"))
    # A node that very many conversations share has as many rows here. Both sides are read from tables and dealt anew, so
    # adaptive execution can split it.
    nodes = cut(nodes, folder, "nodes")
    on = found.join(nodes, ["depth", "digest"])
    owned = F.col("conv_id") == F.col("owner")
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    here = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = on.select(
        "depth",
        "digest",
        "owner",
        "n_convs",
        owned.alias("owned"),
        F.lead("owner").over(up).alias("above"),
        F.lag(owned.cast("bigint"), 1, 0).over(up).alias("child"),
        F.sum(F.when(owned & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0)).over(here).alias("leaves"),
        F.sum(F.when(owned, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)).over(here).alias("saved"),
    )
    path = path.filter("owned OR child > 0 OR leaves > 0 OR saved > 0")
    sums = path.groupBy("depth", "digest").agg(
        F.max("owner").alias("conv_id"),
        F.max(F.when(F.col("owned"), F.col("above"))).alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return sums.join(end_digests(found), ["depth", "digest"], "left").select(F.lower(F.hex("digest")).alias("digest"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
