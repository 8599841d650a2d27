"""Benchmark decontamination by SimHash over item-sized windows, in Spark expressions only.

A window that resembles an item holds most of its shingles, hence one at least of its rarest.
So the shingles of all texts meet those of all items first; the rare ones among the hits tell
which items a text may hold, the others where in the text the shingles of these items stand,
and only windows that begin at such a hit and have enough hits ahead are made. Each gets
a 64-bit SimHash of its shingles. Fingerprints are cut into one block more than the radius:
two fingerprints within the radius agree on a whole block, so an equi-join on (item, block,
value) finds all of them. Exact weighted similarity decides.

That windows may begin at hits only loses nothing: moving a window to its first hit keeps
every hit and its length, and so does not lower its similarity. That a window meets only the
items that its hits are of loses nothing either, since others have no shingle in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, shared_dir, words

WIDTH = 5
PER_CENT = 80
#: Differing bits up to which fingerprints are candidates. At similarity 0.8 the expected
#: number is 10 with a deviation of 3.
RADIUS = 20
#: Rows of the items' tables, of 40 bytes at most, up to which they are broadcast; Spark picks the joins beyond.
BROADCAST_ROWS = 1_000_000
_LANES = 0x0000000100000001


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of runs of lower-cased words; the whole text as one if it has fewer; none without words."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(F.slice(w, i, F.lit(width)))))

    return let(words(F.lower(text)), runs)


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes, each counted as often as it occurs.

    Two counters of 32 bits are summed in one long, which no array can overflow.
    """

    def bits(s: Column, k: Column, n: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for lane in range(2):
            count = F.call_function("shiftrightunsigned", s, F.lit(32 * lane)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
            out = out.bitwiseOR(F.when(count * 2 > n, F.call_function("shiftleft", F.lit(1).cast("bigint"), k + 32 * lane)).otherwise(F.lit(0).cast("bigint")))
        return out

    def whole(h: Column) -> Column:
        sums = lambda k: F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + F.call_function("shiftrightunsigned", x, k).bitwiseAND(F.lit(_LANES)))
        parts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: let(sums(k), lambda s: bits(s, k, F.size(h))))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return let(hashes, whole)


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(``block``, ``value``) for radius + 1 blocks of bits."""
    out, count = [], radius + 1
    for b in range(count):
        low, high = 64 * b // count, 64 * (b + 1) // count
        value = F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint"))
        out.append(F.struct(F.lit(b).alias("block"), value.alias("value")))
    return F.array(*out)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of greatest counts of the distinct shingles of two arrays.

    If shingles repeat, each is told apart by how many like it stand before it, and the two
    arrays are compared as sets.
    """

    def apart(x: Column) -> Column:
        return let(F.sort_array(x), lambda s: F.transform(s, lambda v, i: F.xxhash64(v, i + 1 - F.array_position(s, v))))

    def of(s: Column) -> Column:
        x, y = s["a"], s["b"]
        plain = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
        shared = F.when(plain, F.size(F.array_intersect(x, y))).otherwise(F.size(F.array_intersect(apart(x), apart(y)))).cast("bigint")
        return let(shared, lambda k: k / (F.size(x) + F.size(y) - k))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def _items(benchmark: DataFrame) -> DataFrame:
    hashed = benchmark.select("item_id", shingles(F.coalesce("text", F.lit(""))).alias("item"))
    whole = hashed.select("item_id", "item", F.size("item").alias("size"))
    return whole.withColumn("some", F.explode_outer(F.array(F.col("size") > 0))).filter("some").drop("some")


def _probes(items: DataFrame, per_cent: int) -> DataFrame:
    """(``item_id``, ``hash``): for each item the shingles of which a window that reaches ``per_cent`` holds one at least.

    Such a window holds ``per_cent`` of the item's shingles, counted as often as they occur, so
    it cannot miss more than the rest. The rarest are taken, by the number of items that have
    them; a phrase that many items share is then no reason to look at all of them.
    """
    known = items.select("item_id", "size", "item", F.xxhash64("item").alias("key")).distinct()
    each = known.select("item_id", "key", "size", F.explode("item").alias("hash"))
    shared = each.groupBy("hash").agg(F.countDistinct("item_id").alias("items"))
    ranked = each.join(shared, "hash").groupBy("item_id", "key", "size").agg(F.sort_array(F.collect_list(F.struct("items", "hash"))).alias("ranked"))
    spare = (F.col("size") - F.ceil(F.lit(per_cent) * F.col("size") / 100) + 1).cast("int")
    return ranked.select("item_id", F.explode(F.slice("ranked", F.lit(1), spare)).alias("x")).select("item_id", "x.hash").distinct()


def _candidates(documents: DataFrame, vocabulary: DataFrame, probes: DataFrame, fixed: Callable[[DataFrame], DataFrame], per_cent: int, folder: str) -> DataFrame:
    """(``doc_id``, ``text_hash``, ``items``): for each text the items that it may hold, and where windows begin.

    ``fixed`` marks tables of the items. A text meets the items of which it holds a probe. A window of as many shingles as the item
    (fewer at the end of a text) can reach ``per_cent`` only if enough of its shingles are of
    the item.
    """
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), shingles(F.coalesce("text", F.lit(""))).alias("h"))
    rows = rows.select("doc_id", "text_hash", F.size("h").alias("n"), "h")
    each = rows.select("doc_id", "text_hash", "n", F.posexplode("h").alias("at", "hash"))
    # A place of a text is one row here, of however many items its shingle is.
    marks = vocabulary.select("hash").distinct().join(probes.select("hash", F.lit(True).alias("probe")).distinct(), "hash", "left")
    hits = cut(each.join(fixed(marks), "hash"), folder, "hits")
    opened = hits.filter("probe").join(fixed(probes), "hash").groupBy("doc_id", "text_hash").agg(F.collect_set("item_id").alias("open"))
    met = hits.join(opened, ["doc_id", "text_hash"]).join(fixed(vocabulary), "hash").filter(F.array_contains("open", F.col("item_id")))
    met = met.groupBy("doc_id", "text_hash", "item_id", "size", "n").agg(F.sort_array(F.collect_set("at")).alias("at"))
    size = F.col("size")

    def begins(p: Column, i: Column) -> Column:
        enough = F.ceil(F.lit(per_cent) * (size + F.least(size, F.col("n") - p)) / (100 + per_cent)).cast("int")
        return F.coalesce(F.get("at", i + enough - 1) < p + size, F.lit(False))

    found = met.select("doc_id", "text_hash", "item_id", "size", F.filter("at", begins).alias("starts"))
    found = found.withColumn("any", F.explode_outer(F.array(F.size("starts") > 0))).filter("any")
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "size", "starts")).alias("items"))


def contaminated(documents: DataFrame, benchmark: DataFrame, per_cent: int = PER_CENT, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document and item met: ``doc_id``, ``item_id``, ``similarity``, ``window_start``, ``n_windows``.

    A window of as many shingles as the item (fewer at the end of a text) counts when its
    weighted similarity reaches ``per_cent``. ``window_start`` is the word at which the best
    window begins, the first on ties. Null and empty texts and items meet nothing, nor do
    rows without a ``doc_id``; repeated rows of documents count their windows each; repeated
    items are items of one id. Very long texts and items are handled whole. Other columns are
    not carried, so their names cannot clash. Empty tables give an empty result.
    """
    items = _items(benchmark)
    blocks_of = radius + 1
    bound = items.agg(F.sum("size") + F.count("*") * blocks_of).first()[0] or 0
    fixed = F.broadcast if bound <= broadcast_rows else (lambda d: d)
    vocabulary = items.select("item_id", "size", F.explode("item").alias("hash")).distinct()
    known = documents.filter("doc_id IS NOT NULL").select("doc_id", "text")
    # Few texts hold enough of an item; their number decides how the texts are joined.
    folder = shared_dir(documents.sparkSession)
    chosen = cut(_candidates(known, vocabulary, _probes(items, per_cent), fixed, per_cent, folder), folder, "candidates")
    rows = known.withColumn("text_hash", F.xxhash64("text")).join(chosen, ["doc_id", "text_hash"])
    rows = rows.select("doc_id", "items", shingles(F.coalesce("text", F.lit(""))).alias("h"))

    each = rows.select("doc_id", "h", F.explode_outer("items").alias("x")).filter("x IS NOT NULL").select("doc_id", "h", "x.*")
    # One window is one row; it is cut out of the part of the text that the item's windows span.
    low, size = F.get("starts", F.lit(0)), F.col("size")
    part = F.slice("h", low + 1, F.get("starts", F.size("starts") - 1) - low + size)
    each = each.select("doc_id", "item_id", "size", low.alias("low"), part.alias("part"), "starts")
    each = each.select("doc_id", "item_id", "size", "low", "part", F.explode_outer("starts").alias("at")).filter("at IS NOT NULL")
    each = each.select("doc_id", "item_id", "at", F.slice("part", F.col("at") - F.col("low") + 1, size).alias("window"))
    printed = each.select("doc_id", "item_id", "at", "window", simhash(F.col("window")).alias("fp"))
    keyed = printed.select("doc_id", "item_id", "at", "window", "fp", F.explode_outer(blocks(F.col("fp"), radius)).alias("k")).select("doc_id", "item_id", "at", "window", "fp", "k.*")
    index = items.select("item_id", simhash(F.col("item")).alias("item_fp"))
    index = index.select("item_id", "item_fp", F.explode_outer(blocks(F.col("item_fp"), radius)).alias("k")).select("item_id", "item_fp", "k.*").distinct()
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = F.bit_count(differ) <= radius
    # A pair that agrees on several blocks goes on from the first of them only.
    first = F.array_position(F.transform(blocks(differ, radius), lambda b: b["value"]), F.lit(0).cast("bigint")) == F.col("block") + 1
    met = keyed.join(fixed(index), ["item_id", "block", "value"]).filter(near & first).select("doc_id", "item_id", "at", "window", "item_fp")
    whole = items.select("item_id", simhash(F.col("item")).alias("item_fp"), "item").distinct()
    judged = met.join(fixed(whole), ["item_id", "item_fp"]).select("doc_id", "item_id", "at", weighted_similarity(F.col("window"), F.col("item")).alias("similarity"))
    best = judged.withColumn("ok", F.explode_outer(F.array(F.col("similarity") * 100 >= per_cent - 1e-9))).filter("ok")
    return best.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.expr("min_by(at, struct(-similarity, at))").cast("bigint").alias("window_start"), F.count("*").alias("n_windows"))


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that meet no item, with their own columns, whatever their names.

    Rows without an id stay; rows that share an id go together. All other cases are as in
    :func:`contaminated`.
    """
    met = contaminated(documents, benchmark).select(F.col("doc_id").alias("__met")).distinct()
    return documents.join(met, documents["doc_id"] == met["__met"], "left_anti")
