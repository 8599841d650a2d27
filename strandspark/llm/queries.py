"""The registered queries of this package: thin wrappers around its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, decontam, filteraudit, linededup, neardup, quality, rldedup, secrets, spm, substrings, trie, warc
from .common import drop_table, shared_dir, table


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as whole-file gzip streams, normalised to a member for each record, read back."""
    folder = shared_dir(spark)
    warc.write_monolithic(table(spark, sf_dir, "pages"), f"{folder}/raw")
    warc.normalise(spark, f"{folder}/raw", f"{folder}/warc")
    drop_table(spark, folder, "raw")
    index = warc.read_index(spark, f"{folder}/warc").select("archive", "offset", F.col("length").alias("indexed"))
    pages = warc.read_pages(spark, f"{folder}/warc").join(index, ["archive", "offset"], "left")
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", F.coalesce(F.col("indexed") == F.col("length"), F.lit(False)).alias("index_ok"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and the best window."""
    return decontam.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("n_windows")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    scored = classifier.quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"), fold)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=3, per_cent=85)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the document's source. Repository: its source and language."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("bigint").alias("n_live"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), spm.model_of(spark))


def op8_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the operator's result; beside them what stays in bytes, and the removed runs as text."""
    done = rldedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
    runs = F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string")))
    return done.select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("bigint").alias("kept_bytes"),
        (F.size("removed") > 0).alias("has_repeats"),
        F.array_join(runs, ",").alias("removed_spans"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, turn, role, :probe AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"probe": probe})
    read = chat.parse_chats(chat.format_chats(turns.unionByName(extra)))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part: the document's source."""
    return filteraudit.audit_texts(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels"), F.col("source"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of conversations that open with turns of their block's first one."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return trie.prefix_trie(trie.share_openings(turns), turns.select("conv_id")).drop("digest")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the operator's result; beside them the removed runs of words as text."""
    done = substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
    runs = F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string")))
    return done.select("doc_id", "n_words", size.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.array_join(runs, ",").alias("removed_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": op1_warc_archives,
    "op2_quality_rules": op2_quality_rules,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_secret_scan": op6_secret_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_run_length_dedup": op8_run_length_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substring_dedup": op13_substring_dedup,
}
