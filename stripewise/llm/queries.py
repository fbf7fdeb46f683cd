"""Queries of the training-data operators over the tables, and DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripewise.llm.common import table


def vocabulary() -> str:
    """Path of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.mixing import mix_sources, taken_words

    mix = mix_sources(table(spark, sf_dir, "documents"))
    return taken_words(mix).select("doc_id", "size", "source_size", "target", "taken")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.pitman_yor import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.warc import archive_folder, read_archives, write_archives

    packages = write_archives(table(spark, sf_dir, "pages"), archive_folder(spark))
    return read_archives(packages, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.pii import KINDS, find_pii

    spans = F.col("spans")
    listed = lambda x: F.array_join(
        F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda k: lambda s: s["kind"] == k
    return find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(F.filter(spans, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.quality_crf import FOLDS, HELD_OUT, THRESHOLD, fold, score_quality, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, field).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("row", "first")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the loose table, as its SQL has it."""
    from stripewise.llm.quality_rules import LOOSE_RULES, quality_rules

    return _judged(quality_rules(table(spark, sf_dir, "documents"), LOOSE_RULES))


def op10_quality_rules_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripewise.llm.quality_rules import quality_rules

    return _judged(quality_rules(table(spark, sf_dir, "documents")))


def _judged(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_crf": op7_quality_crf,
    "op8_sharding": op8_sharding,
    "op9_minhash": op9_minhash,
    "op10_quality_rules": op10_quality_rules,
    "op10_quality_rules_published": op10_quality_rules_published,
}
