"""The registered queries of the corpus operators; each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloop.llm import decontam, html_extract, langid, license_scan, line_dedup, mixing, quality_rules, simhash, token_count, url_filter
from graphloop.llm.common import prepare, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair that is retrieved and verified."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    return langid.predict(docs, model, keep=["doc_id", held_out.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op4_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return token_count.count_tokens(table(spark, sf_dir, "documents"), model_path)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left, what went by original offsets, and the documents that keep it."""
    out = line_dedup.removed(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    none = F.expr("cast(array() as array<bigint>)")
    zero = F.lit(0).cast("long")
    return out.select("row.doc_id", F.col("left").alias("text"), F.coalesce("n_units", zero).alias("n_units"), F.coalesce(chars, zero).alias("n_chars"), F.coalesce(spans, F.lit("")).alias("spans"), F.coalesce("first_ids", none).alias("first_ids"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its stratum, calibrated probability, and whether it is drawn."""
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 9))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(prepare(spark), sf_dir)

    own = [op1_decontamination, op2_url_filter, op3_language_id, op4_token_counts, op5_quality_rules, op6_substring_dedup, op7_license_scan, op8_source_mixing, op9_html_extraction, op10_simhash, pipeline]
    return {f.__name__: ready(f) for f in own}
