"""The corpus pipeline: five stages, each of which takes what its predecessor kept.

``run`` writes each stage's rows as Parquet into the shared folder and reads them again as the next stage's documents. All
stages but the last return the columns of documents. Rows with a null identifier pass the stages that need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloop.llm import decontam, langid, line_dedup, mixing, simhash
from graphloop.llm.common import SPACES, materialise, prepare, release, table


#: Jaccard similarity of five-word shingles from which two texts are near copies.
SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those where two languages come out alike, go."""
    model = langid.learn(docs)
    judged = langid.predict(docs, model, keep=[F.struct(*docs.columns).alias("_row")])
    return judged.filter((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least identifier stays.

    Copies are what fingerprints within two bits link, and texts whose five-word shingles are alike by ``SIMILARITY``.
    """
    copies = simhash.near_duplicates(docs, similarity=SIMILARITY).filter("doc_id <> component_id").select(F.struct("doc_id").alias("_copy")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return rows.join(copies, F.struct("_row.doc_id") == F.col("_copy"), "left_anti").select("_row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and runs of repeated sentences are cut; a document that has nothing left goes."""
    cut = line_dedup.removed(docs).filter(F.col("spans").isNull() | (F.btrim("left", F.lit(SPACES)) != ""))
    of = {"text": F.col("left"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("long"))}
    return cut.select(*[of.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to meet the target weights of source, language and topic."""
    return mixing.sample(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("source_mixing", source_mixing)]
#: Learned classifiers, fingerprints and components can't be written in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        release(before)  # the stage's own rows are on disk now
    return docs
