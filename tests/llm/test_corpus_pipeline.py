import glob
import os

import duckdb
import pytest
from helpers import alike, components, repeats, simhash

from pyspark.sql import functions as F

import __spark_entry__

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from graphloop.llm import decontam, line_dedup, mixing, oracles  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_eleven_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_against_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda rs: sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rs)
    assert plain(df.select(*columns).collect()) == plain(con.sql(f"SELECT {', '.join(columns)} FROM ({oracles.oracle_sql()[name]})").fetchall())


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
    raw = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = kept["language_id"]
    assert all(any(c.isalpha() for c in r["text"]) for r in first.values()) and len(first) >= 0.97 * len(raw)
    want = components([(i, simhash(r["text"])) for i, r in sorted(first.items())], alike=alike({i: r["text"] for i, r in first.items()}, corpus_pipeline.SIMILARITY))
    assert set(kept["near_dedup"]) == {i for i, c in want.items() if i == c}
    spans = {i: s for (i, _), s in repeats([(i, r["text"]) for i, r in sorted(kept["near_dedup"].items())], line_dedup.PASSAGE).items()}
    cut = {i: line_dedup.cut(r["text"], [{"start": s, "end": e} for s, e in spans.get(i, [])]) for i, r in kept["near_dedup"].items()}
    assert {i: r["text"] for i, r in kept["substring_dedup"].items()} == {i: t for i, t in cut.items() if i not in spans or t.strip(" \t\n\x0b\x0c\r")}
    assert all(r["n_chars"] == len(r["text"]) for i, r in kept["substring_dedup"].items() if i in spans)
    items = [(r["item_id"], decontam.shingles(decontam.words_of(r["text"]))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(len(s & decontam.shingles(decontam.words_of(t))) > 0.5 * len(s) for _, s in items)
    assert set(kept["decontamination"]) == {i for i, r in kept["substring_dedup"].items() if not holds(r["text"])}
    assert set(kept["source_mixing"]) < set(kept["decontamination"]) and len(kept["source_mixing"]) > 0.2 * len(kept["decontamination"])
    assert all(list(r) == columns for name in kept for r in kept[name].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(kept["source_mixing"])
    assert mixing.BUDGET == 0.5


def test_stages_of_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_keep_columns_of_any_name_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("_copy", "_row", "_dup_id", "_key", "_lost", "removed_spans", "left", "row", "spans", "fp", "component_id", "topic", "lang_pred", "ambiguous")
    docs = docs.union(docs.limit(20)).select("*", *[F.lit(c).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        first = docs.first()
        assert docs.count() > 20 and all(first[c] == c for c in names), name
