"""The corpus pipeline stage by stage, and the queries as they are registered."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF_DIR
from evenkeel.llm import crf, lsa, minhash
from test_llm_operators import CLASHING, SCHEMA, awkward
from tools.check_oracle import compare

NAMES = [n for n in entry.queries() if n.startswith("op")]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 11))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_matches_sql(spark, duck, name):
    message, ok = compare(spark, duck, name, SF_DIR)
    assert ok, message


@pytest.mark.parametrize("name", [n for n in NAMES if n not in entry.oracle_sql()])
def test_query_runs_over_the_whole_table(spark, name):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    rows = entry.queries()[name](spark, SF_DIR).count()
    assert rows == n if name.split("_")[0] not in ("op2", "op10") else rows > 0


def test_stages_decide_as_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    tables = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark")}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        done = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in done.collect()}
        if name == "toxicity":
            toxic = {r["doc_id"] for r in crf.tag(docs, crf.train(docs, tables["labels"])).where("score >= 0.5").collect()}
            assert set(after) == set(before) - toxic
        elif name == "line_dedup":
            assert all(len(after[i]["text"]) <= len(before[i]["text"]) for i in after)
            assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])
        elif name == "ngram_jaccard_join":
            classes = {}
            for r in minhash.jaccard_join(docs).collect():
                classes.setdefault(r["class_id"], []).append(r["doc_id"])
            assert set(after) == {min(ids) for ids in classes.values()}
        elif name == "decontamination":
            assert set(after) == set(before) - {r["doc_id"] for r in lsa.find_leaks(docs, tables["benchmark"]).collect()}
        else:
            assert set(after) == set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == columns
        docs = done


def test_stages_take_awkward_rows_and_clashing_columns(spark, tmp_path):
    rows = [(*r, 1, "s", 2, 3, "r", 4, 5, 6, 7, 8) for r in awkward()]
    docs = spark.createDataFrame(rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        done = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == docs.columns
        if name == "ngram_jaccard_join":
            assert done.groupBy("doc_id", F.coalesce("text", F.lit(""))).count().where("count > 1").count() == 0
        docs = done
    assert docs.count() > 0


def test_stages_take_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
