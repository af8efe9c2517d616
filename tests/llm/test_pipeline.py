"""The pipeline's stages, one after the other, against what each must do to its own input."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from dialoom.llm import decontaminate, mixing, near_dedup, quality, secret_scan
from dialoom.llm.common import stored

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, DATA), "test")
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns(stages):
    for d in stages[1:-1]:
        assert d.dtypes == stages[0].dtypes


def test_each_stage_on_its_own_input(spark, stages):
    first, good, single, clean, safe, mixed = stages
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(good) == ids(quality.scores(first, labels).where("predicted = 1"))
    assert ids(single) == ids(near_dedup.near_duplicates(good).where("kept"))
    assert ids(clean) == ids(decontaminate.hits(single, bench).where("NOT contaminated"))
    assert ids(safe) == ids(clean) and secret_scan.scan(safe).where("n_assign + n_access + n_hex > 0").count() == 0
    changed = safe.join(clean.select("doc_id", F.col("text").alias("before")), "doc_id").where("text <> before")
    assert ids(changed) == ids(secret_scan.scan(clean).where("spans <> ''"))
    assert changed.where("n_chars <> length(text)").count() == 0
    assert ids(mixed) == ids(mixing.mix(safe).where("copies > 0"))
    assert mixed.where("taken <> copies * size").count() == 0


def test_run_equals_the_stages(spark, stages):
    rows = lambda d: sorted((r["doc_id"], r["taken"], r["text"]) for r in d.collect())
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(stages[-1])


def test_odd_rows_pass_all_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, copies string, __row long"
    rows = [(None,) * 8, (1, None, None, None, None, 1, "x", 1), (2, "", "en", "a", 0, 1, "x", 1), (2, "", "en", "a", 0, 1, "x", 1), (3, "some words in a row here " * 2000, "en", None, 5, 1, "x", 1), (4, "password = abcdefghijklmnop", "en", "a", 5, 1, "x", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, f in corpus_pipeline.STAGES:
            out = stored(f(spark, docs, DATA), "odd")
            assert out.count() <= docs.count(), name


def test_registered_queries():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(names) == 11 and names[-1] == "pipeline"


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_queries_equal_their_sql(spark, duck, name):
    got, sql = __spark_entry__.queries()[name](spark, DATA), __spark_entry__.oracle_sql()[name]
    cols = sorted(got.columns)
    assert cols == sorted(c[0] for c in duck.execute(sql).description)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want, key=str)
