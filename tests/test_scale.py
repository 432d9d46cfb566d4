"""What crosses a shuffle, on rows of the tests' own."""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.operators.lifecycle import merge_state
from feedloom.plans import views


def exchanges(df):
    """(columns, partitioning) of every exchange of a plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*)", text)


@pytest.fixture
def shuffled(spark):
    """As at a size where no side of a join is small enough to be broadcast."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_absent_rows_cross_one_shuffle_and_none_on_their_source(spark, shuffled):
    rows = [{"job_id": j, "company": "Acme", "title": j, "application_url": "", "description": d} for j, d in (("a", "old"), ("b", ""), ("c", "x"))]
    schema = "job_id STRING, company STRING, title STRING, application_url STRING, description STRING"
    state = spark.createDataFrame(rows, schema)
    fetched = state.where("job_id = 'c'").withColumn("fetch_ord", F.lit(1))
    ok, at = state.select("company"), F.lit("2026-07-12 12:00:00").cast("timestamp")
    state = merge_state(fetched, state, state.where("FALSE"), ok, at).state
    gone = state.where("lifecycle IN ('missing', 'carried', 'closed')").select("job_id", "description", "lifecycle")
    wide = [by for columns, by in exchanges(gone) if "description#" in columns]
    assert wide and not [by for by in wide if "company#" in by and "job_id#" not in by]
    assert {(r["job_id"], r["description"]) for r in gone.collect()} == {("a", "old"), ("b", "")}


@pytest.fixture
def small_tables(spark, tmp_path):
    """Documents with a repeated number, a missing number and a missing text."""
    docs = [(1, "One. Rest", "en"), (1, "Other. Rest", "en"), (None, "None. Rest", "de"), (2, None, "en"), (3, "One. Rest", "fr")]
    tables = {
        "documents": ([(n, t, g, "src1", 10) for n, t, g in docs], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
        "nation": ([(10, "NATION_10", 0)], "n_nationkey INT, n_name STRING, n_regionkey INT"),
        "region": ([(0, "EUROPE")], "r_regionkey INT, r_name STRING"),
        "orders": ([(1, datetime(1998, 1, 1))], "o_orderkey BIGINT, o_orderdate TIMESTAMP"),
        "pages": ([(1, "https://a.test/1"), (2, "https://a.test/2")], "page_id BIGINT, url STRING"),
        "labels": ([(1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_text_crosses_no_join_of_a_plan_that_does_not_show_it(spark, small_tables, shuffled):
    titles = views.records(spark, small_tables).select("doc_id", "title", "application_url")
    found = exchanges(titles)
    assert found and not [c for c, _ in found if "text#" in c or "description#" in c]


def test_texts_come_back_to_the_rows_that_named_them(spark, small_tables):
    known = views.history(spark, small_tables)
    assert {r["description"] for r in known.collect()} == {""}
    told = lambda df: Counter((r["doc_id"], r["title"], r["description"]) for r in df.collect())
    whole = views.records(spark, small_tables).na.fill("", ["description"])
    assert told(views.with_texts(known, spark, small_tables)) == told(whole)
