"""Queries cover their whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gristmill.functions import text
from gristmill.operators import contamination

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_hourly_archive_counts_every_event(spark):
    got = entry.queries()["hourly_archive"](spark, str(DATA))
    assert got.agg(F.sum("events")).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert got.count() == got.select("key").distinct().count() == 720


def test_short_item_match_of_every_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = entry.queries()["short_item_match_all"](spark, str(DATA)).select("doc_id", "h")
    pairs = {tuple(r) for r in got.join(got.withColumnRenamed("doc_id", "item"), "h").select("doc_id", "item").collect()}
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where(F.size(text.tokens(F.col("text"))) >= 6)
    items = docs.select("doc_id", "text").union(lines)
    want = {tuple(r) for r in contamination.short_matches(docs, contamination.blocklist(items, "doc_id")[1]).collect()}
    assert pairs == want
    assert {i % 50 for _, i in want} > {0}
