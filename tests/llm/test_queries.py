"""Registered queries against their SQL twins, and the shape of all of them."""

from __future__ import annotations

import os

import oracle
import pytest

from panelkit.llm import queries

SF = os.environ.get("PANELKIT_SF", "/root/testdata/sf0.001")
KEYS = {2: "embeddings", 3: "pages"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    diff = oracle.compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], oracle.connect(SF))
    assert diff is None, diff


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows_for_the_whole_table(spark, name):
    number = int(name[2:].split("_")[0])
    table = spark.read.parquet(f"{SF}/{KEYS.get(number, 'documents')}.parquet")
    key = "page_id" if number == 3 else "doc_id"
    got = queries.QUERIES[name](spark, SF)
    assert got.select(key).distinct().count() == table.count()
