"""Rows of narrow tables are spread before they are parsed, and no test of a parsed column computes it again."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from larder.plans import inputs as I
from larder.plans.inputs import derived
from larder.plans.session import tasks

FOLDER = "/root/testdata/sf0.01"
NAMED = ("ingredient_groups", "unit_canonical", "repair_preview", "repaired_documents", "assembled_recipe", "scale_servings", "page_noise_removed", "line_parse_modular", "reparsed_documents")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMED)
def test_rows_are_dealt_between_scan_and_work(spark, name):
    lines = plan(__spark_entry__.queries()[name](spark, FOLDER)).splitlines()
    # Above a scan of few row groups stands nothing but the exchange; what is tested or computed comes later, and nothing is dealt twice.
    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line]
    assert scans
    for i in scans:
        above = [line for line in lines[:i] if "ColumnarToRow" not in line and not line.endswith("Filter isnotnull(p_partkey" + line.rpartition("p_partkey")[2])]
        assert "Exchange hashpartitioning(p_partkey" in above[-1]
    assert sum("Exchange hashpartitioning(" in line for line in lines) == len(scans) + (name in ("ingredient_groups", "assembled_recipe"))
    # A test that holds the expressions of a parse is tens of thousands of characters.
    assert max(len(line) for line in lines if "Filter " in line or "FileScan" in line or "hashpartitioning" in line) < 2500


def test_a_file_of_one_row_group_keeps_all_cores(spark):
    assert derived(spark, FOLDER, I.LINES).rdd.getNumPartitions() == tasks(spark) >= 4


@pytest.mark.parametrize("name", NAMED)
def test_results_are_those_of_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{FOLDER}/part.parquet'")
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    rows = sorted(map(repr, [tuple(r) for r in got.select(*columns).collect()]))
    assert rows == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))
