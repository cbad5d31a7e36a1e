"""Every registered query equals its SQL on the smallest tables."""
from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_sql(spark, con, name: str) -> None:
    verdict, n = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict in ("ok", "rows only")
    assert n > 0 or name in ("record_counts",)


def test_entry_has_rows(spark) -> None:
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["attempt_statuses", "crawl_report", "resolve_attempts", "escalation_set"])
def test_urls_listed_twice_are_those_of_the_sql(spark, tmp_path, name: str) -> None:
    """Pages that share a URL, and so the numbers of their attempts, which the SQL leaves open: the first listed counts, as where DuckDB runs on one thread."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    n = pages.count()
    pages.unionByName(pages.withColumn("page_id", pages.page_id + n + 5)).coalesce(1).sortWithinPartitions("page_id").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), entry.queries()[name], entry.oracle_sql()[name]) == ("ok", len(con.execute(entry.oracle_sql()[name]).fetchall()))
