"""Blocks of more rows than the usual specification has: the query keeps them all, as its SQL does."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from docspark.plans import queries as q


@pytest.fixture(scope="module")
def long_blocks(spark, tmp_path_factory):
    """``lineitem`` with one order of 300 lines for each kind of block."""
    folder = str(tmp_path_factory.mktemp("long"))
    # (k + s) % 13 > 3 makes a line a row, and neither a note nor the end of the table; supplier numbers give different positions
    keys = [(k, s) for k in range(1, 1000) for s in (k % 30 + 30 * (k % 5),) if (k + s) % 13 > 3][:300]
    rows = [(order, k, s, j, float(1 + (k * 7) % 50), 1.0, 0.0, 0.0, "N", "O", datetime.datetime(2020, 1, 1)) for order in range(9, 18) for j, (k, s) in enumerate(keys, 1)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_long_blocks_keep_all_rows(spark, long_blocks):
    got = q.QUERIES["specifications"](spark, long_blocks).collect()
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{long_blocks}/lineitem.parquet/*.parquet')")
    rel = con.sql(q.ORACLE_SQL["specifications"])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    order = sorted(want[0])
    assert sorted(tuple(r[c] for c in order) for r in want) == sorted(tuple(r[c] for c in order) for r in got)
    size = {}
    for r in want:
        size[r["reading"]] = max(size.get(r["reading"], 0), r["row_no"])
    assert size["materials"] == 300 and size["standards"] > 80
