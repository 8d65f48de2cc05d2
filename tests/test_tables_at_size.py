"""Queries on tables whose keys, times and files are those of large ones."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioframe.operators import calc as K
from folioframe.sources import documents as A
from tests.oracle import TABLES, matches

SMALL = "/root/testdata/sf0.001"


def folder(tmp_path, **tables: str) -> str:
    """The tables of SMALL, some of them replaced by SQL over them."""
    c = duckdb.connect()
    for t in TABLES:
        if t in tables:
            c.sql(f"copy ({tables[t]}) to '{tmp_path}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{SMALL}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


LINES = f"select * from '{SMALL}/lineitem.parquet'"
LONG = f"{LINES} union all select * replace (l_orderkey + 1600000 as l_orderkey) from '{SMALL}/lineitem.parquet' where l_orderkey < 200"


@pytest.mark.parametrize(
    ("name", "tables"),
    [
        # Sheets of more than 100,000 rows.
        ("recalc", {"lineitem": LONG}),
        # Ranges of more than 200,000 cells.
        ("range_agg", {"supplier": f"select * replace (s_suppkey + 59990 as s_suppkey) from '{SMALL}/supplier.parquet'"}),
        # Serials halfway between two of six decimals, and times a microsecond below the half of a second.
        ("date_serials", {"events": f"select * replace (make_timestamp(1704067200000000 + event_id * 86400000000 * 2 + CASE WHEN event_id % 2 = 0 THEN 43200 + 86400 * (event_id * 7919 % 999983) ELSE 500999 + 1000000 * (event_id * 31 % 86400) END) as ts) from '{SMALL}/events.parquet'"}),
    ],
)
def test_large_keys(spark, tmp_path, name, tables):
    assert matches(spark, entry.queries()[name], entry.oracle_sql()[name], folder(tmp_path, **tables))


@pytest.mark.parametrize("name", ["documents", "events"])
def test_streams_of_folders(spark, tmp_path, name):
    path = folder(tmp_path)
    os.remove(f"{path}/{name}.parquet")
    os.mkdir(f"{path}/{name}.parquet")
    duckdb.sql(f"copy (from '{SMALL}/{name}.parquet') to '{path}/{name}.parquet/part-0.parquet' (format parquet)")
    query = {"documents": "stream_spell_check", "events": "stream_recent"}[name]
    assert not entry.queries()[query](spark, path).exceptAll(entry.queries()[query](spark, SMALL)).count()
    assert entry.queries()[query](spark, path).count() == entry.queries()[query](spark, SMALL).count() > 0


def test_documents_of_a_line_each(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"id": 7, "blocks": [{"level": "1", "text": "x"}, {"code": "y"}]}\n{"blocks": [{"text": "z"}], "id": 8}\n')
    blocks, _ = A.read_doc_json(spark, str(tmp_path), "id")
    assert sorted((b.doc_id, b.block_idx, b.block_type, b.text) for b in blocks.collect()) == [("7", 0, "heading", "x"), ("7", 1, "code", "y"), ("8", 0, "paragraph", "z")]


def test_half_hundredths_of_a_line(spark):
    # The steps of the fit are those of plain sums and co-moments, in order.
    ys = [529.6, 411.15, 292.7, 174.24, 55.79]
    found = K.forecast(spark.createDataFrame([(1, i + 1, y) for i, y in enumerate(ys)], "k int, x int, y double"), "x", "y", ["k"], 1).first()
    n, mx, my, c = 0, 0.0, 0.0, 0.0
    for i, y in enumerate(ys):
        n, dx, dy = n + 1, i + 1 - mx, y - my
        mx, my = mx + dx / n, my + dy / n
        c += dx * (y - my)
    b = (c / n) / (10.0 / n)
    assert found.forecast == math.floor((sum(ys) / n - b * 3.0 + b * 6.0) * 100 + 0.5) / 100
