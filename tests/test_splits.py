"""Files with quotes in splits, runs and places of large groups, against plain loops."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import sheet as E
from folioframe.operators import validation as V
from folioframe.plans.islands import number_runs, number_within
from folioframe.sources import text as X


def records(text: str) -> dict[tuple[int, int], str]:
    sep = "\t" if "\t" in text.split("\n")[0] else ","
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, quoting=csv.QUOTE_NOTNULL) if r]
    return {(i, k): v for i, r in enumerate(rows) for k, v in enumerate(r) if v is not None}


def invented(seed: int, sep: str) -> str:
    """Records with fields of every kind: plain, empty, quoted with line ends, separators and doubled quotes, stray quotes."""
    draw = random.Random(seed)
    kinds = ["plain", "", '"a{0}b"', '"two\nlines"', '"a ""q"" b"', 'st"ray', '"x"tail', '"\n\n{0}\n"', '""', '"é漢"', 'a b', '"x""\ny"', '"a"b"c']
    lines = [sep.join(draw.choice(kinds).format(sep) for _ in range(draw.randint(1, 5))) for _ in range(120)]
    # The first line tells the separator.
    return sep.join(["first", "line"]) + "\n" + "\n".join(lines) + draw.choice(["", "\n", "\n\n"])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0b", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quoted_files_are_read_in_splits(spark, small_splits, tmp_path, seed):
    texts = {"a.csv": invented(seed, ","), "b.tsv": invented(seed + 50, "\t"), "c.csv": "x,y\r\n1,\"p\r\nq\"\r\n\r\n2,3\r\n", "d.csv": 'open,"never\nclosed,1\n' + "z,\n" * 40 + "z"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = spark.read.text(str(tmp_path / "a.csv"))
    assert lines.rdd.getNumPartitions() > 10
    got = {}
    for r in X.read_delimited(spark, str(tmp_path)).collect():
        got.setdefault(r.sheet_id.rsplit("/", 1)[1], {})[r.row, r.col] = r.value
    assert got == {name: records(text) for name, text in texts.items()}


@pytest.mark.parametrize("tab", [False, True])
def test_open_quotes_of_lines(tab):
    """The state at a line's end is the csv module's: one more line is part of the record if, and only if, a quote is open."""
    draw, sep = random.Random(7), "\t" if tab else ","
    for _ in range(4000):
        line = "".join(draw.choices(['"', sep, "a", '""', f'{sep}"', f'"{sep}'], k=draw.randint(0, 9)))
        for inside in (False, True):
            before = '"x\n' if inside else ""
            rows = list(csv.reader(io.StringIO(f"{before}{line}\nEND", newline=""), delimiter=sep))
            opened = rows[-1] != ["END"]
            assert X._opens(line, tab, inside) == opened, (line, inside)


@pytest.mark.parametrize("block", [1, 3, 8, 65_536])
def test_runs_over_blocks(spark, block):
    draw = random.Random(block)
    rows = [(g, x) for g in "ab" for x in draw.sample(range(60), 40)] + [("c", x) for x in range(30)] + [("d", 7), ("d", 7)]
    want = set()
    for g in "abcd":
        xs = sorted({x for k, x in rows if k == g})
        starts = [x for x in xs if x - 1 not in xs]
        want |= {(g, x, next(y for y in xs if y >= x and y + 1 not in xs)) for x in starts}
    df = spark.createDataFrame(rows, "g string, x int")
    assert {tuple(r) for r in number_runs(df, ["g"], "x", "first", "last", block).collect()} == want
    placed = number_within(df.withColumn("b", F.floor(F.col("x") / block)), ["g"], "b", "x", "n")
    got = {g: [r.x for r in sorted(placed.where(F.col("g") == g).collect(), key=lambda r: r.n)] for g in "abcd"}
    assert got == {g: sorted(x for k, x in rows if k == g) for g in "abcd"}


def test_runs_of_lists_are_sorted_once(spark):
    """Against a plain loop, with cells given twice; a task sorts its cells, and has no tables of cells and of runs beside them."""
    draw = random.Random(3)
    rows = [(s, v, r, c) for s in "st" for v in ("x,y", "z") for r in range(6) for c in draw.choices(range(12), k=9)] + [("u", "z", 0, c) for c in range(16_384)]
    want = set()
    for s, v, r in {x[:3] for x in rows}:
        xs = {c for *key, c in rows if key == [s, v, r]} if s != "u" else set(range(16_384))
        want |= {(s, v, r, x, next(y for y in range(x, 16_384) if y + 1 not in xs)) for x in xs if x - 1 not in xs}
    cells = spark.createDataFrame(rows, "sheet_id string, valid string, row int, col int")
    runs = V.compress_runs(cells)
    for made in (runs, V.squash_cells(cells)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("Aggregate"), plan.count("Exchange hashpartitioning"), plan.count("Sort [")) == (0, 1, 1)
    got = [tuple(r) for r in runs.drop("sqref").collect()]
    assert len(got) == len(want) and set(got) == want
    ends = {r.n: r.sqref for r in V.squash_cells(cells.where("sheet_id = 'u'").unionByName(spark.createDataFrame([("u", "z", r, 16_383) for r in (1, 1, 3, 3, 4)], cells.schema))).collect()}
    assert ends == {1: "A1:XFD2", 2: "XFD4:XFD5"}


def test_a_giant_sheet_spreads_over_its_blocks(spark, monkeypatch):
    """A million rows of one sheet: regions and headers, in many groups."""
    rows = spark.range(1_000_000).select(F.lit("s").alias("sheet_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.lit("1").alias("value")).where("row % 100000 <> 99999")
    found = sorted((r.top, r.bottom) for r in E.data_regions(rows).collect())
    assert found == [(100_000 * k, 100_000 * k + 99_998) for k in range(10)]
    assert sorted((r.top, r.bottom) for r in E.numeric_runs(rows).collect()) == found
    monkeypatch.setattr(E, "HEADER_ROWS", 1000)
    anchors = rows.where("row % 9973 = 0").select("sheet_id", "row")
    assert all(r.header == r.row // 100_000 * 100_000 for r in E.header_rows(E.data_regions(rows), anchors).collect())
    plan = E.data_regions(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and "_block" in plan
