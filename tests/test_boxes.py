"""Boxes of overlapping rectangles against a plain loop, and many rectangles in one block of rows."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioframe.operators import calc as K
from folioframe.operators import sheet as E
from folioframe.plans import islands as I

SCHEMA = "sheet_id string, r1 int, c1 int, r2 int, c2 int"


def plain(rects: set[tuple]) -> set[tuple]:
    """Merge any two that overlap until none do."""
    left = set(rects)
    while True:
        for x in sorted(left):
            met = [y for y in left if x[0] == y[0] and x[1] <= y[3] and x[3] >= y[1] and x[2] <= y[4] and x[4] >= y[2]]
            if len(met) > 1:
                left -= set(met)
                left.add((x[0], *(f(y[i] for y in met) for f, i in ((min, 1), (min, 2), (max, 3), (max, 4)))))
                break
        else:
            return left


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 7), (3, 16)])
def test_boxes_are_those_of_a_plain_loop(spark, seed, block):
    draw = random.Random(seed)
    rects = set()
    for sheet in ("a", "b"):
        for _ in range(70):
            r, c = draw.randint(0, 80), draw.randint(0, 60)
            rects.add((sheet, r, c, r + draw.choice([0, 0, 1, 4, 9]), c + draw.choice([0, 0, 2, 5])))
    rects |= {("c", 0, 5, 90, 5), ("c", 40, 0, 40, 90), ("c", 2, 2, 3, 3), ("c", 91, 5, 91, 5)}
    # A box that grows upwards takes in one that the sweep has passed.
    rects |= {("d", 0, 0, 0, 9), ("d", 5, 0, 5, 0), ("d", 2, 5, 5, 5), ("d", 5, 0, 5, 5), ("d", 3, 1, 3, 2)}
    got = {tuple(r) for r in E.coalesce_rects(spark.createDataFrame(sorted(rects), SCHEMA), block).collect()}
    assert got == plain(rects)


def test_a_sweep_follows_the_number_of_rectangles():
    """A hundred thousand rectangles of one block of rows, apart and in chains, in far less time than their pairs would take."""
    draw = random.Random(4)
    rows = [("s", r := draw.randint(0, 900), c := draw.randint(0, 16_000), r + draw.randint(0, 1), c) for _ in range(100_000)]
    began = time.perf_counter()
    out = E._boxes(pd.DataFrame(rows, columns=["sheet_id", "r1", "c1", "r2", "c2"]))
    assert time.perf_counter() - began < 20 and len(out) == 100_000
    assert ((out["a"] <= out["r1"]) & (out["d"] >= out["c2"])).all()


def test_a_range_is_a_few_blocks_that_hold_each_place_once(spark):
    draw = random.Random(3)
    ends = [(a, a + draw.choice([0, 1, 7, 8, 63, 64, 500, 5000])) for a in [draw.randrange(3000) for _ in range(150)] + [0, 8, 64, 512]] + [(5, 1_048_575), (0, 262_143), (9, 3)]
    rows = spark.createDataFrame(ends, "a int, b int").select("a", "b", I._blocks(F.col("a"), F.col("b"), 6).alias("blocks")).collect()
    for r in rows:
        assert len(r.blocks) <= 14 * 7
        held = sorted((x.at * 8**x.level, 8**x.level) for x in r.blocks)
        # Each block begins where the one before it ends.
        assert [at for at, _ in held] == [r.a + sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) == max(0, r.b - r.a + 1)


def test_sums_of_ranges_are_those_of_their_cells(spark):
    draw = random.Random(4)
    cells = [(draw.choice("st"), draw.randrange(2000), draw.randrange(90), draw.choice(["3", "-7", "0.5", "n/a", " ", "0", None])) for _ in range(3000)]
    ranges = [(f"r{i}", fn, draw.choice("stu"), a, b, a + draw.choice([0, 8, 70, 1500]), b + draw.choice([0, 1, 9, 80])) for i, fn in enumerate(["SUM", "AVERAGE", "MIN", "MAX", "COUNT", "ODD"] * 25) for a, b in [(draw.randrange(1500), draw.randrange(70))]]
    ranges += [("whole", "SUM", "s", 0, 0, 1_048_575, 2), ("wide", "MIN", "t", 5, 0, 9, 16_383), ("none", "MAX", "s", 4, 4, 3, 4)]
    found = K.range_agg(spark.createDataFrame(cells, "sheet_id string, row int, col int, value string"), spark.createDataFrame(ranges, "target string, fn string, sheet_id string, r1 int, c1 int, r2 int, c2 int"), None)
    got = {r.target: (r.result, r.error) for r in found.collect()}
    # Blocks are many more than the ranges whose size Spark knows: they are never broadcast.
    joins = I.sums_in_rectangles(spark.range(9).selectExpr("'s' sheet_id", "id row", "id col", "1.0D x"), spark.range(9).selectExpr("id target", "'s' sheet_id", "id r1", "0 c1", "id + 9 r2", "1 c2"), "target")
    assert "SortMergeJoin" in joins._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" not in joins._jdf.queryExecution().executedPlan().toString()
    for target, fn, sheet, r1, c1, r2, c2 in ranges:
        xs = [float(v) for s, r, c, v in cells if s == sheet and r1 <= r <= r2 and c1 <= c <= c2 and v not in ("n/a", " ", "0", None)]
        area = (r2 - r1 + 1) * (c2 - c1 + 1)
        ends = xs + [0.0] * (len(xs) < area)
        want = {"SUM": sum(xs), "AVERAGE": sum(xs) / area if area else None, "MIN": min(ends, default=None), "MAX": max(ends, default=None), "COUNT": float(area), "ODD": None}[fn]
        assert got[target] == (want, "#NAME?" if want is None else None)
