"""Composed formulas: long chains, cycles, changes alone, and random graphs against plain recursion."""

import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from folioframe.operators import calc as K
from folioframe.operators import formulas as R
from folioframe.plans.islands import in_rectangles, tiles

CELLS = "sheet_id string, row int, col int, value string"
STEPS = "sheet_id string, row int, col int, step int, kind string, op string, n int, number double, r1 int, c1 int, r2 int, c2 int"


def num(x):
    return ("num", None, None, float(x), None, None, None, None)


def ref(r, c):
    return ("ref", None, None, None, r, c, None, None)


def area(r1, c1, r2, c2):
    return ("range", None, None, None, r1, c1, r2, c2)


def op(o):
    return ("op", o, None, None, None, None, None, None)


def fn(name, n):
    return ("fn", name, n, None, None, None, None, None)


NEG = ("neg", None, None, None, None, None, None, None)


def steps(spark, formulas):
    return spark.createDataFrame([("s", r, c, i, *step) for (r, c), program in formulas.items() for i, step in enumerate(program)], STEPS)


def settle(spark, cells, formulas, changed=None):
    frame = spark.createDataFrame([("s", r, c, v) for (r, c), v in cells.items()], CELLS)
    if changed is not None:
        changed = spark.createDataFrame([("s", *k) for k in changed], "sheet_id string, row int, col int")
    got = R.recalc_formulas(frame, steps(spark, formulas), changed).collect()
    return {(r.row, r.col): (r.value, r.cyclic) for r in got}


@pytest.mark.parametrize(
    "program,want",
    [
        ([ref(0, 0), ref(0, 1), area(0, 2, 8, 2), ref(0, 3), fn("SUM", 2), op("*"), op("+")], "26"),
        ([num(1), num(0), op("/")], "#DIV/0!"),
        ([num(1), num(0), op("/"), num(1), op("+")], "#ERROR"),
        ([num(1), fn("FOO", 1)], "#NAME?"),
        ([num(2), NEG, num(2), op("^")], "4"),
        ([num(-2.5), num(0), fn("ROUND", 2)], "-2"),
        ([num(2), num(3), op("^"), num(2), op("^")], "64"),
        ([ref(0, 4), num(1), op("+")], "#ERROR"),
        ([ref(0, 4)], "text"),
        ([area(0, 2, 8, 2)], "3"),
        ([area(0, 0, 0, 0), num(1), op("+")], "3"),
        ([area(0, 2, 8, 2), num(1), op("+")], "#ERROR"),
        ([area(0, 0, 0, 3), ref(0, 4), num(-7), fn("MIN", 3)], "-7"),
        ([area(0, 0, 1, 4), fn("AVERAGE", 1)], "1.3"),
        ([area(0, 0, 1, 4), ref(0, 4), fn("COUNT", 2)], "11"),
        ([fn("SUM", 0)], "0"),
        ([fn("MAX", 0)], "0"),
        ([area(0, 0, 300_000, 0), fn("SUM", 1)], "0"),
        ([ref(5, 5), NEG, fn("ABS", 1)], "0"),
        ([num(1), num(3), op("/")], repr(1 / 3)),
        ([num(1e-6)], "0.000001"),
        ([num(1e300), num(1e300), op("*")], "#ERROR"),
        ([op("+")], "#ERROR"),
    ],
)
def test_values(spark, program, want):
    cells = {(0, 0): "2", (0, 1): "3", (0, 2): "3", (8, 2): " 1 ", (4, 2): "x", (0, 3): "4", (0, 4): "text", (1, 0): "1"}
    assert settle(spark, cells, {(20, 20): program})[20, 20] == (want, False)


def test_a_chain_of_ten_thousand_rows_takes_few_rounds(spark, monkeypatch):
    """A running total: each row adds its own product to the row above."""
    rounds = []
    cut = R._cut
    monkeypatch.setattr(R, "_cut", lambda df: (rounds.append(1), cut(df))[1])
    n = 10_000
    cells = {(r, 0): str(r % 7) for r in range(n)}
    total = {(0, 1): [ref(0, 0), num(2), op("*")]} | {(r, 1): [ref(r - 1, 1), ref(r, 0), num(2), op("*"), op("+")] for r in range(1, n)}
    got = settle(spark, cells, total)
    want = 0
    for r in range(n):
        want += 2 * (r % 7)
        assert got[r, 1] == (str(want), False)
    assert len(rounds) < 30


def test_cycles_are_told_and_keep_their_values(spark):
    cells = {(0, 0): "5", (1, 0): "old", (2, 0): "7", (3, 0): ""}
    formulas = {(1, 0): [ref(2, 0)], (2, 0): [ref(1, 0), num(1), op("+")], (3, 0): [ref(2, 0)], (4, 0): [ref(0, 0), num(1), op("+")], (5000, 0): [ref(5000, 0)]}
    got = settle(spark, cells, formulas)
    assert got == {(0, 0): ("5", False), (1, 0): ("old", True), (2, 0): ("7", True), (3, 0): ("", True), (4, 0): ("6", False), (5000, 0): (None, True)}
    with pytest.warns(UserWarning, match="cycle"):
        K.recalc(spark.createDataFrame([("s", 0, 0, "1")], CELLS), spark.createDataFrame([("s", 1, 0, "SUM", 1, 0, 1, 0)], "sheet_id string, row int, col int, fn string, r1 int, c1 int, r2 int, c2 int"))


def test_only_what_changes_reach_is_evaluated(spark):
    """Values that nothing new reaches stay, even where evaluation would give others."""
    cells = {(0, 0): "9", (0, 1): "1", (1, 0): "stale", (1, 1): "stale", (2, 0): "stale", (2000, 0): "10", (2001, 0): "stale"}
    formulas = {
        (1, 0): [ref(0, 0), num(1), op("+")], (1, 1): [ref(0, 1), num(1), op("+")], (2, 0): [area(1, 0, 1, 1), fn("COUNT", 1)],
        (2000, 0): [ref(1, 0)], (2001, 0): [ref(2000, 0)], (3, 0): [area(7, 0, 9, 0), fn("SUM", 1)],
    }
    got = {k: v for k, (v, _) in settle(spark, cells, formulas, [(0, 0)]).items()}
    # (2000, 0) gets the value it had, so nothing changes behind it.
    assert got == {(0, 0): "9", (0, 1): "1", (1, 0): "10", (1, 1): "stale", (2, 0): "2", (2000, 0): "10", (2001, 0): "stale", (3, 0): None}
    got = {k: v for k, (v, _) in settle(spark, cells, formulas, [(8, 0), (2001, 0)]).items() if k != (8, 0)}
    assert got[3, 0] == "0" and got[2001, 0] == "10" and got[1, 0] == "stale"


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4), (3, 16)])
def test_random_graphs(spark, monkeypatch, seed, block):
    """Formulas over random cells and ranges, in few and in many blocks, by plain recursion."""
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    draw = random.Random(seed)
    places = [(r, c) for r in range(40) for c in range(4)]
    draw.shuffle(places)
    formulas, cells = {}, {p: draw.choice(["3", "-2", "0.5", "", " ", "x", "12"]) for p in places[:60]}
    free = lambda: draw.choice(places)
    for p in places[60:140]:
        a, b = free(), free()
        box = area(min(a[0], b[0]), min(a[1], b[1]), min(a[0], b[0]) + draw.randint(0, 3), max(a[1], b[1]))
        formulas[p] = draw.choice([
            [ref(*a), ref(*b), op(draw.choice("+-*/"))], [box, fn(draw.choice(["SUM", "MIN", "MAX", "AVERAGE", "COUNT"]), 1)], [ref(*a), box, num(2), fn("SUM", 3), num(1), fn("ROUND", 2)], [num(4)],
        ])
    for p in list(formulas)[::9]:
        cells[p] = draw.choice(["1", "7"])
    inside = lambda s: [(r, c) for r in range(s[4], (s[6] if s[6] is not None else s[4]) + 1) for c in range(s[5], (s[7] if s[7] is not None else s[5]) + 1)]
    needs = {p: {q for s in program if s[0] in ("ref", "range") for q in inside(s) if q in formulas} for p, program in formulas.items()}
    value, left = {p: v for p, v in cells.items() if p not in formulas}, set(formulas)
    while ready := [p for p in left if not needs[p] & left]:
        for p in ready:
            inputs = {}
            for i, s in enumerate(formulas[p]):
                if s[0] in ("ref", "range"):
                    xs = [R.to_number(value.get(q) or "") for q in inside(s)]
                    xs = [x for x in xs if x and not math.isnan(x)]
                    inputs[i] = (sum(xs), min(xs, default=None), max(xs, default=None), len(xs), len(inside(s)), value.get((s[4], s[5])))
            got = R.evaluate([dict(zip(("step", "kind", "op", "n", "number"), (i, *s[:4]))) for i, s in enumerate(formulas[p])], inputs)
            value[p] = cells[p] if got.startswith("#") and cells.get(p) else got
        left -= set(ready)
    got = settle(spark, cells, formulas)
    near = lambda a, b: a == b or (a and b and math.isclose(R.to_number(a), R.to_number(b), rel_tol=1e-12))
    assert {p for p in formulas if got[p][1]} == left and 0 < len(left) < len(formulas)
    assert all(near(got[p][0], value[p] if p not in left else cells.get(p)) for p in formulas)


def test_blocks_are_read_once_in_the_order_of_their_needs(spark, monkeypatch):
    """Each formula of a chain over many blocks goes to a task once, whichever way it runs; blocks in a ring of blocks, and behind it, settle too."""
    counted, settle_block = spark.sparkContext.accumulator(0), R._settle

    def counting(rows, arrived=None):
        counted.add(rows.num_rows)
        return settle_block(rows, arrived)

    monkeypatch.setattr(R, "BLOCK_ROWS", 16)
    monkeypatch.setattr(R, "GROUP_FORMULAS", 40)
    monkeypatch.setattr(R, "_settle", counting)
    n = 400
    cells = {(r, 0): str(r % 7) for r in range(n)}
    down = {(0, 1): [ref(0, 0)]} | {(r, 1): [ref(r - 1, 1), ref(r, 0), op("+")] for r in range(1, n)} | {(r, 2): [area(r, 0, r, 1), fn("MAX", 1)] for r in range(n)}
    got = settle(spark, cells, down)
    total = 0
    for r in range(n):
        total += r % 7
        assert got[r, 1] == (str(total), False) and got[r, 2] == (str(max(total, r % 7)), False)
    assert counted.value == 2 * n
    # Up and down at once: every block needs its neighbours.
    n = 48
    total = sum(r % 7 for r in range(n))
    up = {(n - 1, 3): [num(1)]} | {(r, 3): [ref(r + 1, 3), num(1), op("+")] for r in range(n - 1)}
    both = {k: v for k, v in down.items() if k[1] == 1 and k[0] < n} | up | {(5000, 1): [ref(n - 1, 1), ref(0, 3), op("+")]}
    got = settle(spark, cells, both)
    assert got[n - 1, 1] == (str(total), False) and got[0, 3] == (str(n), False) and got[5000, 1] == (str(total + n), False)
    assert not any(cyclic for _, cyclic in got.values())


def test_plain_passes_agree(spark):
    cells = spark.createDataFrame([("s", r, 0, str(r)) for r in range(9)], CELLS)
    chain = [("s", r, 1, "SUM", 0, 0, r, 0) for r in range(9)] + [("s", r, 2, "MAX", 0, 1, r, 1) for r in range(9)]
    formulas = spark.createDataFrame(chain, "sheet_id string, row int, col int, fn string, r1 int, c1 int, r2 int, c2 int")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        both = [{tuple(r)[:3]: float(r.value) for r in K.recalc(cells, formulas, n).collect()} for n in (None, 5)]
    assert both[0] == both[1]


def test_a_whole_sheet_is_few_tiles(spark):
    """Every cell of a sheet lies in it once; a rectangle as large as a sheet, a column or a row is joined by under 100 tiles."""
    cells = spark.createDataFrame([("s", r, c) for r in (0, 63, 64, 5000, 1_048_575) for c in (0, 1, 200, 16_383)], "sheet_id string, row int, col int")
    boxes = [(0, 0, 1_048_575, 16_383), (0, 1, 1_048_575, 1), (5000, 0, 5000, 16_383), (0, 0, 63, 0), (64, 1, 64, 1), (60, 190, 70, 210)]
    rects = spark.createDataFrame([("s", *b, k) for k, b in enumerate(boxes)], "sheet_id string, r1 int, c1 int, r2 int, c2 int, k int")
    got = sorted((r.k, r.row, r.col) for r in in_rectangles(cells, rects).collect())
    want = sorted((k, r.row, r.col) for k, b in enumerate(boxes) for r in cells.collect() if b[0] <= r.row <= b[2] and b[1] <= r.col <= b[3])
    assert got == want
    counts = {r.k: r["count"] for r in tiles(rects).groupBy("k").count().collect()}
    assert max(counts.values()) <= 81 and counts[1] <= 9 and counts[4] == 1
