"""Range aggregates, recalculation, statistics, trends, series and column rules."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.scalar import js_number, js_round, parse_float, sheet_op, sheet_operand, sheet_result
from folioframe.operators.formulas import range_steps, recalc_formulas
from folioframe.operators.sheet import _cut
from folioframe.plans.islands import in_rectangles, sums_in_rectangles

#: Cells of a range beyond which it counts as empty.
RANGE_CAP = 200_000


def range_agg(cells: DataFrame, ranges: DataFrame, cap: int | None = RANGE_CAP) -> DataFrame:
    """(target, fn, result) of ranges (target, fn, sheet_id, r1, c1, r2, c2), fn one of SUM AVERAGE AVG MIN MAX COUNT.

    Every cell of the rectangle counts; blank, missing and text are 0. The area is arithmetic, never exploded. Ranges are made
    up of blocks that are summed once, so the work goes by cells and ranges, not by their pairs.
    """
    area = (F.col("r2") - F.col("r1") + 1).cast("long") * (F.col("c2") - F.col("c1") + 1)
    r = ranges.withColumn("area", area)
    live = r if cap is None else r.where(F.col("area") <= cap)
    numbers = cells.select("sheet_id", "row", "col", js_number(F.coalesce("value", F.lit(""))).alias("x")).where("x is not null and x <> 0")
    sums = sums_in_rectangles(numbers, live.select("target", "sheet_id", "r1", "c1", "r2", "c2"), "target")
    j = r.join(sums, "target", "left")
    empty = F.lit(False) if cap is None else F.col("area") > cap
    s, n = F.coalesce("s", F.lit(0.0)), F.coalesce("n", F.lit(0))
    # With a blank cell in the rectangle, 0 takes part in the least and the greatest.
    lo = F.when(n < F.col("area"), F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(n < F.col("area"), F.greatest(F.coalesce("hi", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("hi"))
    fn = F.upper("fn")
    value = F.when(fn == "SUM", s).when(fn.isin("AVERAGE", "AVG"), s / F.col("area")).when(fn == "MIN", lo).when(fn == "MAX", hi).when(fn == "COUNT", F.col("area").cast("double"))
    return j.select("target", "fn", F.when(empty, 0.0).otherwise(value).alias("result"), F.when(value.isNull() & ~empty, "#NAME?").alias("error"))


def recalc(cells: DataFrame, formulas: DataFrame, max_iter: int | None = None, cap: int | None = RANGE_CAP) -> DataFrame:
    """cells after formulas (sheet_id, row, col, fn, r1, c1, r2, c2), range aggregates over other cells, have settled.

    They settle along the graph of their dependencies (`recalc_formulas`); those of a cycle keep their values, with a
    warning. With max_iter, plain passes instead: each evaluates all formulas on the last values, until none changes;
    values that still change after max_iter are returned with a warning.
    An error doesn't replace a value. Lineage is cut each pass; only whether anything changed reaches the driver.
    """
    keys = ["sheet_id", "row", "col"]
    if max_iter is None:
        done = _cut(recalc_formulas(cells, range_steps(formulas), None, cap))
        if not done.where("cyclic").isEmpty():
            warnings.warn("recalc: formulas of a cycle keep their values", stacklevel=2)
        return done.drop("cyclic")
    f = formulas.withColumn("target", F.concat_ws("|", *keys))
    plain = cells.select(*keys, "value")
    state = plain
    for _ in range(max_iter):
        found = range_agg(state, f.select("target", "fn", "sheet_id", "r1", "c1", "r2", "c2"), cap)
        text = sheet_result(F.struct(F.col("result").alias("number"), F.col("error").alias("error")))
        new = f.select(*keys, "target").join(found, "target").select(*keys, text.alias("new"))
        merged = state.join(new, keys, "full_outer")
        keeps = F.col("new").isNull() | (F.col("new").startswith("#") & (F.coalesce("value", F.lit("")) != ""))
        merged = _cut(merged.select(*keys, F.when(keeps, F.col("value")).otherwise(F.col("new")).alias("after"), "value"))
        state = merged.select(*keys, F.col("after").alias("value"))
        if merged.where(~F.col("after").eqNullSafe(F.col("value"))).isEmpty():
            break
    else:
        warnings.warn("recalc: formulas still change; the values are those of the last pass", stacklevel=2)
    return state


def selection_stats(cells: DataFrame, areas: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """One row: count of filled cells, of numeric ones, their sum and average (2 decimals), over areas, hidden rows aside.

    A cell in several areas counts once. hidden: (sheet_id, row).
    """
    keys = ["sheet_id", "row", "col"]
    found = in_rectangles(cells.select(*keys, "value"), areas.select("sheet_id", "r1", "c1", "r2", "c2")).select(*keys, "value").dropDuplicates(keys)
    if hidden is not None:
        found = found.join(hidden.select("sheet_id", "row").distinct(), ["sheet_id", "row"], "left_anti")
    t = F.trim(F.coalesce("value", F.lit("")))
    x = F.when(t != "", js_number(t))
    return found.agg(F.count_if(t != "").alias("n_filled"), F.count(x).alias("n_numeric"), F.sum(x).alias("total"), js_round(F.avg(x), 2).alias("average"))


def auto_sum_range(runs: DataFrame, active: DataFrame) -> DataFrame:
    """active cells (sheet_id, row, col) with the numeric run (top, bottom) right above each."""
    return active.join(runs, ["sheet_id", "col"]).where(F.col("bottom") == F.col("row") - 1)


def forecast(df: DataFrame, x: str, y: str, by: list[str], n: int = 5) -> DataFrame:
    """(by, x, forecast): the least-squares line over numeric values, carried n rows on; groups of under two points, or of one x, have none."""
    v = parse_float(F.col(y).cast("string"))
    points = df.select(*by, F.col(x).cast("double").alias("_x"), v.alias("_y")).where("_y is not null and _x is not null")
    # In the steps of SQL engines that keep plain sums: where the line meets half a hundredth, the last bit decides.
    slope = F.covar_pop("_x", "_y") / F.nullif(F.var_pop("_x"), F.lit(0.0))
    fit = points.groupBy(*by).agg(slope.alias("_b"), F.max("_x").alias("_last"), F.count("*").alias("_n"), F.min("_x").alias("_first"), F.sum("_x").alias("_sx"), F.sum("_y").alias("_sy"))
    fit = fit.withColumn("_a", F.col("_sy") / F.col("_n") - F.col("_b") * (F.col("_sx") / F.col("_n")))
    ahead = fit.where("_n >= 2 and _last > _first").select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))
    ahead = ahead.withColumn("x", F.col("_last") + F.col("_k"))
    return ahead.select(*by, "x", js_round(F.col("_a") + F.col("_b") * F.col("x"), 2).alias("forecast"))


def fill_series(seeds: DataFrame, n: int, backwards: bool = False) -> DataFrame:
    """(series, step, value): the next n values of seeds (series, idx, value), step by step away from them.

    One number counts on by 1; an arithmetic, else a geometric progression goes on (to 1e-9); anything else repeats.
    backwards fills upwards or to the left: progressions still go on from the last seed, as editors do, and what repeats
    is read from the first seed back round.
    """
    text = F.trim("value")
    num = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double"))
    w = Window.partitionBy("series").orderBy("idx")
    s = seeds.withColumn("_v", num).withColumn("_d", F.col("_v") - F.lag("_v").over(w)).withColumn("_q", F.col("_v") / F.nullif(F.lag("_v").over(w), F.lit(0.0)))
    close = lambda c: F.coalesce(F.max(c) - F.min(c) <= 1e-9, F.lit(True))
    g = s.groupBy("series").agg(
        F.count("*").alias("_n"), F.bool_and(F.col("_v").isNotNull()).alias("_numeric"), close("_d").alias("_arith"), (close("_q") & (F.count("_q") == F.count("*") - 1)).alias("_geo"),
        F.max_by("_v", "idx").alias("_last"), F.coalesce(F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col("idx"))), F.lit(1.0)).alias("_step"),
        F.min_by("_q", F.when(F.col("_q").isNotNull(), F.col("idx"))).alias("_ratio"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("_all"),
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    r9 = lambda c: js_round(c, 9)
    value = F.when(F.col("_numeric") & F.col("_arith"), r9(F.col("_last") + F.col("_step") * F.col("step"))).when(
        F.col("_numeric") & F.col("_geo") & (F.col("_ratio") != 1), r9(F.col("_last") * F.pow("_ratio", "step"))
    )
    whole = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return g.select("series", "step", F.coalesce(whole, F.get("_all", F.pmod(1 - F.col("step") if backwards else F.col("step") - 1, F.col("_n")).cast("int"))).alias("value"))


def cond_rule(df: DataFrame, col: str, kind: str, by: list[str] | None = None, order_col: str | None = None) -> DataFrame:
    """df with `rule`: above or below average (true or false), top10 (by value, ties by order), or bar and scale (share of the span).

    Per group, or over the table: then an aggregate of one row is joined back, and the top ten come from a limit.
    """
    x = F.when(F.trim(F.col(col).cast("string")) != "", js_number(F.col(col).cast("string")))
    df = df.withColumn("_x", x)
    if kind == "top10":
        order = [F.desc("_x"), *([F.col(order_col)] if order_col else [])]
        if by:
            ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, F.col("_x").isNull()).orderBy(*order)))
            return ranked.withColumn("rule", F.col("_x").isNotNull() & (F.col("_r") <= 10)).drop("_x", "_r")
        top = df.where("_x is not null").orderBy(*order).limit(10).select(F.col(order_col).alias("_k")) if order_col else None
        if top is None:
            raise ValueError("top10 over a whole table needs order_col")
        return df.join(F.broadcast(top.withColumn("rule", F.lit(True))), df[order_col] == F.col("_k"), "left").drop("_k", "_x").withColumn("rule", F.coalesce("rule", F.lit(False)))
    group = by or []
    stats = df.groupBy(*group).agg(F.avg("_x").alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    joined = df.join(stats, group) if group else df.join(F.broadcast(stats))
    share = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.col("_x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    rule = {"above": F.col("_x") > F.col("_m"), "below": F.col("_x") < F.col("_m"), "bar": share, "scale": share}[kind]
    rule = F.coalesce(rule, F.lit(False)) if kind in ("above", "below") else rule
    return joined.withColumn("rule", rule).drop("_x", "_m", "_lo", "_hi")


def bar_alpha(share: Column) -> Column:
    return 0.15 + 0.55 * share


def threshold_rule(value: Column, kind: str, a: float, b: float | None = None) -> Column:
    """greaterThan, lessThan (strict), between (inclusive); not a number is false."""
    x = js_number(value.cast("string"))
    rule = {"greaterThan": x > a, "lessThan": x < a, "between": x.between(min(a, b if b is not None else a), max(a, b if b is not None else a))}[kind]
    return F.coalesce(rule, F.lit(False))


def chart_series(df: DataFrame, label: str, col: str, kind: str) -> DataFrame:
    """(label, value, share): bars and lines as a part of the span from min(values, 0) to max(values, 1); pies as a part of the total (0 counts as 1)."""
    rows = df.select(F.col(label).alias("label"), parse_float(F.col(col).cast("string")).alias("value")).where("value is not null")
    if kind in ("pie", "doughnut"):
        total = rows.agg(F.sum("value").alias("_t")).select(F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t")).alias("_t"))
        return rows.join(F.broadcast(total)).select("label", "value", (F.col("value") / F.col("_t")).alias("share"))
    span = rows.agg(F.least(F.min("value"), F.lit(0.0)).alias("_lo"), F.greatest(F.max("value"), F.lit(1.0)).alias("_hi"))
    return rows.join(F.broadcast(span)).select("label", "value", ((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).alias("share"))


def what_if(cells: DataFrame, fn: str, sheet_id: str, rect: tuple[int, int, int, int], op: str | None = None, operand: float | None = None) -> DataFrame:
    """One row, `result`: fn over the rectangle, then op with a number, as a static value."""
    r1, c1, r2, c2 = rect
    ranges = cells.sparkSession.range(1).select(F.lit("what-if").alias("target"), F.lit(fn).alias("fn"), F.lit(sheet_id).alias("sheet_id"), *[F.lit(v).alias(k) for k, v in (("r1", r1), ("c1", c1), ("r2", r2), ("c2", c2))])
    found = range_agg(cells, ranges).select(F.struct(F.col("result").alias("number"), F.col("error").alias("error")).alias("v"))
    value = F.col("v") if op is None else sheet_op(op, F.col("v"), sheet_operand(F.lit(str(operand))))
    return found.select(sheet_result(value).alias("result"))
