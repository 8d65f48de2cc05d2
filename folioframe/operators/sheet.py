"""Sheet operators: filter, sort, duplicates, find, and restructuring of rows, columns and merges.

A sheet is either a wide DataFrame with an order column, or cells (sheet_id, row, col, value, formula), 0-based.
Everything is partitioned by sheet; nothing orders a whole table in one task.
"""

from __future__ import annotations

import bisect
import re
import tempfile
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.scalar import cell_ref, js_number, parse_float
from folioframe.plans.islands import in_rectangles, number_runs


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def auto_filter(df: DataFrame, allowed: dict[str, Sequence[str] | DataFrame]) -> DataFrame:
    """Rows whose trimmed values are allowed in every filtered column; "" allows blanks, an empty set nothing.

    A set may be a DataFrame of one column, for a semi-join.
    """
    for name, values in allowed.items():
        own = F.trim(F.coalesce(df[name].cast("string"), F.lit("")))
        if isinstance(values, DataFrame):
            keys = values.select(F.trim(F.coalesce(values[0].cast("string"), F.lit(""))).alias("_allowed"))
            df = df.join(keys, own == keys["_allowed"], "left_semi")
        else:
            df = df.where(own.isin(*values) if len(values) else F.lit(False))
    return df


def filter_values(df: DataFrame, col: str, search: str | None = None, locale: str | None = "zh") -> DataFrame:
    """(value, pos): the distinct trimmed values in filter order: numbers by value if all are, else text in the locale's order; the blank last.

    A search narrows them, ignoring case; the blank stays.
    """
    values = df.select(F.trim(F.coalesce(F.col(col).cast("string"), F.lit(""))).alias("value")).distinct()
    numeric = values.agg(F.bool_and((F.col("value") == "") | js_number(F.col("value")).isNotNull()).alias("_numeric"))
    values = values.join(F.broadcast(numeric))
    if search:
        values = values.where((F.col("value") == "") | F.lower("value").contains(search.lower()))
    text = F.collate("value", locale) if locale else F.col("value")
    ordered = values.orderBy(F.col("value") == "", F.when(F.col("_numeric"), js_number(F.col("value"))), text, "value")
    return number_rows(ordered, "pos").select("value", (F.col("pos") + 1).cast("int").alias("pos"))


def multi_sort(df: DataFrame, levels: list[tuple[str, bool]], order_col: str, locale: str | None = "zh", pos: str | None = None) -> DataFrame:
    """df sorted by (column, ascending) levels: blanks last both ways, numbers by value where a whole column is numeric,
    text by the locale's collation, ties by order_col. pos names a column for the new place, counted over range
    partitions rather than in one task.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kinds = df.agg(*[F.bool_and(_blank(F.col(c)) | js_number(text(c)).isNotNull()).alias(c) for c, _ in levels]).first()
    keys: list[Column] = []
    for c, ascending in levels:
        key = parse_float(F.trim(text(c))) if kinds[c] or kinds[c] is None else F.collate(F.trim(text(c)), locale) if locale else F.trim(text(c))
        keys += [_blank(F.col(c)).asc(), key.asc() if ascending else key.desc()]
    ordered = df.orderBy(*keys, F.col(order_col))
    return ordered if pos is None else number_rows(ordered, pos)


def number_rows(ordered: DataFrame, name: str) -> DataFrame:
    """A sorted DataFrame with the 0-based place of each row: its place in its partition plus the sizes of those before."""
    # The sorted rows are kept, so that sizes and places are those of the same partitions.
    numbered = _cut(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)))
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def sort_rows_text(df: DataFrame, col: str, ascending: bool = True) -> DataFrame:
    """df by one column as plain text."""
    key = F.col(col).cast("string")
    return df.orderBy(key.asc() if ascending else key.desc())


def filled_rows(cells: DataFrame) -> DataFrame:
    return cells.where(~_blank(F.col("value"))).select("sheet_id", "row").distinct()


def data_regions(cells: DataFrame) -> DataFrame:
    """(sheet_id, top, bottom) of each block of rows that have a value."""
    return number_runs(filled_rows(cells), ["sheet_id"], "row", "top", "bottom")


#: Rows to a block, where headers are looked up block by block.
HEADER_ROWS = 65_536


def header_rows(regions: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors (sheet_id, row) with header: the top of the region they are in, or of the nearest one above.

    That is the largest top up to the row: the largest of the blocks of rows before, or one within its own block, whose
    tops and anchors are walked once.
    """
    none = F.lit(None).cast("int")
    both = regions.select("sheet_id", F.col("top").alias("row"), F.col("top"), F.lit(False).alias("_asked")).unionByName(
        anchors.select("sheet_id", "row", none.alias("top"), F.lit(True).alias("_asked")).distinct()
    ).withColumn("_block", F.floor(F.col("row") / HEADER_ROWS))
    before = Window.partitionBy("sheet_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("sheet_id", "_block").agg(F.max("top").alias("_top")).select("sheet_id", "_block", F.max("_top").over(before).alias("_above"))
    above = Window.partitionBy("sheet_id", "_block").orderBy("row", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("header", F.max("top").over(above)).join(blocks, ["sheet_id", "_block"])
    return own.withColumn("header", F.coalesce("header", "_above")).where("_asked and header is not null").select("sheet_id", "row", "header")


def remove_duplicates(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """The first row of each value in the order of order_col; rows with a blank value all stay.

    Values are grouped and joined by their SHA-256, so that long texts aren't shuffled.
    """
    own = F.sha2(F.col(col).cast("string"), 256)
    first = df.where(~_blank(F.col(col))).groupBy(own.alias("_v")).agg(F.min(order_col).alias("_first"))
    kept = df.join(first, (own == F.col("_v")) & (df[order_col] == F.col("_first")), "left_semi")
    return kept.unionByName(df.where(_blank(F.col(col))))


def text_to_columns(df: DataFrame, col: str, n: int) -> DataFrame:
    """df with col_1 to col_n: the pieces of the trimmed text between white space, commas and semicolons."""
    parts = F.split(F.trim(F.col(col)), r"[\s,;\t]+")
    return df.select("*", *[F.get(parts, F.lit(i)).alias(f"{col}_{i + 1}") for i in range(n)])


def find_cells(cells: DataFrame, query: str) -> DataFrame:
    """Cells whose value or formula contains the query, ignoring case."""
    q = query.lower()
    return cells.where(F.lower(F.coalesce("value", F.lit(""))).contains(q) | F.lower(F.coalesce("formula", F.lit(""))).contains(q))


def search_cells(cells: DataFrame, value: str, regex: bool = False) -> DataFrame:
    """(sheet_id, row, col, ref) of cells that equal the value, or match it as a pattern."""
    hit = F.col("value").rlike(value) if regex else F.col("value") == value
    return cells.where(hit).select("sheet_id", "row", "col", cell_ref(F.col("col") + 1, F.col("row") + 1).alias("ref"))


def replace_cells(cells: DataFrame, find: str, replacement: str) -> DataFrame:
    """Cells with every occurrence replaced, where there is no formula; case counts."""
    plain = F.coalesce("formula", F.lit("")) == ""
    return cells.withColumn("value", F.when(plain & (F.lit(find) != ""), F.replace("value", F.lit(find), F.lit(replacement))).otherwise(F.col("value")))


def insert_lines(cells: DataFrame, axis: str, at: int, n: int = 1) -> DataFrame:
    """n empty rows or columns (axis `row` or `col`) before `at`: what lies there or after moves on."""
    return cells.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) + n).otherwise(F.col(axis)))


def delete_lines(cells: DataFrame, axis: str, at: int, n: int = 1) -> DataFrame:
    """Rows or columns at to at + n - 1 vanish, those after move up."""
    kept = cells.where((F.col(axis) < at) | (F.col(axis) >= at + n))
    return kept.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) - n).otherwise(F.col(axis)))


def shift_merges(merges: DataFrame, axis: str, at: int, n: int, delete: bool = False) -> DataFrame:
    """Merged rectangles after an insertion or deletion: one stays if both its corners do."""
    a, b = ("r1", "r2") if axis == "row" else ("c1", "c2")
    if delete:
        merges = merges.where(~F.col(a).between(at, at + n - 1) & ~F.col(b).between(at, at + n - 1))
    step = -n if delete else n
    moved = merges
    for c in (a, b):
        moved = moved.withColumn(c, F.when(F.col(c) >= at, F.col(c) + step).otherwise(F.col(c)))
    return moved


def covered_cells(merges: DataFrame) -> DataFrame:
    """(sheet_id, row, col, top_row, top_col) of every cell that a merge hides."""
    rows = merges.select("*", F.explode(F.sequence("r1", "r2")).alias("row")).select("*", F.explode(F.sequence("c1", "c2")).alias("col"))
    return rows.where("row <> r1 or col <> c1").select("sheet_id", "row", "col", F.col("r1").alias("top_row"), F.col("c1").alias("top_col"))


def merge_region(merges: DataFrame, sheet_id: str, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """merges with one more rectangle, in place of those it meets."""
    new = merges.sparkSession.range(1).select(F.lit(sheet_id).alias("sheet_id"), *[F.lit(v).cast("int").alias(k) for k, v in (("r1", min(r1, r2)), ("c1", min(c1, c2)), ("r2", max(r1, r2)), ("c2", max(c1, c2)))])
    return split_region(merges, sheet_id, r1, c1, r2, c2).unionByName(new)


def split_region(merges: DataFrame, sheet_id: str, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """merges without those that the rectangle meets."""
    meets = (F.col("sheet_id") == sheet_id) & (F.col("r1") <= max(r1, r2)) & (F.col("r2") >= min(r1, r2)) & (F.col("c1") <= max(c1, c2)) & (F.col("c2") >= min(c1, c2))
    return merges.where(~meets)


def _boxes(rects: pd.DataFrame) -> pd.DataFrame:
    """rects (r1, c1, r2, c2, ...) with the box (a, b, c, d) of each one's group, by a sweep down the rows.

    The boxes that reach the row lie apart in columns; a rectangle takes in those that it overlaps, as often as its box
    grows by that. Time follows the number of rectangles, not of pairs.
    """
    corners = rects[["r1", "c1", "r2", "c2"]].to_numpy()
    group, boxes = list(range(len(corners))), corners.tolist()

    def root(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    starts: list[int] = []
    open_boxes: list[int] = []
    for k in sorted(range(len(corners)), key=lambda k: (boxes[k][0], boxes[k][1])):
        row, own = boxes[k][0], boxes[k]
        grown = True
        while grown:
            grown = False
            j = bisect.bisect_right(starts, own[3]) - 1
            while j >= 0 and boxes[open_boxes[j]][3] >= own[1]:
                other = open_boxes.pop(j)
                del starts[j]
                # A box that ends above the row is passed for good.
                if boxes[other][2] >= row:
                    met = boxes[other]
                    own[0], own[1], own[2], own[3] = min(own[0], met[0]), min(own[1], met[1]), max(own[2], met[2]), max(own[3], met[3])
                    group[other] = k
                    grown = True
                j -= 1
        at = bisect.bisect_left(starts, own[1])
        starts.insert(at, own[1])
        open_boxes.insert(at, k)
    out = rects[["sheet_id", "r1", "c1", "r2", "c2"]].copy()
    found = [boxes[root(k)] for k in range(len(corners))]
    for i, name in enumerate("abcd"):
        out[name] = [x[i] for x in found]
    return out


def coalesce_rects(merges: DataFrame, block: int = 1024) -> DataFrame:
    """Bounding boxes of overlapping rectangles, until none overlap.

    Each round sweeps the rectangles of every tile of block by block cells, and replaces each one by the box of its
    groups in all its tiles; boxes only grow, so the rounds end. The plan is cut each round, and only a count reaches the
    driver.
    """
    names = ["r1", "c1", "r2", "c2"]
    rects = merges.select("sheet_id", *[F.col(n).cast("int").alias(n) for n in names]).distinct()
    schema = f"sheet_id {merges.schema['sheet_id'].dataType.simpleString()}, {', '.join(f'{n} int' for n in (*names, *'abcd'))}"
    while True:
        rects = _cut(rects)
        tiled = rects.withColumn("_br", F.explode(F.sequence(F.floor(F.col("r1") / block), F.floor(F.col("r2") / block))))
        tiled = tiled.withColumn("_bc", F.explode(F.sequence(F.floor(F.col("c1") / block), F.floor(F.col("c2") / block))))
        met = tiled.groupBy("sheet_id", "_br", "_bc").applyInPandas(_boxes, schema)
        boxes = _cut(met.groupBy("sheet_id", *names).agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("c").alias("c"), F.max("d").alias("d")))
        if boxes.where("a <> r1 or b <> c1 or c <> r2 or d <> c2").isEmpty():
            return rects
        rects = boxes.select("sheet_id", F.col("a").alias("r1"), F.col("b").alias("c1"), F.col("c").alias("r2"), F.col("d").alias("c2")).distinct()


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the folder that spark.checkpoint.dir names; in local mode one of our own if unset."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's folder in spark.checkpoint.dir; one of our own only if driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def used_bounds(cells: DataFrame) -> DataFrame:
    """(sheet_id, max_row, max_col) of cells with a value or formula."""
    used = cells.where(~((F.coalesce("value", F.lit("")) == "") & (F.coalesce("formula", F.lit("")) == "")))
    return used.groupBy("sheet_id").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def hide_collapsed(df: DataFrame, groups: DataFrame, order_col: str = "row", by: str = "sheet_id") -> DataFrame:
    """Rows but those that a collapsed group (sheet_id, start, end, collapsed) hides: after its first, to its end.

    Rows meet the ranges of groups by tiles, so a group of any number of rows is a few rows itself.
    """
    ranges = groups.where("collapsed and end > start").select(F.col(by).alias("sheet_id"), (F.col("start") + 1).alias("r1"), F.lit(0).alias("c1"), F.col("end").alias("r2"), F.lit(0).alias("c2"))
    places = df.select(df[by].alias("sheet_id"), df[order_col].alias("row"), F.lit(0).alias("col")).distinct()
    hidden = in_rectangles(places, ranges).select(F.col("sheet_id").alias("_s"), F.col("row").alias("_row")).distinct()
    return df.join(hidden, (df[by] == hidden["_s"]) & (df[order_col] == hidden["_row"]), "left_anti")


def add_group(groups: DataFrame, sheet_id: str, start: int, end: int, collapsed: bool = False) -> DataFrame:
    """groups with a new one, in place of those of its sheet that it overlaps."""
    kept = groups.where(~((F.col("sheet_id") == sheet_id) & (F.col("start") <= end) & (F.col("end") >= start)))
    new = groups.sparkSession.range(1).select(F.lit(sheet_id).alias("sheet_id"), F.lit(start).cast("int").alias("start"), F.lit(end).cast("int").alias("end"), F.lit(collapsed).alias("collapsed"))
    return kept.unionByName(new)


def _inside(rect: tuple[int, int, int, int]) -> Column:
    r1, c1, r2, c2 = rect
    return F.col("row").between(r1, r2) & F.col("col").between(c1, c2)


def _fill(cells: DataFrame, rect: tuple[int, int, int, int], axis: str) -> DataFrame:
    first, last = (rect[0], rect[2]) if axis == "row" else (rect[1], rect[3])
    source = cells.where(_inside(rect) & (F.col(axis) == first))
    copies = source.withColumn(axis, F.explode(F.sequence(F.lit(first + 1), F.lit(last)))) if last > first else source.limit(0)
    keys = ["sheet_id", "row", "col"]
    return cells.join(copies.select(*keys), keys, "left_anti").unionByName(copies.select(*cells.columns))


def fill_down(cells: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """The first row of the rectangle (r1, c1, r2, c2) copied into the rest, where it has a cell."""
    return _fill(cells, rect, "row")


def fill_right(cells: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    return _fill(cells, rect, "col")


def paste_block(cells: DataFrame, rect: tuple[int, int, int, int], r0: int, c0: int, cut: bool = False) -> DataFrame:
    """The rectangle's cells written at (r0, c0), blanks included; cut empties the source but where the target lies."""
    r1, c1, r2, c2 = rect
    target = (r0, c0, r0 + r2 - r1, c0 + c2 - c1)
    moved = cells.where(_inside(rect)).withColumn("row", F.col("row") + (r0 - r1)).withColumn("col", F.col("col") + (c0 - c1))
    kept = cells.where(~_inside(target))
    return (kept.where(~_inside(rect)) if cut else kept).unionByName(moved)


def duplicate_row(cells: DataFrame, row: int, to: int | None = None) -> DataFrame:
    """A copy of a row at `to` (below it by default), what lies there or after moved on."""
    to = row + 1 if to is None else to
    return insert_lines(cells, "row", to).unionByName(cells.where(F.col("row") == row).withColumn("row", F.lit(to).cast(cells.schema["row"].dataType)))


def numeric_runs(cells: DataFrame) -> DataFrame:
    """(sheet_id, col, top, bottom): runs of numeric cells down a column."""
    numeric = cells.where(~_blank(F.col("value")) & js_number(F.col("value")).isNotNull())
    return number_runs(numeric, ["sheet_id", "col"], "row", "top", "bottom")


def union_sheets(*sheets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sheets)
