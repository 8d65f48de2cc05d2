"""Tables and sheets: cells from and to wide tables, row and column views, copies as text, and sets of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.sheet import number_rows


def table_to_cells(df: DataFrame, order_col: str, sheet_id: str = "Sheet1", columns: list[str] | None = None, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Cells of a table at a start cell: its header first, then its rows by order_col, values as text; null has no cell."""
    columns = columns or df.columns
    place = number_rows(df.orderBy(order_col).select(*[F.col(c).cast("string").alias(c) for c in columns]), "_n")
    at = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(start[1] + i))])
    body = place.unpivot("_n", columns, "_c", "value").where("value is not null").select((F.col("_n") + 1 + start[0]).cast("int").alias("row"), at[F.col("_c")].alias("col"), "value")
    names = F.array(*[F.struct(F.lit(start[1] + i).alias("col"), F.lit(c).alias("value")) for i, c in enumerate(columns)])
    head = df.sparkSession.range(1).select(F.inline(names)).select(F.lit(start[0]).alias("row"), "col", "value")
    return body.unionByName(head).select(F.lit(sheet_id).alias("sheet_id"), "row", "col", "value", F.lit(None).cast("string").alias("formula"))


def cells_to_table(cells: DataFrame, columns: list[str], start: tuple[int, int] = (0, 0), header: bool = True) -> DataFrame:
    """(sheet_id, row, columns): a row per sheet row, the header row aside."""
    first = start[0] + int(header)
    body = cells.where((F.col("row") >= first) & F.col("col").between(start[1], start[1] + len(columns) - 1))
    values = [F.max(F.when(F.col("col") == start[1] + i, F.col("value"))).alias(c) for i, c in enumerate(columns)]
    return body.groupBy("sheet_id", "row").agg(*values)


def _ordered(cells: DataFrame, key: str, other: str) -> DataFrame:
    """(sheet_id, key, values): values along `other`, gaps empty, trailing blanks trimmed; keys without a value up to the last are empty."""
    filled = cells.where("value <> ''")
    pairs = F.sort_array(F.collect_list(F.struct(F.col(other).alias("at"), "value")))
    found = filled.groupBy("sheet_id", key).agg(pairs.alias("_p"))

    def piece(x: Column, i: Column) -> Column:
        """A value behind the gap before it; of several at one place the last, the greatest."""
        before, after = F.get("_p", i - 1)["at"], F.get("_p", i + 1)["at"]
        gap = F.array_repeat(F.lit(""), (x["at"] - F.coalesce(before, F.lit(-1)) - 1).cast("int"))
        own = F.when(after.eqNullSafe(x["at"]), F.array().cast("array<string>")).otherwise(F.array(x["value"]))
        return F.when(before.eqNullSafe(x["at"]), own).otherwise(F.concat(gap, own))

    rows = found.select("sheet_id", key, F.flatten(F.transform("_p", piece)).alias("values"))
    every = filled.groupBy("sheet_id").agg(F.max(key).alias("_top")).select("sheet_id", F.explode(F.sequence(F.lit(0), "_top")).alias(key))
    return every.join(rows, ["sheet_id", key], "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def rows_view(cells: DataFrame) -> DataFrame:
    return _ordered(cells, "row", "col")


def cols_view(cells: DataFrame) -> DataFrame:
    return _ordered(cells, "col", "row")


def to_tsv(cells: DataFrame, rect: tuple[int, int, int, int]) -> DataFrame:
    """(sheet_id, row, line) of the rectangle (r1, c1, r2, c2), tab-separated, missing cells empty."""
    r1, c1, r2, c2 = rect
    inside = cells.where(F.col("row").between(r1, r2) & F.col("col").between(c1, c2))
    rows = inside.groupBy("sheet_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("value")))).alias("_m"))
    grid = cells.select("sheet_id").distinct().select("sheet_id", F.explode(F.sequence(F.lit(r1), F.lit(r2))).alias("row"))
    cols = F.sequence(F.lit(c1), F.lit(c2))
    line = F.array_join(F.transform(cols, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(""))), "\t")
    return grid.join(rows, ["sheet_id", "row"], "left").select("sheet_id", "row", line.alias("line"))


def duplicate_sheet(cells: DataFrame, sheet_id: str, copy_id: str) -> DataFrame:
    return cells.unionByName(cells.where(F.col("sheet_id") == sheet_id).withColumn("sheet_id", F.lit(copy_id)))


def delete_sheet(cells: DataFrame, sheet_id: str) -> DataFrame:
    """cells without a sheet; the last one left isn't deleted."""
    others = cells.where(F.col("sheet_id") != sheet_id)
    return cells if others.isEmpty() else others


def rename_sheet(cells: DataFrame, sheet_id: str, name: str) -> DataFrame:
    return cells.withColumn("sheet_id", F.when(F.col("sheet_id") == sheet_id, name).otherwise(F.col("sheet_id")))


def list_sheets(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet_id").agg(F.count("*").alias("n_cells"))
