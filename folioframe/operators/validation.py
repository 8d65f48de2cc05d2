"""Value lists of cells, sets of ranges, differences of tables, and recent items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.scalar import MAX_COLUMN, cell_ref, parse_range
from folioframe.operators.sheet import _cut
from folioframe.plans.islands import in_rectangles, spans

_REF = r"^\$?[A-Za-z]{1,3}\$?[0-9]+(:\$?[A-Za-z]{1,3}\$?[0-9]+)?$"
#: Keys of differing rows that are broadcast at most.
FEW_KEYS = 200_000
#: Rows of a sheet.
MAX_ROW = 1_048_576
#: A list that takes so many bytes or more, its items trimmed and joined, can't be a rule.
LONGEST_LIST = 255


def literal_list(formula: Column) -> Column:
    """Items of a list rule: `=` and a pair of quotes stripped; a reference, unless quoted, is no list (null)."""
    s = F.trim(F.regexp_replace(F.trim(formula), "^=", ""))
    quoted = s.rlike('(?s)^".*"$') & (F.length(s) >= 2)
    inner = F.trim(F.when(quoted, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s))
    items = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((quoted | ~(s.contains("!") | s.rlike(_REF))) & (inner != "") & (inner != '""'), items)


def expand_ranges(rules: DataFrame, sqref: str = "sqref", max_rows: int | None = None, max_cols: int | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """rules with row and col, 0-based, of every cell of their space-separated references, clipped to the grid first.

    The grid is a whole sheet, or max_rows by max_cols, or that of each sheet in bounds (sheet_id, max_row, max_col), the
    last row and column in use; a sheet that bounds lacks has no cells.
    """
    r = rules
    if bounds is not None:
        own = bounds.select("sheet_id", (F.col("max_row") + 1).alias("_rows"), (F.col("max_col") + 1).alias("_cols"))
        r = r.join(own, "sheet_id")
    else:
        r = r.withColumn("_rows", F.lit(MAX_ROW)).withColumn("_cols", F.lit(MAX_COLUMN))
    r = r.withColumn("_rows", F.least("_rows", F.lit(max_rows or MAX_ROW))).withColumn("_cols", F.least("_cols", F.lit(max_cols or MAX_COLUMN)))
    parts = F.filter(F.split(F.trim(F.col(sqref)), r"\s+"), lambda x: x != "")
    r = r.select("*", F.explode(parts).alias("_part")).withColumn("_r", parse_range(F.col("_part")))
    r = r.where("_r.c1 is not null").where((F.col("_r.r1") <= F.col("_rows")) & (F.col("_r.c1") <= F.col("_cols")))
    rows = r.withColumn("row", F.explode(F.sequence(F.col("_r.r1") - 1, F.least(F.col("_r.r2"), F.col("_rows")) - 1)))
    return rows.withColumn("col", F.explode(F.sequence(F.col("_r.c1") - 1, F.least(F.col("_r.c2"), F.col("_cols")) - 1))).drop("_part", "_r", "_rows", "_cols")


def apply_validation(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells with the list of the rule (sheet_id, r1, c1, r2, c2, valid) that holds them; of several the last by valid. A null list clears."""
    held = in_rectangles(cells.select("sheet_id", "row", "col"), rules.select("sheet_id", "r1", "c1", "r2", "c2", F.struct(F.col("valid")).alias("_rule")))
    one = held.groupBy("sheet_id", "row", "col").agg(F.max("_rule").alias("_rule"))
    keep = F.col("valid") if "valid" in cells.columns else F.lit(None).cast("string")
    joined = cells.join(one, ["sheet_id", "row", "col"], "left")
    return joined.withColumn("valid", F.when(F.col("_rule").isNotNull(), F.col("_rule.valid")).otherwise(keep)).drop("_rule")


def validation_violations(cells: DataFrame) -> DataFrame:
    """Cells whose value isn't in their list; blanks and cells without a list pass."""
    items = F.filter(F.transform(F.split("valid", ","), lambda x: F.trim(x)), lambda x: x != "")
    return cells.where((F.coalesce("valid", F.lit("")) != "") & (F.trim(F.coalesce("value", F.lit(""))) != "") & ~F.array_contains(items, F.trim("value")))


def _list_bytes(valid: Column) -> Column:
    items = F.filter(F.transform(F.split(valid, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.octet_length(F.array_join(items, ","))


def long_lists(cells: DataFrame) -> DataFrame:
    """(sheet_id, valid, n_bytes, n_cells): the lists that compress_runs leaves out, being too long for a rule."""
    size = _list_bytes(F.col("valid"))
    return cells.where(size >= LONGEST_LIST).groupBy("sheet_id", "valid").agg(F.first(size).alias("n_bytes"), F.count("*").alias("n_cells"))


def compress_runs(cells: DataFrame) -> DataFrame:
    """(sheet_id, valid, row, c1, c2, sqref): the longest horizontal runs of cells with the same list; long_lists tells which are left out."""
    listed = cells.where((F.coalesce("valid", F.lit("")) != "") & (_list_bytes(F.col("valid")) < LONGEST_LIST))
    runs = spans(listed, ["sheet_id", "valid", "row"], ["col"], F.col("before_col") + 1 == F.col("col"))
    runs = runs.select("sheet_id", "valid", "row", F.col("col").alias("c1"), F.col("last_col").alias("c2"))
    first, last = cell_ref(F.col("c1") + 1, F.col("row") + 1), cell_ref(F.col("c2") + 1, F.col("row") + 1)
    return runs.withColumn("sqref", F.when(F.col("c1") == F.col("c2"), first).otherwise(F.concat(first, F.lit(":"), last)))


def squash_cells(cells: DataFrame) -> DataFrame:
    """(sheet_id, valid, n, c1, r1, c2, r2, sqref): cells with the same list, walked by column and row, as corners of ranges.

    A range ends only where the next cell is in the column of the last one and leaves a gap there, so that columns next
    to each other run on in one range, from the first cell to the last. n numbers the ranges.
    """
    listed = cells.where(F.coalesce("valid", F.lit("")) != "")
    gap = (F.col("before_col") == F.col("col")) & (F.col("row") - F.col("before_row") > 1)
    runs = spans(listed, ["sheet_id", "valid"], ["col", "row"], ~gap)
    corner = lambda f, x: f(F.col(x), F.col(f"last_{x}"))
    c1, r1, c2, r2 = corner(F.least, "col"), corner(F.least, "row"), corner(F.greatest, "col"), corner(F.greatest, "row")
    first, last = cell_ref(F.col("col") + 1, F.col("row") + 1), cell_ref(F.col("last_col") + 1, F.col("last_row") + 1)
    one = (F.col("col") == F.col("last_col")) & (F.col("row") == F.col("last_row"))
    sqref = F.when(one, first).otherwise(F.concat(first, F.lit(":"), last))
    return runs.select("sheet_id", "valid", "n", c1.alias("c1"), r1.alias("r1"), c2.alias("c2"), r2.alias("r2"), sqref.alias("sqref"))


#: Properties that say nothing beyond a sheet's defaults.
DEFAULTS = {"color": ("#000000", "#000000ff"), "fontSize": ("11", "11.0"), "fontFamily": ("Calibri",), "bold": ("false",), "italic": ("false",)}


def normalise_defaults(df: DataFrame, defaults: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """df with blank and default properties null."""
    for c, values in (DEFAULTS if defaults is None else defaults).items():
        if c in df.columns:
            df = df.withColumn(c, F.when(~F.col(c).cast("string").isin(*values) & (F.trim(F.col(c).cast("string")) != ""), F.col(c)))
    return df


def _row_digest(columns: dict[str, str]) -> Column:
    """128 bits of a row's columns (name: type), nulls told apart; columns of a nested type count as they are and as text."""
    flags = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]) if columns else F.lit("")
    parts = [p for c, kind in columns.items() for p in ((F.col(c), F.col(c).cast("string")) if kind.startswith(("array", "struct")) else (F.col(c),))]
    return F.struct(F.xxhash64(flags, *parts).alias("a"), F.xxhash64(F.lit(1), *parts, flags).alias("b"))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], normalise=None) -> DataFrame:
    """(keys, status, columns): keys that one side lacks (left or right only), or whose other columns differ, null-safe.

    Keys and digests of rows are compared first; whole rows are fetched for keys whose digests differ alone.
    """
    if normalise:
        a, b = normalise(a), normalise(b)
    others = [c for c in a.columns if c not in keys]
    own = {c: kind for c, kind in a.dtypes if c in others}
    l, r = a.select(*keys, _row_digest(own).alias("_l")), b.select(*keys, _row_digest({c: dict(b.dtypes)[c] for c in others}).alias("_r"))
    j = _cut(l.join(r, keys, "full_outer").where("_l is null or _r is null or _l <> _r"))
    alone = j.where("_l is null or _r is null").select(*keys, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("status"), F.lit("").alias("columns"))
    some = _cut(j.where("_l is not null and _r is not null").select(*keys).distinct())
    some = F.broadcast(some) if some.count() <= FEW_KEYS else some
    l, r = (df.join(some, keys, "left_semi").select(*keys, F.struct(*others).alias(name)) for df, name in ((a, "_l"), (b, "_r")))
    differing = F.array_compact(F.array(*[F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in others]))
    met = l.join(r, keys).select(*keys, differing.alias("_d")).where(F.size("_d") > 0)
    return alone.unionByName(met.select(*keys, F.lit("differs").alias("status"), F.array_join("_d", ",").alias("columns")))


def diff_totals(a: DataFrame, b: DataFrame, keys: list[str], normalise=None) -> DataFrame:
    d = table_diff(a, b, keys, normalise).agg(F.count("*").alias("n_diffs"))
    return a.agg(F.count("*").alias("n_left")).join(b.agg(F.count("*").alias("n_right"))).join(d)


def recent_k(df: DataFrame, owner: str, item: str, ts: str, k: int = 5) -> DataFrame:
    """(owner, item, ts, rank): the k latest distinct items of each owner, newest first, ties by item."""
    last = df.groupBy(owner, item).agg(F.max(ts).alias(ts))
    w = Window.partitionBy(owner).orderBy(F.desc(ts), item)
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def absolute_paths(df: DataFrame, item: str) -> DataFrame:
    """Rows whose item is a path from a root: one that begins with a slash, or with a drive."""
    return df.where(F.col(item).rlike(r"^(/|[A-Za-z]:[\\/])"))
