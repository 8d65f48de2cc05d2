"""Plan shapes that several operators share: gaps and islands, and range joins by blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """df with the number of the island a row is in: a running count, per group, of rows where starts is true."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def spans(df: DataFrame, by: list[str], order: list[str], follows: Column) -> DataFrame:
    """(by, n, order, last_<order>): the runs of each group, numbered in order, from their first row to their last.

    follows says, by columns before_<order>, whether a row goes on with the run of the row before; equal rows do. Rows
    are sorted once and only first rows of runs go on, so a task keeps its sorted rows and no tables of rows and runs.
    """
    # The last key comes first, as it differs most.
    w = Window.partitionBy(*reversed(by)).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, ends = ([f(c).over(v).alias(f"{name}_{c}") for c in order] for f, v, name in ((F.lag, w, "before"), (F.last, whole, "end")))
    placed = df.select(*by, *order, F.row_number().over(w).alias("_k"), *before, *ends)
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"before_{c}"))
    heads = placed.where((F.col("_k") == 1) | ~(same | F.coalesce(follows, F.lit(False))))
    # A run ends before the next one starts, the last with its group.
    last = [F.when(F.lead("_k").over(w).isNull(), F.col(f"end_{c}")).otherwise(F.lead(f"before_{c}").over(w)).alias(f"last_{c}") for c in order]
    return heads.select(*by, F.row_number().over(w).alias("n"), *order, *last)


def changes(columns: list[str], by: list[str], order: list[str]) -> Column:
    """True where any of the columns differs from the row before in the group, and on its first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for c in columns:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return ~same | F.row_number().over(w).eqNullSafe(1)


#: Whole numbers to a block, where islands of numbers are found block by block.
_RUN_BLOCK = 65_536


def number_runs(df: DataFrame, by: list[str], at: str, first: str, last: str, block: int = _RUN_BLOCK) -> DataFrame:
    """(by, first, last): the runs of neighbouring whole numbers in column at, per group.

    A group of any size spreads over its blocks of numbers: runs are found within blocks, and only those that reach
    the end of a block, two a block at most, meet again to be joined.
    """
    place = [*by, "_block"]
    own = df.select(*by, F.col(at).alias("_at")).distinct().withColumn("_block", F.floor(F.col("_at") / block))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("_at"))
    runs = own.withColumn("_g", F.col("_at") - rank).groupBy(*place, "_g").agg(F.min("_at").alias("_a"), F.max("_at").alias("_b"))
    edge = (F.col("_a") == F.col("_block") * block) | (F.col("_b") == (F.col("_block") + 1) * block - 1)
    order = Window.partitionBy(*by).orderBy("_a")
    starts = F.coalesce(F.col("_a") != F.lag("_b").over(order) + 1, F.lit(True))
    joined = islands(runs.where(edge).withColumn("_new", starts), by, ["_a"], F.col("_new"), "_n").groupBy(*by, "_n").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    kind = df.schema[at].dataType
    every = runs.where(~edge).select(*by, "_a", "_b").unionByName(joined.select(*by, "_a", "_b"))
    return every.select(*by, F.col("_a").cast(kind).alias(first), F.col("_b").cast(kind).alias(last))


def number_within(df: DataFrame, by: list[str], block: str, order: str, name: str) -> DataFrame:
    """df with its 0-based place in its group by (block, order): its place in its block, and the sizes of the blocks before.

    A group of any size spreads over its blocks, of which only the sizes meet.
    """
    sizes = df.groupBy(*by, block).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in (*by, block)], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, block).orderBy(order)) - 1
    met = df.withColumn("_inside", inside).join(sizes, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, block)])
    return met.withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", *[f"_{c}" for c in (*by, block)])


#: A tile's side is one of these, times eight each; a rectangle meets nine tiles of its size a side at most.
_TILE, _LEVELS, _SPAN = 64, 6, 8


def _level(length: Column) -> Column:
    """The least level whose tiles a length meets _SPAN + 1 of at most."""
    out = F.lit(_LEVELS - 1)
    for level in reversed(range(_LEVELS - 1)):
        out = F.when(length <= _TILE * 8**level * _SPAN, F.lit(level)).otherwise(out)
    return out


def _tile(value: Column, level: Column) -> Column:
    return F.floor(value / (F.lit(_TILE) * F.pow(F.lit(8), level))).cast("long")


def tiles(rects: DataFrame) -> DataFrame:
    """rects (r1, c1, r2, c2, ...), once for each tile that they meet: _lr, _lc the level of its height and width, _br, _bc its place."""
    sized = rects.withColumn("_lr", _level(F.col("r2") - F.col("r1") + 1)).withColumn("_lc", _level(F.col("c2") - F.col("c1") + 1))
    out = sized.withColumn("_br", F.explode(F.sequence(_tile(F.col("r1"), F.col("_lr")), _tile(F.col("r2"), F.col("_lr")))))
    return out.withColumn("_bc", F.explode(F.sequence(_tile(F.col("c1"), F.col("_lc")), _tile(F.col("c2"), F.col("_lc")))))


def in_rectangles(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """Cells (sheet_id, row, col, ...) joined to the rectangles (sheet_id, r1, c1, r2, c2, ...) that hold them.

    An equi-join by sheet and tile. A rectangle's tiles are of a size that fits its height and its width, so it meets 81
    at most, a whole column of a sheet nine; a cell is in one tile of each pair of sizes that rectangles use, which are
    looked up first, so each pair of cell and rectangle is found once.
    """
    cut = tiles(rects)
    # At most _LEVELS squared rows.
    levels = rects.select(_level(F.col("r2") - F.col("r1") + 1).alias("_lr"), _level(F.col("c2") - F.col("c1") + 1).alias("_lc")).distinct()
    used = sorted(tuple(r) for r in levels.collect()) or [(0, 0)]
    sizes = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in used])
    tiled = cells.withColumn("_s", F.explode(sizes)).withColumn("_lr", F.col("_s.r")).withColumn("_lc", F.col("_s.c")).drop("_s")
    tiled = tiled.withColumn("_br", _tile(F.col("row"), F.col("_lr"))).withColumn("_bc", _tile(F.col("col"), F.col("_lc")))
    found = tiled.join(cut, ["sheet_id", "_lr", "_lc", "_br", "_bc"])
    return found.where(F.col("row").between(F.col("r1"), F.col("r2")) & F.col("col").between(F.col("c1"), F.col("c2"))).drop("_lr", "_lc", "_br", "_bc")


#: A block's side is two to the power of _FOLD times its level; places are whole numbers of 32 bits.
_FOLD, _FOLDS = 3, 11


def _fold_level(length: Column) -> Column:
    """The highest level whose side isn't longer than a length, 0 at least."""
    return sum(((length >= 2 ** (_FOLD * level)).cast("int") for level in range(1, _FOLDS)), F.lit(0))


def _blocks(first: Column, last: Column, top: int) -> Column:
    """Blocks (level, at) that make up first to last, none twice: of each level those before and behind the blocks of the next."""
    up = lambda level: -F.shiftright(-first.cast("long"), _FOLD * level)
    down = lambda level: F.shiftright(last.cast("long") + 1, _FOLD * level)
    between = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def own(level: int) -> Column:
        a, b, above, below = up(level), down(level), up(level + 1), down(level + 1)
        outer = F.concat(between(a, above * 2**_FOLD), between(below * 2**_FOLD, b))
        return F.transform(between(a, b) if level == top else F.when(above < below, outer).otherwise(between(a, b)), lambda at: F.struct(F.lit(level).alias("level"), at.alias("at")))

    return F.concat(*map(own, range(top + 1)))


def sums_in_rectangles(numbers: DataFrame, rects: DataFrame, by: str) -> DataFrame:
    """(by, s, lo, hi, n): sum, least, greatest and count of the numbers (sheet_id, row, col, x) in rectangles (by, sheet_id, r1, c1, r2, c2).

    A rectangle is made up of blocks whose sides are powers of eight, so many as go by the logarithms of its height and
    width; each block is summed once. A number is in one block of each pair of sizes, so it never meets each rectangle that holds it.
    """
    height, width = F.col("r2") - F.col("r1") + 1, F.col("c2") - F.col("c1") + 1
    edges = [F.min("r1").alias("r1"), F.max("r2").alias("r2"), F.min("c1").alias("c1"), F.max("c2").alias("c2")]
    # At most a row for each pair of levels.
    sizes = rects.where((height > 0) & (width > 0)).groupBy(_fold_level(height).alias("h"), _fold_level(width).alias("w")).agg(*edges).collect()
    used = sorted({(h, w) for z in sizes for h in range(z.h + 1) for w in range(z.w + 1)}) or [(0, 0)]
    held = numbers
    if sizes:
        held = numbers.where(F.col("row").between(min(z.r1 for z in sizes), max(z.r2 for z in sizes)) & F.col("col").between(min(z.c1 for z in sizes), max(z.c2 for z in sizes)))
    at = lambda place, level: F.shiftright(F.col(place).cast("long"), _FOLD * level).alias(f"b_{place}")
    levels = F.array(*[F.struct(F.lit(h).alias("lr"), F.lit(w).alias("lc"), at("row", h), at("col", w)) for h, w in used])
    key = ["sheet_id", "lr", "lc", "b_row", "b_col"]
    blocks = held.select("sheet_id", "x", F.explode(levels).alias("_b")).groupBy("sheet_id", *(F.col(f"_b.{c}").alias(c) for c in key[1:]))
    blocks = blocks.agg(F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    cut = rects.select(by, "sheet_id", "c1", "c2", F.explode(_blocks(F.col("r1"), F.col("r2"), max(h for h, _ in used))).alias("_r"))
    cut = cut.select(by, "sheet_id", "_r", F.explode(_blocks(F.col("c1"), F.col("c2"), max(w for _, w in used))).alias("_c"))
    cut = cut.select(by, "sheet_id", F.col("_r.level").alias("lr"), F.col("_c.level").alias("lc"), F.col("_r.at").alias("b_row"), F.col("_c.at").alias("b_col"))
    # Spark takes them for as few as the rectangles and would broadcast them.
    met = cut.hint("merge").join(blocks, key)
    return met.groupBy(by).agg(F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
