"""Delimited and loose text as cells."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.sheet import _cut
from folioframe.plans.islands import number_within


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Cells of delimited files: tab-separated if a file's first line has a tab, else by commas. Rows may be ragged, and of any width.

    Every field is text; blank lines are skipped, as are empty fields without quotes; Spark's readers pass over empty
    files. The sheet is the file. Files of any size are read by many tasks, those with quotes too (`quoted_records`).
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("sheet_id"), place.alias("_i"), "value")
    kinds = lines.groupBy("sheet_id").agg(F.min_by(F.contains("value", F.lit("\t")), "_i").alias("_tab"), F.max(F.contains("value", F.lit('"'))).alias("_quoted"))
    kinds = _cut(kinds.withColumnRenamed("sheet_id", "_file"))
    plain = lines.join(kinds.where("not _quoted"), F.col("sheet_id") == F.col("_file")).where("value <> ''")
    values = F.when(F.col("_tab"), F.split("value", "\t")).otherwise(F.split("value", ","))
    plain = plain.select("sheet_id", F.col("_i.block").alias("_block"), F.col("_i.i").alias("_at"), F.transform(values, lambda x: F.nullif(x, F.lit(""))).alias("_v"))
    quoted = kinds.where("_quoted")
    return _rows_to_cells(plain if quoted.isEmpty() else plain.unionByName(quoted_records(spark, path, quoted)), F.col("_v"))


#: Names of files that a filter holds at most, so that others aren't read.
FEW_FILES = 10_000


#: What follows from a place at the start of a field, for either separator: whole fields, then an opening quote that
#: nothing closes. A quote within a field that doesn't begin with one is a character like any other.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*(?:"(?:[^"{0}][^{0}]*)?)|[^"{0}][^{0}]*)?'
_OPENS = [re.compile(rf'(?:{_FIELD}{{0}})*"[^"]*(?:""[^"]*)*\Z'.format(sep), re.S).match for sep in (",", "\t")]
#: The rest of a quoted field: up to its closing quote, and what follows that up to the separator.
_CLOSES = [re.compile(r'[^"]*(?:""[^"]*)*"(?:[^"{0}][^{0}]*)?(?={0}|\Z)'.format(sep), re.S).match for sep in (",", "\t")]


def _opens(line: str, tab: bool, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins a record, or, inside, goes on within such a field."""
    if '"' not in line:
        return inside
    if inside:
        closed = _CLOSES[tab](line)
        if closed is None:
            return True
        line = line[closed.end() + 1 :] if closed.end() < len(line) else ""
        if '"' not in line:
            return False
    return _OPENS[tab](line) is not None


def _walk_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of a split with its record, under all four assumptions: a comma or a tab separates, the split begins outside or inside quotes.

    state: whether the line begins inside quotes; record: the line of the split that its record begins with, null if that
    is in an earlier split.
    """
    names = ["sheet_id", "block", "at", "line", "state", "ends", "record"]
    cases = [(tab, inside) for tab in (False, True) for inside in (False, True)]
    here, now, record = None, [], []
    for batch in batches:
        out: list[list] = [[], [], []]
        for sheet, block, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (sheet, block) != here:
                here, now, record = (sheet, block), [inside for _, inside in cases], [None] * 4
            record = [r if inside else at for r, inside in zip(record, now, strict=True)]
            ends = [_opens(line, tab, inside) for (tab, _), inside in zip(cases, now, strict=True)]
            for column, values in zip(out, (now, ends, record), strict=True):
                column.append(values)
            now = ends
        kinds = (pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)


def _choose(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each split of a file, in order: which assumption holds, and the record that is open before it."""
    rows = blocks.sort_values("block")
    inside, last, chosen = False, (None, None), []
    for block, tab, ends, record in zip(rows["block"], rows["tab"], rows["ends"], rows["record"]):
        case = 2 * int(tab) + int(inside)
        chosen.append((rows["sheet_id"].iloc[0], block, case, *last))
        inside = bool(ends[case])
        if record[case] is not None and record[case] == record[case]:
            last = (block, int(record[case]))
    out = pd.DataFrame(chosen, columns=["sheet_id", "block", "case", "open_block", "open_at"])
    return out.astype({"open_block": "Int64", "open_at": "Int64"})


def quoted_records(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(sheet_id, _block, _at, _v): the fields of the records of files (_file, _tab) whose quoted fields may hold line ends.

    Every split is walked under each assumption on what it begins in, the ends of a file's splits are put together in
    order, which tells the assumption that holds for each, and only records of several lines are gathered. A quote that
    nothing closes makes the rest of its file one record, but for a line end at its very end.
    """
    names = [r["_file"] for r in files.select("_file").take(FEW_FILES + 1)]
    place = [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("sheet_id"), *place, F.col("value").alias("line"))
    # Files are passed over by their names, before they are read.
    lines = lines.where(F.col("sheet_id").isin(names)) if len(names) <= FEW_FILES else lines
    walked = lines.mapInArrow(_walk_lines, "sheet_id string, block long, at long, line string, state array<boolean>, ends array<boolean>, record array<long>")
    own = walked.join(files, F.col("sheet_id") == F.col("_file"))
    ends = own.groupBy("sheet_id", "block").agg(F.first("_tab").alias("tab"), F.max_by("ends", "at").alias("ends"), F.max_by("record", "at").alias("record"))
    chosen = ends.groupBy("sheet_id").applyInPandas(_choose, "sheet_id string, block long, case int, open_block long, open_at long")
    met = own.join(chosen, ["sheet_id", "block"])
    pick = lambda c: F.element_at(c, F.col("case") + 1)
    placed = met.select(
        "sheet_id", "_tab", F.when(pick("record").isNull(), F.col("open_block")).otherwise(F.col("block")).alias("_block"), F.coalesce(pick("record"), "open_at").alias("_at"),
        F.struct("block", "at").alias("i"), "line", (pick("state") | pick("ends")).alias("long"),
    )
    texts = placed.where("not long").select("sheet_id", "_tab", "_block", "_at", F.col("line").alias("text"))
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    texts = texts.unionByName(placed.where("long").groupBy("sheet_id", "_tab", "_block", "_at").agg(gathered.alias("text")))
    parsed = texts.mapInArrow(_parse_quoted, "sheet_id string, _block long, _at long, part int, _v array<string>")
    # A lone carriage return ends a record, too; those of one text keep their order.
    return parsed.select("sheet_id", "_block", (F.col("_at") * F.lit(1 << 20) + F.col("part")).cast("decimal(38,0)").alias("_at"), "_v")


def _parse_quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of texts (sheet_id, tab, block, at, text): quotes are doubled inside quotes, an empty field without quotes is null."""
    csv.field_size_limit(1 << 31 - 1)
    schema = pa.schema([("sheet_id", pa.string()), ("_block", pa.int64()), ("_at", pa.int64()), ("part", pa.int32()), ("_v", pa.list_(pa.string()))])
    for batch in batches:
        rows = []
        for name, tab, block, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            records = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if tab else ",", quoting=csv.QUOTE_NOTNULL)
            rows += [{"sheet_id": name, "_block": block, "_at": at, "part": i, "_v": r} for i, r in enumerate(r for r in records if r)]
        yield pa.RecordBatch.from_pylist(rows, schema)


def _rows_to_cells(rows: DataFrame, values: Column) -> DataFrame:
    """Cells of rows (sheet_id, _block, _at, values); rows are numbered within their sheet in the order of block and place."""
    numbered = number_within(rows, ["sheet_id"], "_block", "_at", "row").withColumn("row", F.col("row").cast("int"))
    cells = numbered.select("sheet_id", "row", F.posexplode(values).alias("col", "value")).where("value is not null")
    return cells.withColumn("formula", F.lit(None).cast("string"))


def import_text(df: DataFrame, id_col: str, text_col: str, rule: str = "txt") -> DataFrame:
    """(id, row, col, value): lines split by rule csv (commas, fields trimmed, empty lines dropped), txt (tabs, commas, white space) or web (tabs, commas)."""
    lines = F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "\n")
    if rule == "csv":
        lines = F.filter(lines, lambda x: F.trim(x) != "")
    rows = df.select(F.col(id_col), F.posexplode(lines).alias("row", "line"))
    parts = F.split("line", {"csv": ",", "txt": r"\t|,|\s+", "web": r"\t|,"}[rule])
    parts = F.transform(parts, lambda x: F.trim(x)) if rule == "csv" else parts
    return rows.select(id_col, "row", F.posexplode(parts).alias("col", "value"))


def tsv_cells(pasted: DataFrame, r0: int, c0: int) -> DataFrame:
    """Cells of (sheet_id, tsv) at an anchor: one trailing line end dropped, a field that begins with = is a formula."""
    text = F.regexp_replace(F.regexp_replace("tsv", "\r\n?", "\n"), r"\n\z", "")
    lines = pasted.select("sheet_id", F.posexplode(F.split(text, "\n")).alias("r", "line"))
    cells = lines.select("sheet_id", (F.col("r") + r0).alias("row"), F.posexplode(F.split("line", "\t")).alias("c", "v"))
    formula = F.when(F.col("v").startswith("="), F.col("v"))
    return cells.select("sheet_id", "row", (F.col("c") + c0).alias("col"), F.when(formula.isNull(), F.col("v")).otherwise("").alias("value"), formula.alias("formula"))


def paste_tsv(cells: DataFrame, pasted: DataFrame, r0: int, c0: int) -> DataFrame:
    """cells with the pasted ones on top."""
    new = tsv_cells(pasted, r0, c0)
    keys = ["sheet_id", "row", "col"]
    return cells.select(*keys, "value", "formula").join(new, keys, "left_anti").unionByName(new)
