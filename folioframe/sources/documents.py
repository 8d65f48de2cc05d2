"""Document files: routing, document JSON, and distributed ingest of office archives."""

from __future__ import annotations

import functools
import io
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.sheet import shared_folder

#: File extensions of each family and of each view.
FAMILIES = {"docx": ("docx",), "doc": ("doc",), "xlsx": ("xlsx",), "xls": ("xls",), "pptx": ("pptx",), "ppt": ("ppt",), "csv": ("csv",), "markdown": ("md", "markdown"), "text": ("txt",), "html": ("html", "htm")}
VIEWS = {
    "spreadsheet": ("xlsx", "xls", "csv"), "slide": ("pptx", "ppt", "ppsx", "pps", "potx", "pot", "pptm", "ppsm"),
    "markdown": ("md", "markdown", "mdx"), "html": ("html", "htm"), "pdf": ("pdf",),
}
ZIP_HEAD = "504B0304"


def route_files(df: DataFrame, path: str, head: str | None = None) -> DataFrame:
    """df with ext, family and view of a path; a .doc whose first bytes (column head) are a zip's is of the docx family.

    An unknown extension has a null family.
    """
    name = F.regexp_extract(F.regexp_replace(F.col(path), r"[?#].*$", ""), r"[^/\\]*$", 0)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))

    def pick(table: dict[str, tuple[str, ...]]) -> Column:
        found = None
        for kind, exts in table.items():
            found = F.when(ext.isin(*exts), kind) if found is None else found.when(ext.isin(*exts), kind)
        return found

    family = pick(FAMILIES)
    if head:
        family = F.when((ext == "doc") & (F.hex(F.substring(F.col(head), 1, 4)) == ZIP_HEAD), "docx").otherwise(family)
    return df.select("*", ext.alias("ext"), family.alias("family"), F.coalesce(pick(VIEWS), F.lit("document")).alias("view"))


def _has(m: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit("")) != ""


def parse_doc_json(df: DataFrame, id_col: str, json_col: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, runs) of document JSON: a block's and an inline's kind follow from the first key of theirs that is present."""
    doc = F.from_json(json_col, "blocks array<map<string,string>>")
    b = df.select(F.col(id_col).alias("doc_id"), F.posexplode(doc["blocks"]).alias("block_idx", "m")).where("m is not null")
    m = F.col("m")
    get = lambda key: F.try_element_at(m, F.lit(key))
    kind = (
        F.when(get("level").isNotNull(), "heading").when(_has(m, "items"), "list").when(_has(m, "rows"), "table").when(_has(m, "code"), "code").when(_has(m, "formula"), "math")
        .when(_has(m, "src") & ~_has(m, "kind"), "image").when(_has(m, "kind"), "raw").when(get("restart").isNotNull(), "page_break").when(get("type") == "textbox", "textbox").otherwise("paragraph")
    )
    b = b.withColumn("block_type", kind)
    inlines = F.from_json(get("inline"), "array<map<string,string>>")
    r = b.select("doc_id", "block_idx", F.posexplode(inlines).alias("run_idx", "n")).where("n is not null")
    n = F.col("n")
    of = lambda key: F.try_element_at(n, F.lit(key))
    run_kind = F.when(_has(n, "track"), "track").when(_has(n, "url"), "link").when(_has(n, "src"), "image").when(_has(n, "kind"), "raw").when(_has(n, "formula") | _has(n, "omml"), "math").otherwise("text")
    runs = r.select(
        "doc_id", "block_idx", "run_idx", run_kind.alias("kind"), F.coalesce(of("content"), of("text"), of("formula"), F.lit("")).alias("content"), of("track").alias("track"),
        of("author").alias("author"), of("url").alias("url"), of("commentId").alias("comment_id"),
    )
    text = runs.groupBy("doc_id", "block_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_idx", "content"))), lambda x: x["content"]), "").alias("_t"))
    blocks = b.join(text, ["doc_id", "block_idx"], "left").select(
        "doc_id", "block_idx", "block_type", get("level").try_cast("int").alias("level"), get("style").alias("style"), F.coalesce("_t", get("code"), get("formula"), get("text"), F.lit("")).alias("text")
    )
    return blocks, runs


def read_doc_json(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, runs) of files of one document each, whose path is its id; with a key, of files of a document a line, whose id is what the key holds."""
    if key is None:
        files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    else:
        files = spark.read.text(path).select(F.from_json("value", f"`{key}` string")[key].alias("doc_id"), "value")
    return parse_doc_json(files, "doc_id", "value")


_PART_COLUMNS = ("doc_id", "part", "seq", "row", "col", "kind", "level", "value", "formula", "message")
_PART_SCHEMA = "doc_id string, part string, seq int, row int, col int, kind string, level int, value string, formula string, message string"


def ingest_ooxml(spark: SparkSession, path: str, max_bytes: int | None = None) -> dict[str, DataFrame]:
    """blocks, notes, comments, cells, merges, slides and warnings of office archives under a path; see ingest_archives.

    Files of more than max_bytes, if it is given, become a warning.
    """
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > max_bytes) if max_bytes is not None else files.limit(0)
    out = ingest_archives(files if max_bytes is None else files.where(F.col("length") <= max_bytes))
    out["warnings"] = out["warnings"].unionByName(large.select(F.col("path").alias("doc_id"), F.lit("error").alias("level"), F.lit("file too large").alias("message")))
    return out


#: Rows of an archive that leave its task together.
BATCH_ROWS = 10_000


def ingest_archives(files: DataFrame) -> dict[str, DataFrame]:
    """What office archives (path, content) hold: blocks, notes, comments, table_cells, cells, formats, validations, merges, slides, warnings.

    Each archive is parsed once, in a Python task, part by part as a stream of elements; the rows are written to the shared
    folder by kind, and each result reads its own. One that can't be read to its end, whatever is wrong with it, or that
    declares entities, becomes a warning alone.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = ("seq", "row", "col", "level")
        schema = pa.schema([(c, pa.int32() if c in whole else pa.string()) for c in _PART_COLUMNS])
        for batch in batches:
            for name, family, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = _READERS[family](zipfile.ZipFile(io.BytesIO(content)))
                    while some := list(itertools.islice(rows, BATCH_ROWS)):
                        yield pa.RecordBatch.from_pylist([{"doc_id": name, **r} for r in some], schema)
                except Exception as error:  # noqa: BLE001  (whatever a damaged archive raises)
                    yield pa.RecordBatch.from_pylist([{"doc_id": name, "part": "warning", "message": f"{type(error).__name__}: {error}"}], schema)

    spark = files.sparkSession
    files = route_files(files, "path", "content").where(F.col("family").isin(*_READERS)).select("path", "family", "content").repartition("path")
    out = f"{shared_folder(spark)}/folio-parts-{uuid.uuid4().hex}"
    files.mapInArrow(parse, _PART_SCHEMA).write.partitionBy("part").parquet(out)
    parts = spark.read.schema(_PART_SCHEMA).parquet(out)
    warnings = parts.where(F.col("part") == "warning").select("doc_id", F.lit("error").alias("level"), "message")
    damaged = warnings.select("doc_id").distinct()
    # Rows that a damaged archive gave before its damage don't count.
    drop = not damaged.isEmpty()
    of = lambda kind: parts.where(F.col("part") == kind).join(damaged, "doc_id", "left_anti") if drop else parts.where(F.col("part") == kind)
    return {
        "blocks": of("block").select("doc_id", F.col("seq").alias("block_idx"), F.col("kind").alias("block_type"), "level", F.col("value").alias("text")),
        "notes": of("note").select("doc_id", F.col("kind").alias("note_id"), F.col("value").alias("text")),
        "comments": of("comment").select("doc_id", F.col("kind").alias("comment_id"), F.col("formula").alias("author"), F.col("value").alias("text")),
        "table_cells": of("table_cell").select("doc_id", F.col("seq").alias("block_idx"), "row", "col", F.col("value").alias("text")),
        "cells": of("cell").select("doc_id", F.col("kind").alias("sheet_id"), "row", "col", "value", "formula"),
        "formats": of("format").select("doc_id", F.col("kind").alias("sheet_id"), "row", "col", F.col("level").alias("format_id"), F.col("value").alias("format")),
        "validations": of("validation").select("doc_id", F.col("kind").alias("sheet_id"), F.col("value").alias("sqref"), F.col("formula").alias("formula1")),
        "merges": of("merge").select("doc_id", F.col("kind").alias("sheet_id"), F.col("value").alias("ref")),
        "slides": of("slide").select("doc_id", F.col("seq").alias("slide_no"), "kind", F.col("value").alias("text")),
        "warnings": warnings,
    }


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _all(node, tag: str) -> Iterator:
    return (x for x in node.iter() if _local(x.tag) == tag)


def _texts(node) -> str:
    return "".join(x.text or "" for x in _all(node, "t"))


def _attr(node, name: str, default: str = "") -> str:
    return next((v for k, v in node.attrib.items() if _local(k) == name), default)


#: Bytes of a part that are parsed at once.
PIECE = 1 << 16


def _elements(z: zipfile.ZipFile, part: str, *wanted: str, needed: bool = True, level: int | None = None) -> Iterator:
    """The outermost elements of a part with one of the names, each once it is complete; nothing else of the part is held.

    level: only those with so many elements around them. A part that is missing and not needed has none. Declared entities are refused, as a few of them can stand for any
    amount of text.
    """
    if not needed and part not in z.namelist():
        return
    done, builder, depth, around = [], ElementTree.TreeBuilder(), 0, 0

    def start(name: str, attributes: dict) -> None:
        nonlocal depth, around
        if depth or (_local(name) in wanted and level in (None, around)):
            builder.start(name, attributes)
            depth += 1
        around += 1

    def data(text: str) -> None:
        if depth:
            builder.data(text)

    def end(name: str) -> None:
        nonlocal builder, depth, around
        around -= 1
        if depth:
            node = builder.end(name)
            depth -= 1
            if not depth:
                done.append(node)
                builder = ElementTree.TreeBuilder()

    def refuse(*_) -> None:
        raise ValueError("entities are refused")

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, data, refuse
    with z.open(part) as f:
        while piece := f.read(PIECE):
            parser.Parse(piece)
            yield from done
            done.clear()
    parser.Parse(b"", True)
    yield from done


def _read_document(z: zipfile.ZipFile) -> Iterator[dict]:
    seen = False
    for i, block in enumerate(_elements(z, "word/document.xml", "p", "tbl", level=2)):
        seen = True
        level = re.fullmatch(r"(?i)heading\s*([1-9])", next((_attr(x, "val") for x in _all(block, "pStyle")), ""))
        kind = "table" if _local(block.tag) == "tbl" else "heading" if level else "paragraph"
        yield {"part": "block", "seq": i, "kind": kind, "level": int(level[1]) if level else None, "value": _texts(block)}
        if kind == "table":
            for r, row in enumerate(x for x in block if _local(x.tag) == "tr"):
                for c, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                    yield {"part": "table_cell", "seq": i, "row": r, "col": c, "value": "\n".join(_texts(p) for p in cell if _local(p.tag) in ("p", "tbl"))}
    if not seen and not any(True for _ in _elements(z, "word/document.xml", "body")):
        raise ValueError("no body")
    # Notes -1 and 0 are separators.
    for note in _elements(z, "word/footnotes.xml", "footnote", needed=False):
        if _attr(note, "id") not in ("-1", "0"):
            yield {"part": "note", "kind": _attr(note, "id"), "value": _texts(note).strip()}
    for comment in _elements(z, "word/comments.xml", "comment", needed=False):
        yield {"part": "comment", "kind": _attr(comment, "id"), "formula": _attr(comment, "author"), "value": _texts(comment).strip()}


def _sheet_names(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(part, name) of the sheets in the workbook's order; without a workbook, the parts under their own names."""
    targets = {_attr(r, "Id"): _attr(r, "Target") for r in _elements(z, "xl/_rels/workbook.xml.rels", "Relationship", needed=False)}
    named = [(targets.get(_attr(s, "id"), ""), s.get("name", "")) for s in _elements(z, "xl/workbook.xml", "sheet", needed=False)]
    found = [(t.lstrip("/") if t.startswith("/") else f"xl/{t}", name) for t, name in named if t]
    return found or [(n, n[14:-4]) for n in sorted(z.namelist()) if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]


def _cell_formats(z: zipfile.ZipFile) -> list[tuple[int, str | None]]:
    """(number format, its pattern if the workbook declares one) of each cell style."""
    codes, styles = {}, []
    for x in _elements(z, "xl/styles.xml", "numFmts", "cellXfs", needed=False):
        if _local(x.tag) == "numFmts":
            codes = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in x}
        else:
            styles = [int(f.get("numFmtId", "0")) for f in x]
    return [(n, codes.get(n)) for n in styles]


def _read_workbook(z: zipfile.ZipFile) -> Iterator[dict]:
    shared = [_texts(x) for x in _elements(z, "xl/sharedStrings.xml", "si", needed=False)]
    formats = _cell_formats(z)
    for part, sheet in _sheet_names(z):
        for x in _elements(z, part, "c", "mergeCell", "dataValidation"):
            name = _local(x.tag)
            if name == "mergeCell":
                yield {"part": "merge", "kind": sheet, "value": x.get("ref")}
            elif name == "dataValidation":
                if x.get("type", "").lower() == "list":
                    yield {"part": "validation", "kind": sheet, "value": x.get("sqref") or next(("".join(f.itertext()) for f in _all(x, "sqref")), ""), "formula": next(("".join(f.itertext()) for f in _all(x, "formula1")), "")}
            elif at := re.fullmatch(r"([A-Z]+)(\d+)", x.get("r", "")):
                row, col = int(at[2]) - 1, functools.reduce(lambda n, letter: n * 26 + ord(letter) - 64, at[1], 0) - 1
                parts = {_local(y.tag): y.text or "" for y in x}
                value = shared[int(parts["v"])] if x.get("t") == "s" and parts.get("v") else _texts(x) if x.get("t") == "inlineStr" else parts.get("v", "")
                yield {"part": "cell", "row": row, "col": col, "kind": sheet, "value": value, "formula": parts.get("f")}
                number, code = formats[int(x.get("s", "0"))] if int(x.get("s", "0")) < len(formats) else (0, None)
                if number:
                    yield {"part": "format", "row": row, "col": col, "kind": sheet, "level": number, "value": code}


def _read_slides(z: zipfile.ZipFile) -> Iterator[dict]:
    for kind, shape in (("slide", r"ppt/slides/slide(\d+)\.xml"), ("notes", r"ppt/notesSlides/notesSlide(\d+)\.xml")):
        for number, part in sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(shape, n))):
            lines = [t for p in _elements(z, part, "p") if (t := _texts(p))]
            yield {"part": "slide", "seq": number, "kind": kind, "value": "\n".join(lines)}


_READERS = {"docx": _read_document, "xlsx": _read_workbook, "pptx": _read_slides}
