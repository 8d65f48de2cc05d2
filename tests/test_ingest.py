"""Archives as streams of elements, and differences by digests."""

import io
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import validation as V
from folioframe.sources import documents as A


def archive(parts: dict[str, str]) -> bytes:
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for part, text in parts.items():
            z.writestr(part, text)
    return made.getvalue()


W = "<w:document xmlns:w='w'><w:body>{}</w:body></w:document>"


def ingest(spark, **files):
    return A.ingest_archives(spark.createDataFrame([(name.replace("_", "."), bytearray(content)) for name, content in files.items()], "path string, content binary"))


def test_tables_lists_and_formats(spark):
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in cells) + "</w:tr>"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + row(p("a") + p("b"), p("c")) + row("", "<w:tbl>" + row(p("in")) + "</w:tbl>") + "</w:tbl>"
    sheet = (
        "<worksheet xmlns:x='x'><sheetData><row><c r='B2' s='1'><v>5</v></c><c r='C2' s='2'><v>6</v></c><c r='D2'><f>SUM(A1)</f><v>7</v></c><c r='E2' s='9'><v>8</v></c></row></sheetData>"
        "<dataValidations><dataValidation type='list' sqref='A1:A3 C1'><formula1>\"x,y\"</formula1></dataValidation><dataValidation type='whole' sqref='B1'><formula1>1</formula1></dataValidation></dataValidations>"
        "<extLst><x:dataValidation type='list'><x:formula1><x:f>T!$A$1</x:f></x:formula1><x:sqref>D4</x:sqref></x:dataValidation></extLst></worksheet>"
    )
    styles = "<styleSheet><numFmts><numFmt numFmtId='164' formatCode='0.000'/></numFmts><cellStyleXfs><xf numFmtId='9'/></cellStyleXfs><cellXfs><xf numFmtId='0'/><xf numFmtId='164'/><xf numFmtId='14'/></cellXfs></styleSheet>"
    got = ingest(spark, a_docx=archive({"word/document.xml": W.format(p("first") + table + p("last"))}), b_xlsx=archive({"xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": styles}))
    rows = lambda name, *c: sorted(tuple(r) for r in got[name].select(*c).collect())
    assert rows("blocks", "block_idx", "block_type", "text") == [(0, "paragraph", "first"), (1, "table", "abcin"), (2, "paragraph", "last")]
    assert rows("table_cells", "block_idx", "row", "col", "text") == [(1, 0, 0, "a\nb"), (1, 0, 1, "c"), (1, 1, 0, ""), (1, 1, 1, "in")]
    assert rows("validations", "sqref", "formula1") == [("A1:A3 C1", '"x,y"'), ("D4", "T!$A$1")]
    assert rows("formats", "row", "col", "format_id", "format") == [(1, 1, 164, "0.000"), (1, 2, 14, None)]
    assert rows("cells", "row", "col", "value", "formula") == [(1, 1, "5", None), (1, 2, "6", None), (1, 3, "7", "SUM(A1)"), (1, 4, "8", None)]
    # The lists feed the rules of sheets.
    found = V.expand_ranges(got["validations"].withColumn("valid", V.literal_list(F.col("formula1"))).where("valid is not null"))
    assert sorted((r.row, r.col) for r in found.collect()) == [(0, 0), (0, 2), (1, 0), (2, 0)]


def test_entities_are_refused_and_damage_drops_what_came_before(spark):
    bomb = "<!DOCTYPE d [<!ENTITY a 'xxxxxxxxxx'><!ENTITY b '&a;&a;&a;&a;&a;&a;&a;&a;'>]>" + W.format("<w:p><w:t>&b;</w:t></w:p>")
    cut = W.format("<w:p><w:t>y</w:t></w:p>" * 30_000)[:-30]
    got = ingest(spark, bomb_docx=archive({"word/document.xml": bomb}), cut_docx=archive({"word/document.xml": cut}), ok_docx=archive({"word/document.xml": W.format("<w:p/>")}))
    assert {r.doc_id: r.message.split(":")[0] for r in got["warnings"].collect()} == {"bomb.docx": "ValueError", "cut.docx": "ExpatError"}
    assert [(r.doc_id, r.text) for r in got["blocks"].collect()] == [("ok.docx", "")]
    assert ingest(spark, none_txt=b"")["cells"].count() == 0


def test_a_large_sheet_is_read_in_little_memory():
    """Rows of a sheet of 60 MB are given one by one; what is held doesn't follow them."""
    cell = "<c r='B{0}'><v>{0}</v></c>"
    text = "<worksheet><sheetData>" + "".join(f"<row>{cell.format(i)}</row>" for i in range(1, 1_500_000)) + "</sheetData></worksheet>"
    content = archive({"xl/worksheets/sheet1.xml": text})
    del text
    tracemalloc.start()
    z = zipfile.ZipFile(io.BytesIO(content))
    rows = A._read_workbook(z)
    assert sum(1 for _, _ in zip(range(200_000), rows)) == 200_000
    assert tracemalloc.get_traced_memory()[1] < len(content) + (8 << 20)
    tracemalloc.stop()


def test_parts_are_written_once(spark, monkeypatch):
    got = ingest(spark, ok_docx=archive({"word/document.xml": W.format("<w:p><w:t>a</w:t></w:p>")}))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in got.values()]
    assert all("MapInArrow" not in p and "PartitionFilters: [isnotnull(part" in p for p in plans)


@pytest.mark.parametrize("few", [200_000, 0])
def test_differences_by_digests(spark, monkeypatch, few):
    """Nulls in keys and columns, repeated keys, nested columns, a value that moves from one column to the next."""
    monkeypatch.setattr(V, "FEW_KEYS", few)
    draw = random.Random(few)
    value = lambda: draw.choice([None, "", "a", "b"])
    rows = lambda: [(draw.choice([None, *range(12)]), value(), value(), [value()], draw.choice([0.0, -0.0, float("nan"), None])) for _ in range(25)]
    schema = "k int, x string, y string, z array<string>, d double"
    left = rows()
    right = rows() + left[:10] + [(50, None, "a", [None, "q"], 1.0)]
    left += [(50, "a", None, ["q", None], 1.0)]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    same = lambda p, q: p == q or (p != p and q != q and p is not None and q is not None)
    want = []
    for l in left:
        met = [r for r in right if r[0] == l[0] and l[0] is not None]
        want += [(l[0], "left_only", "")] * (not met)
        for r in met:
            names = [n for n, p, q in zip(("x", "y", "z", "d"), l[1:], r[1:]) if not same(p, q)]
            want += [(l[0], "differs", ",".join(names))] * bool(names)
    want += [(r[0], "right_only", "") for r in right if r[0] is None or all(l[0] != r[0] for l in left)]
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted((tuple(r) for r in V.table_diff(a, b, ["k"]).collect()), key=key) == sorted(want, key=key)
