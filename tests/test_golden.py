"""Literal cases of each operator family."""

import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioframe.functions import formats as FM
from folioframe.functions import scalar as S
from folioframe.operators import calc as K
from folioframe.operators import dictionary as B
from folioframe.operators import documents as D
from folioframe.operators import markup as M
from folioframe.operators import sheet as E
from folioframe.operators import spelling as C
from folioframe.operators import text as T
from folioframe.operators import validation as V
from folioframe.plans import catalog_text as Q
from folioframe.sources import documents as A
from folioframe.sources import text as X


def words(spark, *names, freq=1000):
    return spark.createDataFrame([(w, freq) for w in names], "word string, freq long")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_suggestions(spark):
    w = words(spark, "hello", "world", "help", "hero", "office", "document")
    q = spark.createDataFrame([("hello",), ("helo",), ("wrld",), ("",)], "query string")
    got = {(r.query, r.word): r.distance for r in C.suggest(q, w, 5, 2).collect()}
    assert [k for k in got if k[0] == "hello"] == [("hello", "hello")] and got["hello", "hello"] == 0
    assert got["helo", "hello"] == 1 and ("wrld", "world") in got and not any(k[0] == "" for k in got)
    assert {r.word: r.distance for r in C.suggest(spark.createDataFrame([("recieve",)], "query string"), words(spark, "receive", "relieve"), 5, 2).collect()}["receive"] == 1
    assert C.suggest(q, w.limit(0), 5, 2).count() == 0


@pytest.mark.parametrize("a,b,osa", [("hello", "hello", 0), ("hello", "hell", 1), ("hello", "hallo", 1), ("", "abc", 3), ("abc", "", 3), ("ca", "abc", 3), ("teh", "the", 1), ("kitten", "sitting", 3)])
def test_osa(spark, a, b, osa):
    assert one(spark, S.osa_distance(F.lit(a), F.lit(b))) == osa


def test_ranking_agrees_with_distances(spark):
    w = words(spark, "abcd", "abdc", "acbd", "badc", "bacd", "abce", "xbcd", "abcde", "dcba")
    q = spark.createDataFrame([("abdc",), ("bcda",), ("aabcd",)], "query string")
    got = {(r["query"], r.word): r.distance for r in C.rank_candidates(C.fuzzy_candidates(q, B.deletes_index(w, 2), 2), 99, 2).collect()}
    for (a, b), d in got.items():
        assert one(spark, S.osa_distance(F.lit(a), F.lit(b))) == d


def test_mixed_check(spark):
    d = spark.createDataFrame([(1, "teh quikc brown"), (2, "我们的世界")], "doc_id long, text string")
    w = {"en": words(spark, "the", "quick", "brown")}
    for lang in ("en", "mixed"):
        found = C.spell_check(d, "doc_id", "text", w, lang=lang).collect()
        assert sorted((r.doc_id, r.word, r.lang) for r in found) == [(1, "quikc", "en"), (1, "teh", "en")]
        assert {r.word: r.suggestions[0] for r in found} == {"teh": "the", "quikc": "quick"}


def test_segmentation(spark):
    d = spark.createDataFrame([(1, "我们在北京编辑文档"), (2, "ab 我们c")], "doc_id long, text string")
    found = T.segment_cjk(d, "doc_id", "text", words(spark, "我们", "北京", "编辑", "文档")).orderBy("doc_id", "seg_idx").collect()
    assert [r.word for r in found] == ["我们", "在", "北京", "编辑", "文档", "ab ", "我们", "c"]
    assert [(r.start, r.stop) for r in found if r.doc_id == 2] == [(0, 3), (3, 5), (5, 6)]


def test_tokens_and_runs(spark):
    d = spark.createDataFrame([(1, "étion don't 中文x-1"), (2, None)], "doc_id long, text string")
    assert [(r.word, r.start, r.stop) for r in T.tokenize(d, "doc_id", "text").orderBy("tok_idx").collect()] == [("tion", 1, 5), ("don't", 6, 11), ("中", 12, 13), ("文", 13, 14), ("x-1", 14, 17)]
    assert [(r.run, r.is_cjk, r.start) for r in T.script_runs(d, "doc_id", "text").orderBy("run_idx").collect()] == [("étion don't ", False, 0), ("中文", True, 12), ("x-1", False, 14)]


def test_affixes(spark):
    dic = spark.createDataFrame([(0, "3"), (1, "make/SD"), (2, "run/S"), (3, "two words"), (4, "plain")], "line_no long, line string")
    aff = spark.createDataFrame(list(enumerate(["SFX S Y 1", "SFX S 0 s .", "SFX D Y 2", "SFX D e ing e", "SFX D 0 d e", "junk"])), "line_no long, line string")
    got = {r.word: r.freq for r in B.expand_affixes(B.parse_dic(dic), B.parse_aff(aff)).collect()}
    assert got == {"make": 960, "makes": 960, "making": 960, "maked": 960, "run": 970, "runs": 970, "plain": 950}


def test_rounding_and_errors(spark):
    assert one(spark, S.js_round(F.lit(-2.5))) == -2.0
    assert one(spark, FM.to_fixed(F.lit(0.125), 2)) == "0.13" and one(spark, FM.to_fixed(F.lit(1.45), 1)) == "1.4" and one(spark, FM.to_fixed(F.lit(-2.5), 0)) == "-3"
    op = lambda o, a, b: one(spark, S.sheet_result(S.sheet_op(o, S.sheet_operand(F.lit(a)), S.sheet_operand(F.lit(b)))))
    assert op("/", "1", "0") == "#DIV/0!" and op("^", "-2", "2") == "4" and op("+", "x", "1") == "#ERROR"
    assert one(spark, S.js_number(F.lit("1d"))) is None and one(spark, S.js_number(F.lit(" "))) == 0 and one(spark, S.parse_float(F.lit("12px"))) == 12


def test_formats(spark):
    fmt = lambda v, t: one(spark, FM.format_value(F.lit(v), t))
    assert fmt("1234.5", "thousands") == "1,234.5" and fmt("0.256", "percent") == "26%" and fmt("x", "int") == "x" and fmt("1234.5", "¥#,##0.00") == "¥1,234.50" and fmt("1234.5", "0.0") == "1234.5"
    assert fmt("45292", "yyyy-mm-dd") == "2024-01-01" and fmt("2024/3/5 7:08", "yyyy-mm-dd hh:mm") == "2024-03-05 07:08" and fmt("", "int") == "" and fmt("  ", "0.00") == "  "
    assert fmt("2.5", "int") == "3" and fmt("0.1234", "percent2") == "12.34%" and fmt("0.5", "0.0%") == "50.0%" and fmt("7", '"EUR" #,##0') == "EUR7" and fmt("70000", "yyyy-mm-dd") == "70000"
    # Characters of other scripts are no part of a field's surroundings.
    assert fmt("45356.3", "yyyy年m月d日 hh:mm") == "2024年3月5日 07:12" and fmt("45356", "yyyy年m月d日") == "45356" and fmt("45356", "date") == "45356"
    assert fmt("45356.3", "dddd d mmm yy, h:mm:ss") == "周二 5 Mar 24, 7:12:00"


def test_format_tokens(spark):
    token = lambda i, c="": one(spark, FM.fmt_token(F.lit(i), F.lit(c)))
    assert [token(i) for i in (1, 4, 14, 22, 36, 45, 49, 58, 5)] == ["int", "thousands2", "date", "date", "date", "date", "@", "date", ""]
    assert token(164, "yyyy年m月d日") == "yyyy年m月d日" and token(164, ' "¥"#,##0.00') == "currency" and token(164, "+0.0") == "+0.0" and token(164, "[Red]0") == ""
    back = lambda t: tuple(one(spark, FM.fmt_id(F.lit(t))))
    assert back("date") == (14, "") and back("currency") == (0, "¥#,##0.00") and back("yyyy年m月d日") == (0, "yyyy年m月d日") and back("[Red]") == (None, None)


def test_date_serials(spark):
    assert one(spark, S.serial_to_ts(F.lit(45292.5))) == datetime(2024, 1, 1, 12)
    assert one(spark, S.ts_to_serial(F.lit(datetime(2024, 1, 1, 12)))) == 45292.5
    assert one(spark, S.ts_to_serial(F.lit(datetime(1890, 1, 1)))) == 0 and one(spark, S.serial_to_ts(F.lit(-1.0))) is None
    assert one(spark, S.serial_to_ts(F.lit(61.9999999))) == datetime(1900, 3, 1, 23, 59, 59, 991360) and one(spark, S.serial_to_ts(F.lit(0.0))) == datetime(1899, 12, 30)
    half = lambda ms: one(spark, S.serial_to_ts(F.lit(45292 + ms / 86_400_000)))
    assert half(500) == datetime(2024, 1, 1) and half(501) == datetime(2024, 1, 1, 0, 0, 1)
    assert one(spark, S.serial_to_ts(F.lit(0.25), True)) == datetime(1904, 1, 1, 6) and one(spark, S.serial_to_ts(F.lit(100.0), True)) == datetime(1904, 4, 10)


def test_references(spark):
    assert one(spark, S.col_name(F.lit(37))) == "AK" and one(spark, S.col_number(F.lit("ak"))) == 37 and one(spark, S.col_name(F.lit(16384))) == "XFD"
    assert one(spark, S.col_number(F.lit("XFE"))) is None and one(spark, S.col_number(F.lit("A1"))) is None
    assert tuple(one(spark, S.parse_range(F.lit("$C$3:A1")))) == (1, 1, 3, 3) and one(spark, S.parse_range(F.lit("3:A1"))) is None


def sheet(spark, rows):
    return spark.createDataFrame([("s", r, c, v) for r, c, v in rows], "sheet_id string, row int, col int, value string").withColumn("formula", F.lit(None).cast("string"))


def test_range_agg_counts_blanks(spark):
    cells = sheet(spark, [(0, 0, "2"), (1, 0, "4"), (3, 0, "x")])
    ranges = spark.createDataFrame([(f, f, "s", 0, 0, 3, 0) for f in ("AVERAGE", "COUNT", "MIN", "SUM", "FOO")], "target string, fn string, sheet_id string, r1 int, c1 int, r2 int, c2 int")
    got = {r.fn: (r.result, r.error) for r in K.range_agg(cells, ranges).collect()}
    assert got["AVERAGE"][0] == 1.5 and got["COUNT"][0] == 4 and got["MIN"][0] == 0 and got["SUM"][0] == 6 and got["FOO"][1] == "#NAME?"


def test_series(spark):
    seeds = [("a", "2"), ("a", "4"), ("g", "2"), ("g", "6"), ("g", "18"), ("one", "5"), ("c", "x"), ("c", "y")]
    rows = [(s, i, v) for i, (s, v) in enumerate(seeds)]
    got = K.fill_series(spark.createDataFrame(rows, "series string, idx int, value string"), 3).orderBy("series", "step").collect()
    by = {}
    for r in got:
        by.setdefault(r.series, []).append(r.value)
    assert by == {"a": ["6", "8", "10"], "g": ["54", "162", "486"], "one": ["6", "7", "8"], "c": ["x", "y", "x"]}


def test_sort_and_duplicates(spark):
    df = spark.createDataFrame([(0, "1"), (1, ""), (2, "10"), (3, "2")], "row int, v string")
    assert [r.v for r in E.multi_sort(df, [("v", False)], "row").collect()] == ["10", "2", "1", ""]
    d = spark.createDataFrame(list(enumerate(["a", "", "a", "", "b"])), "row int, v string")
    assert [r.v for r in E.remove_duplicates(d, "v", "row").orderBy("row").collect()] == ["a", "", "", "b"]


def test_outline(spark):
    b = spark.createDataFrame([(1, i, lv, "heading", None) for i, lv in enumerate([1, 2, 2, 1, 3])], "doc_id long, block_idx int, level int, block_type string, text string")
    assert [r.number for r in D.number_outline(D.headings(b)).orderBy("heading_no").collect()] == ["1", "1.1", "1.2", "2", "2.1"]
    assert D.headings(b).orderBy("heading_no").first().text == "标题 1"


def test_changes(spark):
    runs = spark.createDataFrame([(1, i, t, k) for i, (t, k) in enumerate([("a", "insert"), ("b", "insert"), ("c", None), ("d", "delete")])], "doc_id long, i int, content string, track string")
    every = D.change_ranges(runs, ["doc_id"], ["i"], F.col("track")).orderBy("range_no").collect()
    assert [(r.kind, r.text) for r in every] == [("insert", "ab"), ("delete", "d")]
    assert [r.text for r in D.change_ranges(runs, ["doc_id"], ["i"], F.col("track"), compat=True).collect()] == ["d"]


def test_markdown(spark):
    text = "# Title #\n\n- a\n1. b\n> q\n```py\n# no\nx\n```\n| h | k |\n|---|---|\n| 1 | 2 |\ntail **b** *i* `c` [t](u)\n```\nopen"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    blocks = M.markdown_blocks(d, "doc_id", "text").orderBy("block_idx").collect()
    assert [b.block_type for b in blocks] == ["heading", "bullet", "ordered", "quote", "code", "table", "paragraph", "code"]
    assert blocks[4].lang == "py" and blocks[4].text == "# no\nx" and blocks[7].text == "open"
    assert [(r.level, r.title, r.slug) for r in M.markdown_toc(d, "doc_id", "text").collect()] == [(1, "Title", "title")]
    assert [(r.row, r.col, r.value, r.is_header) for r in M.markdown_tables(d, "doc_id", "text").orderBy("row", "col").collect()] == [(0, 0, "h", True), (0, 1, "k", True), (1, 0, "1", False), (1, 1, "2", False)]
    runs = M.markdown_inlines(M.markdown_blocks(d, "doc_id", "text")).where("block_idx = 6").orderBy("run_idx").collect()
    assert [(r.kind, r.content) for r in runs] == [("text", "tail "), ("bold", "b"), ("text", " "), ("italic", "i"), ("text", " "), ("code", "c"), ("text", " "), ("link", "t")] and runs[-1].url == "u"


def test_sanitise(spark):
    html = "<p onclick=\"x()\" class='a'>t<script>bad</script><a href=\"javascript:1\">l</a><iframe src=x>in</iframe><input></p>"
    assert one(spark, M.sanitize_html(F.lit(html))) == "<p class='a'>t<a href=\"#\">l</a></p>"
    assert one(spark, S.fold_math(F.lit("$$a\n b$$ x  y $c\n d$"))) == "$$a b$$ x  y $c d$"


@pytest.mark.parametrize("text,items", [('"yes,no"', ["yes", "no"]), ('="yes,no"', ["yes", "no"]), ("$E$1:$E$3", None), ("Sheet1!$A$1:$A$3", None), ("a, ,b", ["a", "b"])])
def test_literal_list(spark, text, items):
    assert one(spark, V.literal_list(F.lit(text))) == items


def test_rectangles(spark):
    m = spark.createDataFrame([("s", 0, 0, 2, 2), ("s", 2, 2, 4, 4), ("s", 4, 0, 4, 2), ("s", 9, 9, 9, 9)], "sheet_id string, r1 int, c1 int, r2 int, c2 int")
    assert sorted(tuple(r)[1:] for r in E.coalesce_rects(m).collect()) == [(0, 0, 4, 4), (9, 9, 9, 9)]


def test_doc_json(spark):
    j = '{"blocks":[{"level":2,"inline":[{"content":"T"}]},{"items":[[]]},{"src":"a","kind":"k"},{"src":"a"},{"restart":true},{"code":"x"},{"inline":[{"track":"insert","content":"n"},{"url":"u","content":"l"}]},{}]}'
    blocks, runs = A.parse_doc_json(spark.createDataFrame([(1, j)], "doc_id long, j string"), "doc_id", "j")
    assert [b.block_type for b in blocks.orderBy("block_idx").collect()] == ["heading", "list", "raw", "image", "page_break", "code", "paragraph", "paragraph"]
    assert [(r.kind, r.content) for r in runs.orderBy("block_idx", "run_idx").collect()] == [("text", "T"), ("track", "n"), ("link", "l")]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b ""q"", c"\n1\n')
    (tmp_path / "b.csv").write_text("x\ty,z\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text(",".join(map(str, range(300))) + "\n\nlast,,x\n")
    (tmp_path / "e.csv").write_text('p,"two\nlines",,""\n' + ",".join(["q"] * 300) + "\n")
    got = {(r.sheet_id.rsplit("/", 1)[1], r.row, r.col): r.value for r in X.read_delimited(spark, str(tmp_path)).collect()}
    assert {k: got.pop(k) for k in list(got) if k[0] == "d.csv"} == {**{("d.csv", 0, i): str(i) for i in range(300)}, ("d.csv", 1, 0): "last", ("d.csv", 1, 2): "x"}
    assert {k: got.pop(k) for k in list(got) if k[0] == "e.csv"} == {("e.csv", 0, 0): "p", ("e.csv", 0, 1): "two\nlines", ("e.csv", 0, 3): "", **{("e.csv", 1, i): "q" for i in range(300)}}
    assert got == {("a.csv", 0, 0): "a", ("a.csv", 0, 1): 'b "q", c', ("a.csv", 1, 0): "1", ("b.csv", 0, 0): "x", ("b.csv", 0, 1): "y,z"}


def test_damaged_archive_is_a_warning(spark, tmp_path):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="B2" t="inlineStr"><is><t>v</t></is></c></row></sheetData><mergeCells><mergeCell ref="B2:C3"/></mergeCells></worksheet>')
    (tmp_path / "ok.xlsx").write_bytes(data.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"nothing")

    def archive(name, parts, cut=None):
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for part, text in parts.items():
                z.writestr(part, text)
        content = bytearray(made.getvalue())
        if cut:
            content[cut : cut + 20] = bytes(20)
        (tmp_path / name).write_bytes(content)

    archive("nobody.docx", {"word/document.xml": "<w:document xmlns:w='w'/>"})
    archive("index.xlsx", {"xl/sharedStrings.xml": "<sst/>", "xl/worksheets/sheet1.xml": "<worksheet><c r='A1' t='s'><v>7</v></c></worksheet>"})
    archive("stream.docx", {"word/document.xml": "<w:document xmlns:w='w'><w:body>" + "".join(f"<w:p>{i}</w:p>" for i in range(500)) + "</w:body></w:document>"}, cut=200)
    parts = A.ingest_ooxml(spark, str(tmp_path))
    assert [(c.row, c.col, c.value) for c in parts["cells"].collect()] == [(1, 1, "v")] and [m.ref for m in parts["merges"].collect()] == ["B2:C3"]
    assert {w.doc_id.rsplit("/", 1)[1] for w in parts["warnings"].collect()} == {"bad.docx", "nobody.docx", "index.xlsx", "stream.docx"}
    assert A.ingest_ooxml(spark, str(tmp_path), max_bytes=10)["warnings"].where("message = 'file too large'").count() == 4


def test_recalc_settles_a_long_chain(spark):
    cells = spark.createDataFrame([("s", 0, 0, "1")], "sheet_id string, row int, col int, value string")
    chain = [("s", r, 0, "SUM", r - 1, 0, r - 1, 0) for r in range(1, 22)]
    formulas = spark.createDataFrame(chain, "sheet_id string, row int, col int, fn string, r1 int, c1 int, r2 int, c2 int")
    assert {r.row: float(r.value) for r in K.recalc(cells, formulas).collect()} == {r: 1.0 for r in range(22)}
    with pytest.warns(UserWarning, match="still change"):
        K.recalc(cells, formulas, max_iter=3)


def test_boxes_that_reach_each_other_step_by_step(spark):
    """A staircase of which each box is met only by the box of all before it, and random rectangles, against a plain loop."""
    import random

    draw = random.Random(5)
    rects = [("r", a, b, a + draw.randint(0, 6), b + draw.randint(0, 6)) for a, b in ((draw.randint(0, 90), draw.randint(0, 90)) for _ in range(40))]
    for k in range(8):
        rects += [("stairs", 3 * k, 3 * k + 2, 3 * k + 2, 3 * k + 2), ("stairs", 3 * k + 2, 3 * k, 3 * k + 4, 3 * k)]
    left = set(rects)
    while True:
        meets = lambda x, y: x[0] == y[0] and x[1] <= y[3] and x[3] >= y[1] and x[2] <= y[4] and x[4] >= y[2]
        grown = {(x[0], *(f(y[i] for y in left if meets(x, y)) for f, i in ((min, 1), (min, 2), (max, 3), (max, 4)))) for x in left}
        if grown == left:
            break
        left = grown
    df = spark.createDataFrame(rects, "sheet_id string, r1 int, c1 int, r2 int, c2 int")
    assert {tuple(r) for r in E.coalesce_rects(df).select("sheet_id", "r1", "c1", "r2", "c2").collect()} == left


def test_many_unknown_words_are_placed_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the qat sat the Qat"), (2, "the mat"), (3, None), (4, "zzz 汉 12")], "doc_id long, text string")
    words = spark.createDataFrame([("the", 9), ("sat", 5), ("mat", 5)], "word string, freq long")
    found = lambda: sorted((r.doc_id, r.tok_idx, r.word, r.start, r.stop, r.lang) for r in C.misspelt(docs, "doc_id", "text", words).collect())
    few = found()
    assert few == [(1, 1, "qat", 4, 7, "en"), (1, 4, "Qat", 16, 19, "en"), (4, 0, "zzz", 0, 3, "en")]
    monkeypatch.setattr(C, "FEW_WORDS", 0)
    assert found() == few


def test_texts_of_a_spell_check_are_walked_once(spark, monkeypatch):
    """The texts are in the plan once, with all known words left out or with some, and no token that is left out is shuffled."""
    docs = spark.createDataFrame([(1, "the qat sat the Qat on"), (2, "the mat"), (3, None), (4, "zzz 汉 12 own")], "doc_id long, text string")
    words = spark.createDataFrame([("the", 9), ("sat", 5), ("mat", 5), ("on", 7)], "word string, freq long")
    mine = spark.createDataFrame([("own", "en"), ("zzz", "fr")], "word string, lang string")
    for few in (1, 2, 3, 250_000):
        monkeypatch.setattr(C, "FEW_WORDS", few)
        for user_dict, more in ((None, {"own"}), (mine, set())):
            found = C.misspelt(docs, "doc_id", "text", words, user_dict)
            assert {r.word for r in found.collect()} == {"qat", "Qat", "zzz"} | more
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan


def test_words_are_counted_in_tasks(spark, monkeypatch):
    """Counts are whole where a task lets go of what it holds, and what lies between tokens makes none of its own."""
    monkeypatch.setattr(T, "HELD_WORDS", 3)
    texts = ["The cat's the THE x-1 汉汉", None, "", "\u0130a \u212ab The", "one two three four one"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    counted = T.count_words(df, "text")
    want = {r["low"]: r["count"] for r in T.words_only(df, "doc_id", "text").groupBy(F.lower("word").alias("low")).count().collect()}
    assert {r.word: r.freq for r in counted.collect()} == want and want["the"] == 12 and want["汉"] == 6
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_stems_are_counted_once(spark, tmp_path):
    spark.createDataFrame([(i, "table tables retable tabled ab") for i in range(6)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = Q.affix_words(spark, str(tmp_path))
    assert "documents.parquet" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.word: r.n_stems for r in made.collect()}["tables"] == 2


def test_fill_and_squash(spark):
    seeds = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c"), ("n", 0, "5")], "series string, idx int, value string")
    got = {(r.series, r.step): r.value for r in K.fill_series(seeds, 4, backwards=True).collect()}
    assert [got["s", k] for k in (1, 2, 3, 4)] == ["a", "c", "b", "a"] and [got["n", k] for k in (1, 2)] == ["6", "7"]
    cells = [(r, c) for r, c in ((0, 0), (1, 0), (3, 0), (4, 0), (0, 1), (2, 3))]
    df = spark.createDataFrame([("s", r, c, "x,y") for r, c in cells], "sheet_id string, row int, col int, valid string")
    assert [r.sqref for r in V.squash_cells(df).orderBy("n").collect()] == ["A1:A2", "A4:D3"]


def test_outline_rules(spark):
    level = lambda style, rule: one(spark, S.outline_level(F.lit(style), F.lit(None).cast("int"), rule))
    assert [level(s, "docx") for s in ("Heading2", "heading 9", "MyHeading2", "Heading0")] == [2, 9, None, None]
    assert [level(s, "library") for s in ("Heading6", "h1", "Heading7", "Heading 1")] == [6, 1, None, None]
    assert [level(s, "editor") for s in ("style3", "a12", "9")] == [3, None, 9]


def test_notes_rules_and_rectangles(spark):
    refs = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (1, 9, "b"), (1, 1, "0")], "doc_id long, pos int, footnote_id string")
    notes = spark.createDataFrame([(1, "a", "first"), (1, "b", "second"), (1, "c", "never")], "doc_id long, footnote_id string, text string")
    listed = D.footnote_list(D.number_footnotes(refs), notes).orderBy("footnote_no").collect()
    assert [(r.footnote_no, r.text) for r in listed] == [(1, "first"), (2, "second")]
    values = spark.createDataFrame([(i, v) for i, v in enumerate(["0", "5", "10", "x", ""])], "i int, v string")
    shares = [r.rule for r in K.cond_rule(values, "v", "scale").orderBy("i").collect()]
    assert shares == [0.0, 0.5, 1.0, None, None] and one(spark, K.bar_alpha(F.lit(1.0))) == pytest.approx(0.7)
    merges = spark.createDataFrame([("s", 0, 0, 1, 1), ("s", 3, 3, 4, 4), ("t", 0, 0, 1, 1)], "sheet_id string, r1 int, c1 int, r2 int, c2 int")
    assert sorted((m.sheet_id, m.r1) for m in E.split_region(merges, "s", 9, 9, 4, 4).collect()) == [("s", 0), ("t", 0)]


def test_user_words_over_an_old_dictionary(spark):
    t = lambda d: datetime(2024, 1, d)
    old = spark.createDataFrame([("cat", "en", 3, "a", t(1), t(2)), ("dog", "en", 5, "a", t(1), t(1))], "word string, lang string, frequency long, source string, created_at timestamp, last_used timestamp")
    events = [("add", " Cat ", "en", "b", 2, t(5)), ("remove", "dog", "en", "b", 0, t(6)), ("add", "dog", "en", "c", 1, t(7)), ("add", "new", "en", "c", 0, t(8))]
    got = {r.word: (r.frequency, r.source, r.created_at, r.last_used) for r in B.upsert_user_words(old, spark.createDataFrame(events, "op string, word string, lang string, source string, inc int, ts timestamp")).collect()}
    assert got == {"cat": (5, "a", t(1), t(5)), "dog": (1, "c", t(7), t(7)), "new": (1, "c", t(8), t(8))}
    zh = B.build_dictionary(spark.createDataFrame([(" 的 ", 0), ("Ab", 2)], "word string, freq long"), None, "zh").collect()
    assert sorted((r.word, r.freq) for r in zh) == [("Ab", 2), ("的", 1)] and B.max_distance(old, "zh") == 1 and B.max_distance(old, "en") == 2
    web = X.import_text(spark.createDataFrame([(1, "a b,c\td")], "i int, t string"), "i", "t", "web").orderBy("col").collect()
    assert [r.value for r in web] == ["a b", "c", "d"]


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['folioframe.llm'] = None\nimport __spark_entry__ as e\nassert 'spell_check' in e.queries() and 'spell_check' in e.oracle_sql() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_rules_longer_than_a_rule_can_be(spark):
    """Bytes of the trimmed items count, joined by commas."""
    lists = ["汉" * 201, "a" * 254 + ",", "a" * 254, "a" * 255, "x , " * 100, " x ,y"]
    cells = spark.createDataFrame([("s", v, i, 0) for i, v in enumerate(lists)], "sheet_id string, valid string, row int, col int")
    assert {r.row for r in V.compress_runs(cells).collect()} == {1, 2, 4, 5}
    assert {(r.valid, r.n_bytes, r.n_cells) for r in V.long_lists(cells).collect()} == {(lists[0], 603, 1), (lists[3], 255, 1)}


def test_ranges_of_whole_columns_and_of_used_cells(spark):
    rules = spark.createDataFrame([("s", "A2500:B2501 C1"), ("t", "A1:A3"), ("u", "A1")], "sheet_id string, sqref string")
    key = lambda df: {(r.sheet_id, r.row, r.col) for r in df.collect()}
    assert key(V.expand_ranges(rules)) == {("s", 2499, 0), ("s", 2499, 1), ("s", 2500, 0), ("s", 2500, 1), ("s", 0, 2), ("t", 0, 0), ("t", 1, 0), ("t", 2, 0), ("u", 0, 0)}
    assert V.expand_ranges(spark.createDataFrame([("s", "B1:B1048576")], "sheet_id string, sqref string")).count() == 1_048_576
    used = E.used_bounds(spark.createDataFrame([("s", 2499, 0, "x", None), ("t", 1, 5, None, "=A1")], "sheet_id string, row int, col int, value string, formula string"))
    assert key(V.expand_ranges(rules, bounds=used)) == {("s", 2499, 0), ("t", 0, 0), ("t", 1, 0)}


def test_a_null_list_clears_a_rule(spark):
    cells = spark.createDataFrame([("s", 0, 0, "a,b"), ("s", 1, 0, "c"), ("s", 2, 0, None)], "sheet_id string, row int, col int, valid string")
    rules = spark.createDataFrame([("s", 0, 0, 0, 0, None), ("s", 2, 0, 9, 0, "d")], "sheet_id string, r1 int, c1 int, r2 int, c2 int, valid string")
    assert {r.row: r.valid for r in V.apply_validation(cells, rules).collect()} == {0: None, 1: "c", 2: "d"}


def test_days_of_the_system_that_starts_in_1904(spark):
    assert one(spark, S.serial_to_ts(F.lit(0.5), True)) == datetime(1904, 1, 1, 12)
    assert one(spark, S.serial_to_ts(F.lit(1.0), True)) == datetime(1904, 1, 2)
    assert one(spark, S.ts_to_serial(F.lit(datetime(1904, 1, 2, 6)), True)) == 1.25
    assert one(spark, S.ts_to_serial(F.lit(datetime(1900, 1, 1)), True)) == 0.0


def test_slugs_keep_a_leading_blank_as_a_hyphen(spark):
    assert one(spark, S.slugify(F.lit(" A (b)  c "))) == "-a-b-c-"
