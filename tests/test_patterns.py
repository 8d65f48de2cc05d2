"""Segmentation by a broadcast list and by a join, and many patterns at once, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import spelling as C
from folioframe.operators import text as T


def texts(seed: int) -> list[tuple[int, str | None]]:
    draw = random.Random(seed)
    return [(i, "".join(draw.choices("我们在北京编辑文档的x y1\n", k=draw.randint(0, 25)))) for i in range(60)] + [(99, None), (98, "")]


def test_segments_are_the_same_by_list_and_by_join(spark, monkeypatch):
    docs = spark.createDataFrame(texts(1), "doc_id long, text string").repartition(3)
    draw = random.Random(2)
    words = sorted({"".join(draw.choices("我们在北京编辑文档的", k=draw.randint(1, 5))) for _ in range(150)}) + ["xy", "我x"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    plain = T.segment_cjk(docs, "doc_id", "text", frame)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString().replace("RoundRobinPartitioning", "").split("MapInArrow")[0]
    by_list = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(T, "BROADCAST_WORDS", 0)
    assert by_list == sorted(map(tuple, T.segment_cjk(docs, "doc_id", "text", frame).collect()))
    known = {w for w in words if len(w) > 1}
    for doc, text in texts(1):
        own = [(w, a, b) for d, _, w, a, b in by_list if d == doc]
        assert "".join(w for w, _, _ in own) == (text or "") and all((text or "")[a:b] == w for w, a, b in own)
        assert all(w in known or len(w) == 1 for w, _, _ in own if "一" <= w[0] <= "鿿")


def test_longest_words_are_found_in_strings():
    draw = random.Random(7)
    words = {"".join(draw.choices("我们在北京", k=draw.randint(2, 6))) for _ in range(700)}
    held: dict = {"words": {}}
    for c in "我们在北京":
        held["words"][c] = [(n, own) for n in range(6, 1, -1) if (own := "".join(sorted(w for w in words if w[0] == c and len(w) == n)))]
    longest = T.longest_word(held)
    for _ in range(3000):
        text = "".join(draw.choices("我们在北京x", k=9))
        at = draw.randrange(9)
        assert longest(text, at) == max([n for n in range(2, 7) if text[at : at + n] in words and at + n <= 9], default=1)


def test_texts_are_walked_with_more_than_a_million_words(spark):
    """No substring of a text is shuffled to meet a long dictionary."""
    numbered = F.translate(F.lpad(F.col("id").cast("string"), 7, "0"), "0123456789", "我们在北京编辑文档的")
    words = spark.range(1_000_100).select(numbered.alias("word"))
    docs = spark.createDataFrame([(1, "我们在北京编辑文档的我我我我我我我们x我我"), (2, "档的")], "doc_id long, text string")
    found = T.segment_cjk(docs, "doc_id", "text", words)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.word for r in found.where("doc_id = 1").orderBy("seg_idx").collect()] == ["我们在北京编辑", "文", "档", "的", "我我我我我我我", "们", "x", "我", "我"]


def occurrences(text: str, pattern: str) -> list[int]:
    out, at = [], text.find(pattern)
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + len(pattern))
    return out


@pytest.mark.parametrize("case_sensitive,together", [(False, 200_000), (True, 200_000), (False, 3)])
def test_patterns(spark, monkeypatch, case_sensitive, together):
    """In one pass, and in several of a few patterns."""
    monkeypatch.setattr(T, "MANY_PATTERNS", together)
    draw = random.Random(3)
    docs = [(i, "".join(draw.choices("aAbBéÉ ", k=draw.randint(0, 80)))) for i in range(40)] + [(50, None), (51, "İa İA")]
    patterns = ["a", "aa", "AB", "ab", "bab", "É", "", "zz", "ba b"]
    got = {tuple(r) for r in T.find_patterns(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(p,) for p in patterns], "pattern string"), case_sensitive).collect()}
    fold = (lambda x: x) if case_sensitive else lambda x: "".join(y if len(y := c.lower()) == 1 else c for c in x)
    want = {(d, p, k, at, at + len(p)) for d, t in docs for p in patterns if p for k, at in enumerate(occurrences(fold(t or ""), fold(p)))}
    assert got == want


def test_errors_of_each_document_are_marked(spark):
    draw = random.Random(5)
    runs = [(d, k, "".join(draw.choices("aAbB ", k=draw.randint(0, 60)))) for d in range(12) for k in range(4)] + [(0, 9, None)]
    errors = [(d, w, ["s" + w, "t", "u"]) for d in range(10) for w in draw.sample(["ab", "Aba", "b", "ba", "bb b", "", "zz"], 4)]
    found = C.mark_errors(spark.createDataFrame(runs, "doc_id long, run_idx int, content string").repartition(5), spark.createDataFrame(errors, "doc_id long, word string, suggestions array<string>"), 2)
    want = {(d, k, w.lower(), at, at + len(w), "s" + w) for d, k, t in runs for e, w, s in errors if d == e and w for at in occurrences((t or "").lower(), w.lower())}
    assert {(r.doc_id, r.run_idx, r.word, r.start, r.stop, r.suggestions[0]) for r in found.collect()} == want and all(len(r.suggestions) == 2 for r in found.collect())
    assert C.mark_errors(spark.createDataFrame(runs, "doc_id long, run_idx int, content string"), spark.createDataFrame([], "doc_id long, word string, suggestions array<string>")).count() == 0


def test_mixed_texts_are_walked_with_more_than_a_million_words(spark):
    numbered = F.translate(F.lpad(F.col("id").cast("string"), 7, "0"), "0123456789", "我们在北京编辑文档的")
    zh = spark.range(1_000_100).select(numbered.alias("word"), F.lit(1).cast("long").alias("freq")).unionByName(spark.createDataFrame([("的", 1)], "word string, freq long"))
    en = spark.createDataFrame([("word", 9)], "word string, freq long")
    found = C.spell_check(spark.createDataFrame([(1, "我们在北京编辑x wrod 文")], "doc_id long, text string"), "doc_id", "text", {"en": en, "zh": zh}, lang="mixed")
    plan = found.select("doc_id", "word")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and [(r.word, r.lang, r.suggestions) for r in found.collect()] == [("wrod", "en", ["word"])]
