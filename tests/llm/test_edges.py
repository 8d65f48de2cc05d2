"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import byte_bpe, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, quality_classifier, quality_rules, substring_dedup, url_filters

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000)) + "\n" + "tail " * 70_000
ROWS = [
    (1, "a b c d e f g h i j", "en", "s", 19), (2, None, "en", "s", 0), (3, "", None, None, None), (None, "a b c d e f g h i j", "fr", None, 1), (5, "   \n\t ", "en", "t", 6),
    (6, LONG, "en", "t", len(LONG)), (6, LONG, "en", "t", len(LONG)), (7, "A B c d e f g h i j", "de", "s", 19), (8, "é 漢字 🎉 \x00 x", "es", "u", 9),
]
CLASH = ["digest", "set_id", "token", "size", "target", "copies", "quality", "block", "bucket", "row", "host", "train", "kept", "group_size", "hash", "plan_source", "n"]


@pytest.fixture(scope="module", params=["rows", "empty", "clashing"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if request.param == "empty":
        return df.limit(0)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if request.param == "clashing" else df


def test_dedup(docs):
    got = exact_dedup.dedup_report(docs).collect()
    assert len(got) == docs.count()
    if got:
        assert sum(r.kept for r in got) == 6
        assert {(r.doc_id, r.keep_id) for r in got if r.group_size == 2} == {(1, 1), (None, 1), (2, 3), (3, 3), (6, 6)}
    kept = exact_dedup.drop_duplicate_texts(docs)
    assert kept.columns == docs.columns and kept.count() == (6 if got else 0)


def test_jaccard(docs):
    got = jaccard_join.near_duplicate_components(docs).collect()
    assert len(got) == docs.count()
    if got:
        by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
        assert by[1] == (6, 1) and by[None] == (6, 1) and by[7] == (6, 1) and by[2] == (0, 2) and by[5] == (0, 5) and by[6][1] == 6 and by[8] == (1, 8)


def test_mixing(docs):
    rows = docs.select("doc_id", "source", "text")
    mixed = mixing.apply_mix(docs, mixing.plan_mix(rows, mixing.word_count(rows["text"])))
    assert mixed.count() == docs.count()
    out = mixing.mixing_stage(docs.sparkSession, docs, "")
    assert out.columns == docs.columns and out.where("n_chars is null").count() <= 3


def test_rules(docs):
    out = quality_rules.quality_stage(docs.sparkSession, docs, "")
    assert out.columns == docs.columns
    q = docs.select("doc_id", quality_rules.quality(docs["text"]).alias("q")).select("doc_id", "q.*").collect()
    assert all(r.base_failed and not r.kept for r in q if r.doc_id in (1, 2, 3, 5))
    assert all(r.n_words == 100_000 and r.n_repeat_words >= 70_000 for r in q if r.doc_id == 6)


def test_scores(docs):
    got = lm_scoring.score_texts(docs.withColumn("train", F.col("doc_id") != 7)).collect()
    assert len(got) == docs.count() and all(r.score < 0 and r.base_score < 0 for r in got)
    model = quality_classifier.learn_quality(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert all(0 <= r.score <= 1 for r in quality_classifier.score_documents(docs, model).collect())


def test_units(docs):
    spans = substring_dedup.repeated_spans(docs)
    # The text of repeated words repeats itself, in one document however often it is there; the short ones are no passages.
    found = {(r.doc_id, r.first_doc_id) for r in spans.collect()}
    assert found <= {(6, 6)}
    left = substring_dedup.remove_spans(docs, spans)
    assert left.count() == docs.count() and left.columns == [*docs.columns, "removed"]
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100))
    cut = {r.doc_id: r.text for r in substring_dedup.remove_spans(more, substring_dedup.repeated_spans(more)).collect()}
    assert not cut or (len(cut[106]) < 1000 < len(cut[6]) and cut[107] == "A B c d e f g h i j")


def test_encoding(docs):
    import public_tokenizers as P

    got = byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert len(got) == docs.count() and all(r.decoded == texts[r.doc_id] and len(r.ids) == r.n_tokens for r in got)


def test_pages(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.lit(None).cast("string").alias("html"))
    assert all(r.verdict == "allow" and r.host == "" for r in url_filters.judge_urls(pages).collect())
    got = language_id.identify_languages(pages, docs).collect()
    assert len(got) == docs.count() and all(r.lang in ("en", "fr", "de", "es") for r in got)
    assert language_id.identify_languages(pages, docs.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    columns, out = docs.columns, docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, out, "").write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert out.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, out, "").count() == out.count()
