"""The kept fuzzy index against distances of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.functions.scalar import osa_distance
from folioframe.operators import fuzzy as Z
from folioframe.operators import spelling as C
from folioframe.operators.dictionary import deletes_index
from folioframe.plans import catalog_text
from folioframe.streaming import jobs as J


def osa(a: str, b: str) -> int:
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def variants(word: str, distance: int) -> set[str]:
    found = level = {word}
    for _ in range(distance):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w)) if len(w) > 1}
        found = found | level
    return found


def vocabulary(seed: int) -> list[str]:
    draw = random.Random(seed)
    words = {"".join(draw.choices("abcé", k=draw.randint(1, 6))) for _ in range(120)} | {"abcabcabcab" + "".join(draw.choices("abz", k=draw.randint(0, 4))) for _ in range(25)}
    for w in sorted(words):
        for _ in range(draw.choice([0, 1, 2])):
            k = draw.randrange(len(w))
            w = draw.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + w[k + 1 : k + 2] + w[k] + w[k + 2 :]]) or w
        words.add(w)
    return sorted(words)


@pytest.mark.parametrize("distance,prefix", [(2, 10), (2, 4), (1, 10), (1, 3), (3, 6)])
def test_every_pair_within_the_distance_is_found(spark, distance, prefix):
    names = vocabulary(distance * 10 + prefix)
    half = names[::2]
    words = spark.createDataFrame([(w, i) for i, w in enumerate(half)], "word string, freq long")
    queries = spark.createDataFrame([(w,) for w in [*names, ""]], "query string")
    got = {(r["query"], r.word): (r.distance, r.freq) for r in Z.look_up(queries, Z.build_index(words, distance, prefix)).collect()}
    own = {w: variants(w, distance) for w in names}
    want = {(q, w): (osa(q, w), i) for q in names for i, w in enumerate(half) if q != w and osa(q, w) <= distance and own[q] & own[w]}
    assert got == want


def test_bounded_distance_is_the_tables(spark):
    names = [w for w in vocabulary(5) if len(w) < 8][:90]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    bounded = Z.bounded_distance(F.col("a"), F.col("b"), F.lit(0), 2)
    rows = pairs.select("a", "b", bounded.alias("x"), osa_distance(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r.x == r.y if r.y <= 2 else r.x > 2 for r in rows) and all(r.y == osa(r.a, r.b) for r in rows)


def test_a_kept_index_is_read_without_a_shuffle(spark, tmp_path):
    names = vocabulary(9)
    words = spark.createDataFrame([(w, i) for i, w in enumerate(names)], "word string, freq long")
    queries = spark.createDataFrame([(w + "a",) for w in names], "query string")
    Z.save_index(words, "kept_words", 2, buckets=4, path=str(tmp_path / "kept"))
    kept = Z.load_index(spark, "kept_words")
    assert (kept.distance, kept.prefix) == (2, Z.PREFIX)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(C.suggest(queries, words, 3, 2, kept).collect()) == key(C.suggest(queries, words, 3, 2).collect())
    assert key(C.suggest(queries, words, 3, 1, kept).collect()) == key(C.suggest(queries, words, 3, 1).collect())
    with pytest.raises(ValueError):
        Z.look_up(queries, kept, 3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = Z.look_up(queries, kept)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    scan = plan[plan.index("kept_words") - 400 : plan.index("kept_words")]
    assert "Bucketed: true" in plan and "Exchange" not in scan


def test_ranks_of_candidates_are_those_of_the_index(spark):
    names = vocabulary(11)
    words = spark.createDataFrame([(w, i % 7) for i, w in enumerate(names[::2])], "word string, freq long")
    queries = spark.createDataFrame([(w,) for w in names[1::2]], "query string")
    by_variants = C.rank_candidates(C.fuzzy_candidates(queries, deletes_index(words, 2), 2), 4, 2)
    assert sorted(map(tuple, by_variants.collect())) == sorted(map(tuple, C.suggest(queries, words, 4, 2).collect()))


def test_variants_are_made_in_batches_without_lambdas(spark):
    """Each once, for short, repeating, empty and missing words, with the words' other columns; none of it in interpreted array functions."""
    names = ["", "a", "aa", "ab", "éaé", "汉字汉", "abcabcabcd"]
    words = spark.createDataFrame([(i, w) for i, w in enumerate([*names, None])], "n int, word string")
    for distance in (0, 1, 2, 3):
        made = deletes_index(words, distance)
        want = sorted((i, w, v) for i, w in enumerate(names) for v in variants(w, distance))
        rows = [tuple(r) for r in made.collect()]
        assert sorted(r for r in rows if r[1] is not None) == want and [r for r in rows if r[1] is None] == [(len(names), None, None)]
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert made.columns == ["n", "word", "delete"] and "MapInArrow" in plan and "lambda" not in plan


LONG_LIST = 50_001


def test_suggestions_do_not_change_as_the_list_grows(spark):
    """A word two edits away is suggested from a long list, too."""
    words = spark.range(LONG_LIST).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).cast("long").alias("freq")).unionByName(spark.createDataFrame([("correction", 9)], "word string, freq long"))
    docs = spark.createDataFrame([(1, "corectoin w7 corecton")], "doc_id long, text string")
    found = C.spell_check(docs, "doc_id", "text", {"en": words}, n=3).collect()
    assert sorted((r.word, r.suggestions) for r in found) == [("corectoin", ["correction"]), ("corecton", ["correction"])]


def test_streamed_suggestions_do_not_change_as_the_list_grows(spark, tmp_path):
    words = spark.range(LONG_LIST).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).cast("long").alias("freq")).unionByName(spark.createDataFrame([("correction", 9)], "word string, freq long"))
    spark.createDataFrame([(1, "corectoin w7 corecton")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    texts, got = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/docs"), []
    sink = lambda errors, suggestions, number: got.extend((r["query"], r.word, r.distance) for r in suggestions.collect())
    J.stream_spell_check(texts, words, "doc_id", "text", sink, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [("corectoin", "correction", 2), ("corecton", "correction", 2)]


def test_the_query_of_a_spell_check_suggests(spark):
    """Each misspelt word has up to eight corrections, those of the operator."""
    found = {r.word: r.suggestions.split(",") for r in catalog_text.QUERIES["spell_check"](spark, "/root/testdata/sf0.001").collect()}
    few = sorted(found)[::97]
    ranked = C.suggest(spark.createDataFrame([(w.lower(),) for w in few], "query string"), catalog_text.corpus_words(spark, "/root/testdata/sf0.001"), 8).orderBy("rank").collect()
    assert found == found | {w: [r.word for r in ranked if r["query"] == w.lower()] or [""] for w in few}
    assert max(map(len, found.values())) == 8
