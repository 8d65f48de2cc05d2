"""Keyed streaming state: late and unordered events, restarts, bounded size, against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioframe.operators.dictionary import upsert_user_words
from folioframe.operators.validation import recent_k
from folioframe.streaming import state as J

START = datetime(2024, 1, 1)
EVENTS = "op string, word string, lang string, source string, inc int, ts timestamp"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    J.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def feed(spark, rows, schema, folder, parts):
    """The rows in files that arrive one by one; returns the stream."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(state, out, check):
    q = J.keep(state, str(out), str(check)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_recent_items_over_restarts(spark, store, tmp_path):
    draw = random.Random(4)
    rows = [(f"o{draw.randint(0, 3)}", f"i{draw.randint(0, 12)}", START + timedelta(minutes=draw.randint(0, 300))) for _ in range(200)] + [("o0", None, START)]
    schema = "owner string, item string, ts timestamp"
    for part in (rows[:90], rows[90:]):
        stream = feed(spark, part, schema, tmp_path / "in", 2)
        run(J.recent_state(stream, "owner", "item", "ts", 3), tmp_path / "out", tmp_path / "check")
    kept = spark.read.parquet(str(tmp_path / "out"))
    want = recent_k(spark.createDataFrame(rows, schema).where("item is not null"), "owner", "item", "ts", 3)
    key = lambda df: sorted(map(tuple, df.select("owner", "item", "ts", "rank").collect()))
    assert key(J.current(kept, ["owner"])) == key(want)
    assert kept.groupBy("owner", "version").count().agg(F.max("count")).first()[0] == 3 and kept.select("batch").distinct().count() == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_user_words_by_events_that_come_late(spark, store, tmp_path, seed):
    """Events up to half an hour out of order, removals among them, in six micro-batches and two runs."""
    draw = random.Random(seed)
    rows = []
    for minute in range(0, 1200, 4):
        at = START + timedelta(minutes=minute + draw.randint(0, 30), seconds=draw.randint(0, 59), microseconds=draw.randint(0, 999_999))
        rows.append((draw.choice(["add"] * 4 + ["remove"]), draw.choice(["cat", " Cat ", "dog", "Dog", "owl"]), draw.choice(["en", "de"]), f"s{draw.randint(0, 99)}", draw.choice([0, 1, 5]), at))
    for part in (rows[:150], rows[150:]):
        stream = feed(spark, part, EVENTS, tmp_path / "in", 3)
        run(J.user_dict_state(stream, "1 hour"), tmp_path / "out", tmp_path / "check")
    kept = spark.read.parquet(str(tmp_path / "out"))
    names = ["word", "lang", "frequency", "source", "created_at", "last_used"]
    # The batch operator keeps the space of a removed word, which is a word of its own there, too.
    got = sorted(map(tuple, J.current(kept, ["word", "lang"]).where("frequency > 0").select(names).collect()))
    assert got == sorted(map(tuple, upsert_user_words(None, spark.createDataFrame(rows, EVENTS)).select(names).collect()))
    # The tail holds what the watermark hasn't passed, not all events of a word.
    most = kept.agg(F.max("n_held")).first()[0]
    assert 0 < most < 60


def test_no_events(spark, store, tmp_path):
    stream = feed(spark, [], EVENTS, tmp_path / "in", 1)
    run(J.user_dict_state(stream), tmp_path / "out", tmp_path / "check")
    assert not (tmp_path / "out").exists() or spark.read.schema("version long").parquet(str(tmp_path / "out")).count() == 0
