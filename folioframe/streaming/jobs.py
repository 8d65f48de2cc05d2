"""Structured Streaming twins of the incremental operators; each keeps the result of its batch operator."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from folioframe.operators.dictionary import max_distance, upsert_user_words
from folioframe.operators.fuzzy import FuzzyIndex, build_index
from folioframe.operators.sheet import _cut
from folioframe.operators.spelling import misspelt, suggest
from folioframe.operators.validation import recent_k


def stream_user_dict(events: DataFrame, log: str, checkpoint: str) -> DataStreamWriter:
    """Keep a log of dictionary events (op, word, lang, source, inc, ts) as they arrive, a folder for each micro-batch.

    Each batch overwrites its own folder, so one that is run again counts once. user_dict_of folds the log; as the log keeps
    every event, late ones land in their place, and no word's events are ever gathered in one row. A job with another
    checkpoint adds to the log beside the first. `state.user_dict_state` keeps the dictionary itself.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def append(batch: DataFrame, number: int) -> None:
        batch.select("op", "word", "lang", "source", "inc", "ts").write.mode("overwrite").parquet(f"{log}/run={run}/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)


def user_dict_of(spark: SparkSession, log: str) -> DataFrame:
    """The user dictionary that stream_user_dict's log amounts to so far."""
    return upsert_user_words(None, spark.read.parquet(log).drop("run", "batch"))


def stream_spell_check(texts: DataFrame, words: DataFrame, id_col: str, text_col: str, sink, checkpoint: str, n: int = 5, lang: str = "en", index: FuzzyIndex | None = None) -> DataStreamWriter:
    """Check texts as they arrive: each micro-batch is checked as a batch and handed to sink(errors, suggestions, batch).

    index: the kept fuzzy index of words; without one it is built here, once for all micro-batches. A micro-batch's
    errors are found once.
    """
    if index is None:
        built = build_index(words, max_distance(words, lang))
        index = FuzzyIndex(_cut(built.variants), built.distance, built.prefix)

    def check(batch: DataFrame, number: int) -> None:
        errors = _cut(misspelt(batch, id_col, text_col, words, lang=lang))
        sink(errors, suggest(errors.select(F.lower("word").alias("query")), words, n, index.distance, index), number)

    return texts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(check)


def stream_recent(df: DataFrame, owner: str, item: str, ts: str) -> DataFrame:
    """(owner, item, ts): the last time of every item ever, as a streaming aggregate; recent_items reads the k latest from its sink.

    `state.recent_state` keeps k items of each owner only.
    """
    return df.groupBy(owner, item).agg(F.max(ts).alias(ts))


def recent_items(state: DataFrame, owner: str, item: str, ts: str, k: int = 5) -> DataFrame:
    """The k latest items of each owner from what stream_recent wrote."""
    return recent_k(state, owner, item, ts, k)
