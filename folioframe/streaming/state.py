"""Streaming jobs whose results are kept as keyed state: current after each micro-batch, bounded in size, restartable.

Each job emits, in update mode, the whole entry of every key that a micro-batch touched, with a version that rises;
`current` takes the latest version of each key from what a sink holds. State is kept by Spark (RocksDB, which the
session must name as its state store), so a restart from the checkpoint goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Name the state store that keyed state needs, for the session's queries to come."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class RecentItems(StatefulProcessor):
    """The k latest distinct items of an owner, by the last time of each, ties by item.

    An item that falls out can come back only by a later event, so k items are all that is kept.
    """

    def __init__(self, owner: str, item: str, ts: str, k: int, expiry_ms: int | None):
        self.owner, self.item, self.ts, self.k, self.expiry = owner, item, ts, k, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One list, the version in each row: a key is read once and written once, as each call to the store is a round trip.
        self.items = handle.getListState("items", "item string, ts timestamp, version long", self.expiry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, version = {}, 1
        for item, ts, old in self.items.get():
            held[item], version = ts, old + 1
        for batch in rows:
            for item, ts in zip(batch[self.item], batch[self.ts], strict=True):
                if item not in held or ts > held[item]:
                    held[item] = ts
        best = sorted(held.items(), key=lambda x: (-pd.Timestamp(x[1]).value, x[0]))[: self.k]
        self.items.put([(item, ts, version) for item, ts in best])
        yield pd.DataFrame({self.owner: [key[0]] * len(best), self.item: [i for i, _ in best], self.ts: [t for _, t in best], "rank": pd.array(range(1, len(best) + 1), "int32"), "version": version})

    def close(self) -> None:
        pass


def recent_state(events: DataFrame, owner: str, item: str, ts: str, k: int = 5, expiry_ms: int | None = None) -> DataFrame:
    """(owner, item, ts, rank, version): of each owner that a micro-batch touched, its k latest items then.

    expiry_ms: an owner without events for so long is forgotten. A null item or time takes no part.
    """
    kind = dict(events.dtypes)[owner]
    rows = events.select(owner, F.col(item).cast("string").alias(item), F.col(ts).cast("timestamp").alias(ts)).where(F.col(item).isNotNull() & F.col(ts).isNotNull())
    return rows.groupBy(owner).transformWithStateInPandas(
        statefulProcessor=RecentItems(owner, item, ts, k, expiry_ms),
        outputStructType=f"`{owner}` {kind}, `{item}` string, `{ts}` timestamp, rank int, version long",
        outputMode="Update",
        timeMode="ProcessingTime" if expiry_ms else "None",
    )


class UserWord(StatefulProcessor):
    """A word of the user dictionary: the sum since its last removal, and a tail of recent events that late ones may cut.

    The tail has a row for each distinct time: events that the watermark has passed are folded into the sum, as none that
    arrives now can come before them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "n long, source string, created timestamp, used timestamp, version long")
        # A list that is read and written whole, once for a key of a micro-batch: each call to the store is a round trip.
        self.tail = handle.getListState("tail", "at timestamp, n long, source string, removed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail = {at: (n, source, removed) for at, n, source, removed in self.tail.get()}
        held = bool(tail)
        for batch in rows:
            for op, at, name, inc in zip(batch["op"], batch["ts"], batch["source"], batch["inc"], strict=True):
                n, source, gone = tail.get(at, (0, None, False))
                if op == "remove":
                    tail[at] = (n, source, True)
                else:
                    # Of additions at one time, the source that comes first by name is the first.
                    names = [x for x in (source, name) if isinstance(x, str)]
                    tail[at] = (n + int(inc), min(names, default=None), gone)
        state = self.base.get()
        base = list(state) if state else [0, None, None, None, 0]
        mark = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        entry, done = list(base), []
        for at in sorted(tail):
            n, source, removed = tail[at]
            # A removal outdoes additions of the same time.
            if removed:
                entry[:4] = [0, None, None, None]
            elif n:
                entry[:4] = [entry[0] + n, entry[1] if entry[0] else source, entry[2] if entry[0] else at, at]
            if at < mark:
                base[:4], done = list(entry[:4]), [*done, at]
        for at in done:
            del tail[at]
        if tail:
            self.tail.put([(at, *value) for at, value in tail.items()])
        elif held:
            self.tail.clear()
        version = base[4] + 1
        self.base.update((base[0], base[1], base[2], base[3], version))
        yield pd.DataFrame({
            "word": [key[0]], "lang": [key[1]], "frequency": pd.array([entry[0]], "int64"), "source": [entry[1]], "created_at": pd.to_datetime([entry[2]]), "last_used": pd.to_datetime([entry[3]]),
            "version": [version], "n_held": pd.array([len(tail)], "int32"),
        })

    def close(self) -> None:
        pass


def user_dict_state(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(word, lang, frequency, source, created_at, last_used, version, n_held): the entry of each word that a micro-batch touched.

    events: op (add or remove), word, lang, source, inc, ts, in any order within the delay; later ones are dropped. The entry is
    what the batch operator makes of all events so far; a removed word's frequency is 0. n_held is the size of its tail.
    """
    add = F.col("op") == "add"
    keyed = events.select(
        F.when(add, F.lower(F.trim("word"))).otherwise(F.lower("word")).alias("word"), "lang", "op", "source", F.when(F.col("inc") > 0, F.col("inc")).otherwise(1).cast("long").alias("inc"), F.col("ts").cast("timestamp").alias("ts")
    ).where("word <> '' and ts is not null")
    return keyed.withWatermark("ts", delay).groupBy("word", "lang").transformWithStateInPandas(
        statefulProcessor=UserWord(),
        outputStructType="word string, lang string, frequency long, source string, created_at timestamp, last_used timestamp, version long, n_held int",
        outputMode="Update",
        timeMode="EventTime",
    )


def keep(state: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Write what a job emits to a folder, each micro-batch to one of its own, so that one that is run again counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def current(kept: DataFrame, keys: list[str]) -> DataFrame:
    """The latest version of each key's rows."""
    last = Window.partitionBy(*keys)
    return kept.withColumn("_last", F.max("version").over(last)).where("version = _last").drop("_last", "version", "batch")
