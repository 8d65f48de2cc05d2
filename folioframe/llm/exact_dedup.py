"""Exact deduplication of a new batch against immutable snapshots.

A snapshot is indexed once, into tables of the shared folder: one row per distinct digest (its copies counted), and a
static binary-fuse filter per digest shard, about nine bits a digest. Digests of an incoming batch are grouped among themselves first, so
a text with a million copies is one digest. The filters screen those digests; only positives join the snapshot's
exact bucket, where the texts themselves are compared byte by byte.

Every shuffle carries digests, not texts; the byte check moves the texts of positive representatives only.
Shards follow the digest, which is uniform whatever the data; a snapshot's are as many as its digests ask for, and a
larger batch is cut further, each part meeting the filter of its shard.

Defined results: a null text equals an empty one; a null doc_id is smaller than any other; of rows with the same
doc_id and text one stays; extra columns are ignored by the report and kept by drop_duplicate_texts; empty tables
give empty results. Very long texts are hashed where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import broadcast_if_small, checkpoint, read, stored

#: Digests that one shard's filter holds, about; bounds the memory of a building or screening task.
SHARD_DIGESTS = 1_000_000
LEAST_SHARDS = 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BinaryFuseFilter:
    """Three-wise binary fuse filter with 8-bit fingerprints over 64-bit keys."""

    def __init__(self, seed: int, segment: int, windows: int, prints: np.ndarray):
        self.seed, self.segment, self.windows, self.prints = seed, segment, windows, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, windows: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots in adjacent segments, and the fingerprint, of each key."""
        h = _mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(windows * segment)) >> np.uint64(32)
        inside = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & inside)
        third = (first + np.uint64(2 * segment)) ^ (h & inside)
        return np.stack([first, second, third]).astype(np.int64), (_mix(h, 77) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        windows = max(1, int(np.ceil(n * factor / segment)) - 2)
        for seed in range(1, 1000):
            if seed % 20 == 0:
                windows += 1 + windows // 10
            slots, prints = cls._slots(keys, seed, segment, windows)
            order = cls._peel(slots, (windows + 2) * segment)
            if order is not None:
                table = np.zeros((windows + 2) * segment, np.uint8)
                for which, at in reversed(order):
                    table[at] = 0
                    table[at] = prints[which] ^ table[slots[0, which]] ^ table[slots[1, which]] ^ table[slots[2, which]]
                return cls(seed, segment, windows, table)
        raise ValueError("no seed peels these keys")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot that each owns alone); keys of one round don't touch each other's slots."""
        count = np.bincount(slots.ravel(), minlength=size)
        mixed = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(mixed, row, np.arange(slots.shape[1]))
        order, left, alone = [], slots.shape[1], np.flatnonzero(count == 1)
        while len(alone):
            which, at = np.unique(mixed[alone], return_index=True)
            order.append((which, alone[at]))
            left -= len(which)
            touched = slots[:, which]
            np.subtract.at(count, touched.ravel(), 1)
            np.bitwise_xor.at(mixed, touched.ravel(), np.tile(which, 3))
            near = np.unique(touched)
            alone = near[count[near] == 1]
        return None if left else order

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.windows)
        return self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]] == prints

    def to_row(self) -> dict:
        return {"seed": self.seed, "segment": self.segment, "windows": self.windows, "prints": self.prints.tobytes()}

    @classmethod
    def from_row(cls, row) -> BinaryFuseFilter:
        return cls(int(row.seed), int(row.segment), int(row.windows), np.frombuffer(row.prints, np.uint8))


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per digest of (doc_id, digest) rows: its copies, and the largest doc_id, which represents it."""
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.max("doc_id").alias("top_id"))


def _keyed(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("key", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")).withColumn(
        "shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    )


def snapshot_filters(groups: DataFrame, shards: int) -> DataFrame:
    """One binary-fuse filter per shard of a snapshot's digests."""

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        row = BinaryFuseFilter.build(keys["key"].to_numpy(np.int64).view(np.uint64)).to_row()
        return pd.DataFrame([{"shard": int(keys["shard"].iloc[0]), **row}])

    keyed = _keyed(groups, shards).select("shard", "key")
    return keyed.groupBy("shard").applyInPandas(build, "shard int, seed int, segment int, windows int, prints binary")


def screen(groups: DataFrame, filters: DataFrame, shards: int, parts: int = 1) -> DataFrame:
    """The incoming digests that a snapshot's filters let through: every one it has, and about one in 256 of the rest.

    The digests of a shard are dealt to so many parts, each with a copy of the shard's filter.
    """

    def positives(keys: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or keys.empty:
            return keys[["digest", "copies", "top_id"]].head(0)
        hit = BinaryFuseFilter.from_row(rows.iloc[0]).contains(keys["key"].to_numpy(np.int64).view(np.uint64))
        return keys.loc[hit, ["digest", "copies", "top_id"]]

    keyed = _keyed(groups, shards).withColumn("part", F.pmod(F.shiftright("key", 8), F.lit(parts)).cast("int"))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (
        keyed.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))
        .applyInPandas(positives, "digest binary, copies long, top_id long")
    )


@dataclass(frozen=True)
class Snapshot:
    """An immutable snapshot: its rows (doc_id, digest, text), and tables of its digests' groups and of its filters."""

    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    shards: int


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), text_digest(df[text_col]).alias("digest"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def index_snapshot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Index a snapshot once; any number of batches can be screened against it."""
    rows = _rows(docs, id_col, text_col)
    groups = stored(digest_groups(rows))
    shards = max(LEAST_SHARDS, -(-groups.count() // SHARD_DIGESTS))
    return Snapshot(rows, groups, stored(snapshot_filters(groups, shards)), shards)


def _same_bytes(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of pairs (digest, new_id, old_id) whose representatives' texts are equal, byte for byte.

    texts (doc_id, digest, text) is joined by id and digest, the ids broadcast only if they are few.
    """
    ids = pairs.select(F.col("new_id").alias("doc_id"), "digest").unionByName(pairs.select(F.col("old_id").alias("doc_id"), "digest")).distinct()
    ids = broadcast_if_small(checkpoint(ids.withColumnsRenamed({"doc_id": "want_id", "digest": "want"})))
    found = texts.join(ids, texts["doc_id"].eqNullSafe(ids["want_id"]) & (texts["digest"] == ids["want"])).select("doc_id", "digest", "text")
    found = found.dropDuplicates(["digest", "doc_id"])
    new = found.select(F.col("digest").alias("d1"), F.col("doc_id").alias("i1"), F.col("text").alias("t1"))
    old = found.select(F.col("digest").alias("d2"), F.col("doc_id").alias("i2"), F.col("text").alias("t2"))
    return (
        pairs.join(new, (F.col("digest") == F.col("d1")) & F.col("new_id").eqNullSafe(F.col("i1")))
        .join(old, (F.col("digest") == F.col("d2")) & F.col("old_id").eqNullSafe(F.col("i2")))
        .where("t1 = t2")
        .select("digest", "new_copies", "new_id", "old_copies", "old_id")
    )


def dedup_batch(snapshots: Snapshot | Sequence[Snapshot], batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts over snapshots and a new batch: (digest, keep_id, group_size), one row per distinct text.

    Of several snapshots, none holds a text of another: each was a batch once.
    """
    held = [snapshots] if isinstance(snapshots, Snapshot) else list(snapshots)
    new_rows = _rows(batch, id_col, text_col)
    new = checkpoint(digest_groups(new_rows))
    n = new.count()
    every, matched = new, None
    for old in held:
        passed = screen(new, old.filters, old.shards, max(1, -(-n // (old.shards * SHARD_DIGESTS))))
        pairs = checkpoint(
            passed.withColumnsRenamed({"copies": "new_copies", "top_id": "new_id"})
            .join(old.groups.withColumnsRenamed({"copies": "old_copies", "top_id": "old_id"}), "digest")
            .select("digest", "new_copies", "new_id", "old_copies", "old_id")
        )
        same = _same_bytes(pairs, old.rows.unionByName(new_rows))
        matched = same if matched is None else matched.unionByName(same)
        every = every.unionByName(old.groups)
    whole = lambda df: df.select("digest", F.col("top_id").alias("keep_id"), F.col("copies").alias("group_size"))
    if matched is None:
        return whole(new)
    matched = checkpoint(matched)
    joined = matched.select("digest", F.greatest("new_id", "old_id").alias("keep_id"), (F.col("new_copies") + F.col("old_copies")).alias("group_size"))
    return joined.unionByName(whole(every.join(matched.select("digest"), "digest", "left_anti")))


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table that comes at once, split into a snapshot and a later batch by a hash of doc_id."""
    later = F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), F.lit(2)) == 1
    return docs.where(~later), docs.where(later)


def _repeats(docs: DataFrame) -> DataFrame:
    """Groups of two or more only, checkpointed; every other row is its own group."""
    snapshot, batch = halves(docs)
    return checkpoint(dedup_batch(index_snapshot(snapshot), batch).where("group_size > 1"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    groups = broadcast_if_small(_repeats(docs))
    rows = docs.select("doc_id", text_digest(docs["text"]).alias("digest"))
    joined = rows.join(groups, "digest", "left").select(
        "doc_id",
        "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )
    # Rows that are alike in doc_id and text are told apart by their number alone, so they are counted and written out again.
    again = (
        joined.where("group_size > 1 and doc_id <=> keep_id")
        .groupBy("doc_id", "digest", "keep_id", "group_size")
        .agg(F.count("*").alias("n"))
        .select("doc_id", "digest", "keep_id", "group_size", F.posexplode(F.sequence(F.lit(1).cast("long"), "n")).alias("i", "one"))
        .select("doc_id", "digest", "keep_id", "group_size", (F.col("i") == 0).alias("kept"))
    )
    rest = joined.where("group_size = 1 or not doc_id <=> keep_id").withColumn("kept", F.col("group_size") == 1)
    return rest.unionByName(again).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicate_texts(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest doc_id; all columns stay."""
    columns = docs.columns
    groups = _repeats(docs.select("doc_id", "text")).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__n"))
    groups = broadcast_if_small(groups)
    rows = docs.withColumn("__own", text_digest(docs["text"]))
    rows = rows.join(groups, rows["__own"] == groups["__digest"], "left").where(F.col("__n").isNull() | rows["doc_id"].cast("long").eqNullSafe(F.col("__keep")))
    copies = checkpoint(rows.where("__n is not null").groupBy("doc_id", "__own").count().where("count > 1").select(F.col("__own").alias("__rare")))
    if copies.isEmpty():
        return rows.select(*columns)
    rare = broadcast_if_small(copies)
    plain = rows.join(rare, rows["__own"] == rare["__rare"], "left_anti")
    alike = rows.join(rare, rows["__own"] == rare["__rare"], "left_semi").dropDuplicates(["__own"])
    return plain.select(*columns).unionByName(alike.select(*columns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(read(spark, sf_dir, "documents"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicate_texts(docs)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rid) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
