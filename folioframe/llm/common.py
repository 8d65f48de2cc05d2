"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder in spark.checkpoint.dir; one of our own only in local mode, where driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if configured is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage like a checkpoint, and readers take only the columns that they use."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    # Small row groups, as several tasks of an executor hold one each while they write.
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Narrow rows to a partition, where a checkpointed frame is made compact.
COMPACT_ROWS = 100_000


def compact(df: DataFrame) -> DataFrame:
    """A checkpoint of narrow rows, in as many partitions as its size asks for: a small frame isn't spread over thousands of tasks."""
    done = checkpoint(df)
    return done.coalesce(max(1, -(-done.count() // COMPACT_ROWS)))


def bounded_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Keep Arrow batches short, in rows and in bytes, so that a batch of very long texts still fits a Python worker.

    The session keeps the setting, as Spark reads it when the plan that a caller gets is run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Hint a broadcast for a checkpointed frame of narrow rows if it has at most `rows` rows; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the caller can't clash with ours."""
    return df.select(*[df[n] for n in names])


def let(value: Column, body) -> Column:
    """body(x) with x bound to value once, inside one expression: the optimiser can't copy value into a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node that links reach.

    Alternates large-star and small-star rounds as joins against per-node minima, so a hub's edges are
    never gathered in one row. Each round is checkpointed, in as many partitions as the edges left ask for; only a
    count and a checksum reach the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, size = None, e.count()
    while True:
        parts = max(1, -(-size // COMPACT_ROWS))
        e = e.coalesce(parts)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").coalesce(parts)
        e = checkpoint(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(parts).distinct().coalesce(parts)
        )
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen, size = now, now[0]
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
