"""A fuzzy index that is built once and kept: words by the delete variants of their prefix, with integers that prune pairs.

Two words within a distance share a variant of their first PREFIX characters by as many deletions each, so long words
cost no more than short ones. A variant is kept as a 64-bit hash beside its word, the word's frequency, its length and the parity
of its letters (a bit of 64 for each, turned by every occurrence). An edit changes at most two of those bits and a swap of
neighbours none, so most pairs go by comparing integers, before any distance is computed.

Saved, the index is a table bucketed by the hash: looking words up shuffles the words asked alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.scalar import osa_distance
from folioframe.operators.dictionary import with_variants

PREFIX = 10


@dataclass(frozen=True)
class FuzzyIndex:
    """variants: key, word, freq, size, parity; good for distances up to `distance`."""

    variants: DataFrame
    distance: int
    prefix: int


def _keyed(df: DataFrame, word: str, distance: int, prefix: int) -> DataFrame:
    """df with a row, in column key, for each hash of the variants of a word's prefix by up to so many deletions, none of them empty."""
    found = with_variants(df.withColumn("_prefix", F.substring(word, 1, prefix)), "_prefix", distance, "_variant")
    return found.withColumn("key", F.xxhash64("_variant")).drop("_prefix", "_variant")


def _signed(words: DataFrame, word: str) -> DataFrame:
    """words with size and parity."""
    parity = F.aggregate(F.split(F.col(word), ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))
    return words.withColumn("size", F.length(word)).withColumn("parity", parity)


def build_index(words: DataFrame, distance: int = 2, prefix: int = PREFIX) -> FuzzyIndex:
    """The index of words (word, freq), lazily."""
    if prefix <= distance:
        raise ValueError("the prefix must be longer than the distance")
    own = _signed(words.select("word", "freq").where("word <> ''"), "word")
    return FuzzyIndex(_keyed(own, "word", distance, prefix).select("key", "word", "freq", "size", "parity"), distance, prefix)


def save_index(words: DataFrame, table: str, distance: int = 2, prefix: int = PREFIX, buckets: int = 64, path: str | None = None) -> FuzzyIndex:
    """Build the index of words and keep it as a table, bucketed by key."""
    spark = words.sparkSession
    variants = build_index(words, distance, prefix).variants
    writer = variants.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('distance' = '{distance}', 'prefix' = '{prefix}')")
    return load_index(spark, table)


def load_index(spark: SparkSession, table: str) -> FuzzyIndex:
    """An index that save_index has kept."""
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return FuzzyIndex(spark.table(table), int(properties["distance"]), int(properties["prefix"]))


def _one_swap(a: Column, b: Column) -> Column:
    """The least distance by one swap and plain edits before and behind it, at most one of which shifts it; null without a swap."""
    one = lambda s, i: F.substring(s, i, F.lit(1))
    front = lambda s, i: F.substring(s, F.lit(1), i - 1)
    back = lambda s, i: F.substring(s, i + 2, F.length(s))

    def at(i: Column) -> Column:
        cross = lambda j: (j >= 1) & (j < F.length(b)) & (one(a, i) == one(b, j + 1)) & (one(a, i + 1) == one(b, j))
        return F.transform(F.array(i - 1, i, i + 1), lambda j: F.when(cross(j), F.levenshtein(front(a, i), front(b, j)) + F.levenshtein(back(a, i), back(b, j)) + 1))

    return F.when(F.length(a) > 1, F.array_min(F.flatten(F.transform(F.sequence(F.lit(1), F.length(a) - 1), at))))


def bounded_distance(a: Column, b: Column, apart: Column, distance: int) -> Column:
    """The optimal string alignment distance of a and b, exact up to `distance`, more beyond. apart: differing bits of parity.

    Within two edits, a swap helps where the plain distance is two and the letters are the same, three and the letters nearly
    so, or, by two swaps, three or four and the letters the same; what lies before and behind a swap is compared then, not the whole table filled.
    """
    plain = F.levenshtein(a, b)
    if distance > 2:
        return F.when((plain >= 2) & (apart <= 2 * (distance - 1)), osa_distance(a, b)).otherwise(plain)
    one = _one_swap(a, b)
    # A second swap lies behind the first, so that no letter moves twice.
    n = F.length(a)
    pair = lambda i, j: F.concat(
        F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, j - i - 2), F.substring(a, j + 1, F.lit(1)), F.substring(a, j, F.lit(1)), F.substring(a, j + 2, n)
    )
    two = F.exists(F.sequence(F.lit(1), n - 3), lambda i: F.exists(F.sequence(i + 2, n - 1), lambda j: pair(i, j) == b))
    far = F.when(n > 3, F.when(two, 2)).otherwise(None)
    return (
        F.when(plain <= 1, plain)
        .when((plain == 2) & (apart > 0), plain)
        .when(plain == 2, F.least(plain, F.coalesce(one, plain)))
        .when((distance == 2) & (plain == 3) & (apart <= 2), F.least(plain, F.coalesce(one, plain), F.coalesce(F.when(apart == 0, far), plain)))
        .when((distance == 2) & (plain == 4) & (apart == 0), F.coalesce(far, plain))
        .otherwise(plain)
    )


def look_up(queries: DataFrame, index: FuzzyIndex, distance: int | None = None) -> DataFrame:
    """(query, word, freq, distance) of the index's words within a distance of queries (query), equal words aside.

    Words that share no character are no candidates, as a variant is never empty.
    """
    distance = index.distance if distance is None else distance
    if distance > index.distance:
        raise ValueError(f"the index is good for distances up to {index.distance}")
    asked = _signed(queries.select("query").where("query <> ''").distinct(), "query").withColumnsRenamed({"size": "query_size", "parity": "query_parity"})
    # With as many deletions as the index has, whatever the distance: prefixes of words of different length meet by them.
    asked = _keyed(asked, "query", distance, index.prefix)
    apart = F.bit_count(F.col("parity").bitwiseXOR(F.col("query_parity")))
    met = asked.join(index.variants, "key").where((F.abs(F.col("size") - F.col("query_size")) <= distance) & (F.col("query") != F.col("word")) & (apart <= 2 * distance))
    within = lambda most: F.levenshtein("query", "word", most) >= 0
    # So far can plain edits be apart that swaps bring within the distance.
    near = F.when(apart == 0, within(2 * distance)).when(apart <= 2 * (distance - 1), within(2 * distance - 1)).otherwise(within(distance))
    pairs = met.where(near).select("query", "word", "freq", apart.alias("apart")).distinct()
    return pairs.withColumn("distance", bounded_distance(F.col("query"), F.col("word"), F.col("apart"), distance)).where(F.col("distance") <= distance).drop("apart")
