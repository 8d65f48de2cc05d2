"""N-gram Jaccard join by multiple-global-order prefix filtering.

Two sets of similarity t or more share a token among the first n - ceil(t n) + 1 tokens of each, under any order
that both follow. Here several orders are used: in each, tokens that are known to be frequent come last, by
classes of their counts, and a different hash orders the tokens of a class. Candidates meet in a bucket of a
prefix token under the first order; the prefixes under all orders must then share as many tokens as the sizes ask for,
before a text is fetched and compared in full. The orders affect the work only, never the result.

What keeps this in bounds:
* equal sets are one node; their documents are joined to it at the end;
* counts of frequent tokens are gathered from all documents, each task summing what it sees, and only the list of
  the most frequent (FREQUENT_LIMIT at most) is broadcast, to sort by;
* a pair counts in a bucket only if its token comes early enough in both sets for their sizes to be similar: a set with
  many tokens of its own is in few pairs, however many copies share the rest;
* buckets with the same members are one bucket;
* links are sought in rounds: everyone in a bucket is compared with one member, components are formed, and members
  of different components go on, each round with another member. What is left after the rounds is compared pair by
  pair, but never within a component. So a bucket of copies costs its size, not its square, and no link is lost.

Defined results: a null or empty text has an empty set and is linked with nothing; a null doc_id takes part and
counts as none in the smallest doc_id; repeated rows share a set; extra columns are ignored; an empty table gives an
empty result. Sets are compared by 64-bit hashes of shingles, and are told apart by a 64-bit hash of the whole set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, broadcast_if_small, checkpoint, compact, connected_components, read, stored

SHINGLE_WORDS = 5
PERCENT = 80
#: Token orders; the first one makes candidates, all filter them.
ORDERS = 3
#: Tokens of this count or more are sorted by class of count; at most so many are broadcast, the most frequent.
FREQUENT_COUNT = 8
FREQUENT_LIMIT = 2_000_000
#: Rounds of one against all in each bucket, before what is left is compared pair by pair.
STAR_ROUNDS = 2


_U = np.uint64


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + _U((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_BASE = 0x9E3779B97F4A7C15
_EMPTY = np.empty(0, np.uint64)


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes. Words: A-Z lower-cased, split at ASCII white space.

    Works on slices of texts at once: a word's hash is a difference of running sums of bytes times powers of an odd
    base, with the power at the word's start divided out.
    """

    def __init__(self, words: int = SHINGLE_WORDS, slice_bytes: int = 500_000):
        self.words, self.slice_bytes, self.powers, self.inverse = words, slice_bytes, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers, self.inverse = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _U(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64))
            )

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        found, held, size = [], [], 0
        for text in texts:
            held.append(text or b"")
            size += len(held[-1])
            if size > self.slice_bytes:
                found += self._slice(held)
                held, size = [], 0
        return found + self._slice(held)

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in order, and the number of words up to the end of each text."""
        data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        if not len(data):
            return _EMPTY, np.zeros(0, np.int64)
        self._grow(len(data) + 1)
        edge = np.diff(_BLANK[data], prepend=True)
        starts, stops = np.flatnonzero(edge).reshape(-1, 2).T
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * self.powers[: len(data)], out=sums[1:])
        return _mix((sums[stops] - sums[starts]) * self.inverse[starts]), np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))

    def word_hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in order, and the number of the text that each is in."""
        h, at = self._words(texts)
        return h, np.repeat(np.arange(len(texts)), np.diff(at, prepend=0))

    def _slice(self, texts: list[bytes]) -> list[np.ndarray]:
        h, at = self._words(texts)
        rolled = self._roll(h, self.words) if len(h) >= self.words else _EMPTY
        found, first = [], 0
        for last in at.tolist():
            if last - first >= self.words:
                s = np.sort(rolled[first : last - self.words + 1])
                found.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:
                found.append(self._roll(h[first:last], last - first) if last > first else _EMPTY)
            first = last
        return found

    @staticmethod
    def _roll(h: np.ndarray, size: int) -> np.ndarray:
        rolled = np.zeros(len(h) - size + 1, np.uint64)
        for i in range(size):
            rolled = rolled * _U(0xD6E8FEB86659FD93) + h[i : i + len(rolled)]
        return _mix(rolled, size)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with another to reach the similarity."""
    return -(-percent * n // 100)


def pair_overlap(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


class TokenOrder:
    """Sort keys of tokens: the class of a frequent token's count, then a hash that differs by order."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray):
        self.tokens, self.classes = tokens, classes
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[tokens >> _U(44)] = True

    def prefix(self, shingles: np.ndarray, order: int, percent: int) -> np.ndarray:
        """Keys of the first tokens, in order; a key stands for its token."""
        size = len(shingles) - least_overlap(len(shingles), percent) + 1 if len(shingles) else 0
        key = _mix(shingles, 100 + order) >> _U(6)
        few = np.flatnonzero(self.maybe[shingles >> _U(44)])
        if len(few):
            at = np.minimum(np.searchsorted(self.tokens, shingles[few]), len(self.tokens) - 1)
            key[few] |= np.where(self.tokens[at] == shingles[few], self.classes[at], 0).astype(np.uint64) << _U(58)
        return np.sort(np.partition(key, size - 1)[:size]) if size else key


def _binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def frequent_tokens(docs: DataFrame, words: int, least: int = FREQUENT_COUNT, limit: int = FREQUENT_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in many distinct sets and the classes of their counts, from all documents. Each task passes on what it saw twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, held, size = Shingler(words), set(), [], 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

        for batch in batches:
            for s in shingler(_binary(batch.column(0))):
                if len(s) and (own := set_id(s)) not in seen:
                    seen.add(own)
                    held.append(s)
                    size += len(s)
                if size > 4_000_000:
                    yield flush()
                    held, size, seen = [], 0, set()
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = checkpoint(counted.withColumn("class", F.floor(F.log2("n")).cast("int")))
    # Whole classes from the top, as many as fit the limit: at most 64 rows tell which.
    sizes, lowest, room = {r["class"]: r["count"] for r in counted.groupBy("class").count().collect()}, 64, limit
    for c in sorted(sizes, reverse=True):
        if sizes[c] > room:
            break
        lowest, room = c, room - sizes[c]
    top = counted.where(F.col("class") >= lowest).select("token", "n").toArrow()
    tokens = top["token"].to_numpy().view(np.uint64)
    by = np.argsort(tokens)
    return tokens[by], np.minimum(np.log2(np.maximum(top["n"].to_numpy()[by], 1)).astype(np.int64), 31)


def _sets(docs: DataFrame, order, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_id, and for the first row of a set in each task its prefix under the first order and under the others."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, tokens = Shingler(words), set(), TokenOrder(*order.value)
        for batch in batches:
            sizes, ids, prefixes, others = [], [], [], tuple([] for _ in range(1, ORDERS))
            for s in shingler(_binary(batch.column(1))):
                own = set_id(s) if len(s) else None
                sizes.append(len(s))
                ids.append(own)
                known = own is None or own in seen
                prefixes.append(None if known else tokens.prefix(s, 0, percent).view(np.int64))
                # Of the other orders, whose tokens only need to be met, half of each key is kept.
                for k, other in enumerate(others, 1):
                    other.append(None if known else tokens.prefix(s, k, percent).astype(np.uint32).view(np.int32))
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                    *[pa.array(other, pa.list_(pa.int32())) for other in others],
                ],
                ["doc_id", "n_shingles", "set_id", "prefix", *[f"prefix_{k}" for k in range(1, ORDERS)]],
            )

    return docs.mapInArrow(shingle, "doc_id long, n_shingles long, set_id long, prefix array<long>, " + ", ".join(f"prefix_{k} array<int>" for k in range(1, ORDERS)))


def _buckets(sets: DataFrame) -> DataFrame:
    """(bucket, set_id, n, pos): sets that share a prefix token and its place in each; of buckets with the same members the first by order."""
    emitted = sets.where("prefix is not null")
    twice = compact(emitted.groupBy("set_id").agg(F.count("*").alias("times"), F.min("row").alias("first")).where("times > 1"))
    repeated = broadcast_if_small(twice.select(F.col("set_id").alias("again"), "first"))
    # Of a set that several tasks emitted, one row is used.
    once = emitted.join(repeated, F.col("set_id") == F.col("again"), "left").where(F.col("first").isNull() | (F.col("row") == F.col("first")))
    rows = once.select("set_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("set_id")).alias("members")).where("size > 1")
    shared = shared.groupBy("size", "members").agg(F.min("token").alias("bucket"))
    kept = broadcast_if_small(compact(shared.select("bucket")))
    return compact(rows.join(kept, rows["token"] == kept["bucket"]).select("bucket", "set_id", "n", "pos"))


def _ids(pairs: DataFrame) -> DataFrame:
    """The set_ids of pairs (a, b), broadcast where they are joined if they are few."""
    return broadcast_if_small(compact(pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()))


def _overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough under the first order, and meet early enough under every other.

    Beyond the prefix that ends first, no more can be shared than it leaves; the first token that a similar pair shares
    lies so early in both, in any order, that all they need to share can come after it.
    """
    orders = range(1, ORDERS)
    own = sets.where("prefix is not null").join(_ids(pairs), "set_id", "left_semi").dropDuplicates(["set_id"])
    left = own.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col("prefix").alias("pa"), *[F.col(f"prefix_{k}").alias(f"pa_{k}") for k in orders])
    right = own.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("prefix").alias("pb"), *[F.col(f"prefix_{k}").alias(f"pb_{k}") for k in orders])
    both = pairs.join(left, "a").join(right, "b")
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)).cast("int")
    left_over = F.when(F.element_at("pa", -1) <= F.element_at("pb", -1), F.col("na") - F.size("pa")).otherwise(F.col("nb") - F.size("pb"))
    both = both.where(F.size(F.array_intersect("pa", "pb")) + left_over >= need)
    early = lambda side, k: F.slice(f"p{side}_{k}", F.lit(1), (F.col(f"n{side}") - need + 1).cast("int"))
    for k in orders:
        both = both.where(F.arrays_overlap(early("a", k), early("b", k)))
    return both.select("a", "b")


def _texts(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(set_id, text) of every set of the pairs (a, b): one document's text for each."""
    wanted = _ids(pairs)
    firsts = sets.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("at"))
    few = broadcast_if_small(compact(firsts.select(F.col("at.doc_id").alias("want_doc")).distinct()))
    texts = docs.join(few, docs["doc_id"].eqNullSafe(few["want_doc"])).select(docs["text"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            ids = [set_id(s) if len(s) else None for s in shingler(_binary(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0)], ["set_id", "text"])

    named = texts.mapInArrow(name, "set_id long, text string")
    return named.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # A hub's text is often beside several partners' here.
            text = dict(zip(a, _binary(batch.column(2)), strict=True)) | dict(zip(b, _binary(batch.column(3)), strict=True))
            sets = dict(zip(text, shingler(list(text.values())), strict=True))
            linked = []
            for x, y in zip(a, b, strict=True):
                s, t = sets[x], sets[y]
                common = len(np.intersect1d(s, t, assume_unique=True))
                if common and 100 * common >= percent * (len(s) + len(t) - common):
                    linked.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.int64()) for i in (0, 1)], ["a", "b"])

    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def set_components(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(set_id, root) of every set that is linked with another."""
    buckets = _buckets(sets)
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    tested, roots, before = links, links.select(F.col("a").alias("set_id"), F.col("b").alias("root")), 0
    for turn in range(STAR_ROUNDS + 1):
        now = buckets.join(roots, "set_id", "left").select("bucket", F.struct("set_id", "n", "pos", F.coalesce("root", "set_id").alias("root")).alias("s"))
        # The first hub is the set where the token comes earliest: that with the least of its own; later ones are drawn.
        first = F.floor(1000 * F.col("s.pos") / F.col("s.n")) if turn == 0 else F.lit(0)
        hub = F.min(F.struct(first, F.xxhash64("s.set_id", F.lit(turn)), "s"))
        mixed = now.groupBy("bucket").agg(F.min("s.root").alias("low"), F.max("s.root").alias("high"), hub.alias("hub"))
        mixed = mixed.where("low < high").select("bucket", F.col("hub.s").alias("t"))
        if turn < STAR_ROUNDS:
            met = now.join(mixed, "bucket")
        else:
            left = now.join(mixed.select("bucket"), "bucket", "left_semi")
            met = left.join(left.select("bucket", F.col("s").alias("t")), "bucket").where("s.set_id < t.set_id")
        need = F.ceil(percent * (F.col("s.n") + F.col("t.n")) / (100 + percent))
        early = (F.col("s.pos") <= F.col("s.n") - need) & (F.col("t.pos") <= F.col("t.n") - need)
        near = met.where((F.col("s.root") != F.col("t.root")) & early)
        late = F.floor(1000 * F.col("t.pos") / F.col("t.n")) if turn == 0 else F.lit(0)
        pairs = near.select(F.col("s.set_id").alias("s"), F.least("s.set_id", "t.set_id").alias("a"), F.greatest("s.set_id", "t.set_id").alias("b"), late.alias("late"))
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if turn < STAR_ROUNDS:
            # Each set goes to one hub a round: the earliest hub, or the least by this round's hash, to which most of its kind go.
            by_hub = F.struct("late", F.xxhash64(F.when(F.col("s") == F.col("a"), F.col("b")).otherwise(F.col("a")), F.lit(turn)), "a", "b")
            pairs = pairs.groupBy("s").agg(F.min(by_hub).alias("p")).select("p.a", "p.b")
        pairs = compact(pairs.select("a", "b").distinct())
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        near = compact(_overlapping(pairs, sets, percent))
        links = compact(links.unionByName(_verify(near, _texts(docs, sets, near, words), words, percent)))
        count = links.count()
        if count > before:
            roots = compact(connected_components(links).withColumnsRenamed({"node": "set_id", "component": "root"}))
        before = count
    return roots


def named_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, and set_id (null if empty), of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    order = spark.sparkContext.broadcast(frequent_tokens(docs, words))
    sets = stored(_sets(docs, order, words, percent).withColumn("row", F.monotonically_increasing_id()))
    roots = set_components(docs, sets, words, percent)
    linked = sets.select("set_id", "doc_id").join(roots, "set_id", "left").where("set_id is not null")
    firsts = linked.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("root").alias("root"))
    lone = firsts.where("root is null").select(F.col("set_id").alias("own"), F.col("first").alias("component"))
    some = firsts.where("root is not null")
    low = some.groupBy("root").agg(F.min("first").alias("component"))
    named = some.join(low, "root").select(F.col("set_id").alias("own"), "component").unionByName(lone)
    return sets.join(named, sets["set_id"] == named["own"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("own").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "set_id"
    )


def near_duplicate_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return named_components(docs, words, percent).drop("set_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(read(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id; the rest of a null doc_id stay.

    Rows go by doc_id; where a doc_id has rows that go and rows that stay, the text decides.
    """
    found = named_components(docs)
    gone = compact(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("set_id").alias("gone_set")).distinct())
    stays = found.where("doc_id = component_id").select(F.col("doc_id").alias("mixed_id"))
    mixed = compact(stays.join(broadcast_if_small(gone.select("gone_id").distinct()), F.col("mixed_id") == F.col("gone_id"), "left_semi").distinct())
    whole = broadcast_if_small(compact(gone.join(mixed, F.col("gone_id") == F.col("mixed_id"), "left_anti").select("gone_id").distinct()))
    rest = docs.join(whole, docs["doc_id"] == whole["gone_id"], "left_anti")
    if mixed.isEmpty():
        return rest

    @F.pandas_udf("long")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([set_id(s) if len(s) else None for s in Shingler(SHINGLE_WORDS)([(t or "").encode() for t in texts])], dtype="Int64")

    few = broadcast_if_small(mixed)
    sure = rest.join(few, rest["doc_id"] == few["mixed_id"], "left_anti")
    unsure = rest.join(few, rest["doc_id"] == few["mixed_id"], "left_semi").withColumn("__set", set_of(rest["text"]))
    judged = unsure.join(gone, (unsure["doc_id"] == gone["gone_id"]) & (unsure["__set"] == gone["gone_set"]), "left_anti").drop("__set")
    return sure.unionByName(judged)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r(doc_id, low) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.low) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
