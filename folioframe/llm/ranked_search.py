"""Ranked lexical search of many items at once, with the sums that items share computed once.

The items' terms are mined for shared sets: as long as two parts of items occur together in several of them, the pair
that most items have becomes a part of its own, a node of a sharing DAG. A node's accumulator over documents (the sum of
its terms' scores) is made once, from its two parts, and every item that has the node adds it as a whole.

1. Items become (term, repeats) leaves. Blocks of items are mined apart, one task a block; the DAGs are tables.
2. A map-only pass counts, in each document, the terms that any item has; it is stored as rows (doc_id, n, terms, counts).
   The number and length of documents and the terms' document counts are sums over that table.
3. Documents are scored in batches: leaves first, then nodes in the order they were made, then items. A batch
   keeps the best k documents of each item, Spark ranks those again over all batches.

Items are scored in waves of `WAVE_NODES` leaves and nodes, so that what is broadcast is bounded whatever the number of
items; the terms' table is broadcast only if it is small, else documents' terms meet it by a shuffle.

All scores are 64-bit integers; a term's weight is taken from a double once.

Defined results: a null or empty text, or one without terms, is no document (N, L) and scores nothing; an item without
terms, or whose terms no document holds, has no rows; repeated items (the same item_id) are items of their own that share
all sums, and their rows are repeated; repeated documents are ranked apart, equal scores by ascending doc_id, null last;
extra columns are ignored; empty tables give an empty result; texts are read in pieces of a megabyte.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, checkpoint, read, stored
from folioframe.operators.sheet import number_rows

#: A term is a run of ASCII letters and digits and of any other character beyond ASCII (Java and RE2 syntax).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items whose shared sets are mined together.
BLOCK_ITEMS = 256
#: Leaves and nodes that one wave scores; bounds a batch's accumulators and what is broadcast.
WAVE_NODES = 20_000
#: Terms of all items that are broadcast to the counting pass.
BROADCAST_TERMS = 500_000
#: Documents scored together.
BATCH_DOCS = 256
PIECE = 1 << 20

# On UTF-8 bytes the same runs: every byte of a character beyond ASCII is 0x80 or more.
_find = re.compile(TERM.encode()).findall
_stop = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search


def count_terms(text: str) -> Counter:
    """The terms of a text, as bytes, with their counts; a long text is read in pieces that end between terms."""
    raw = text.encode().lower()
    if len(raw) <= PIECE:
        return Counter(_find(raw))
    out, at = Counter(), 0
    while at < len(raw):
        cut = _stop(raw, min(at + PIECE, len(raw)))
        end = cut.start() if cut else len(raw)
        out.update(_find(raw[at:end]))
        at = end + 1
    return out


def terms_of(text: Column) -> Column:
    """Array of the terms of a text, repeats included."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, repeats) of items; item numbers the rows, as ids may repeat."""
    rows = items.select(items[id_col].alias("item_id"), terms_of(items[text_col]).alias("terms")).where("size(terms) > 0")
    rows = checkpoint(rows.withColumn("item", F.monotonically_increasing_id()))
    return rows.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("repeats"))


def mine(items: list[list]) -> tuple[list[tuple[int, int]], list[list[int]], list]:
    """Nodes (left, right), each item's parts, and the leaves, for items given as lists of distinct leaves.

    Parts below len(leaves) are leaves; part len(leaves) + k is node k. The pair that most items have is joined first
    (ties: the earliest parts), until no pair is in two items.
    """
    leaves = sorted({x for item in items for x in item})
    number = {x: i for i, x in enumerate(leaves)}
    parts = [{number[x] for x in item} for item in items]
    owners: dict[tuple[int, int], set[int]] = defaultdict(set)
    # A leaf of one item shares nothing.
    common = {i for i, n in Counter(i for p in parts for i in p).items() if n > 1}
    for k, p in enumerate(parts):
        some = sorted(p & common)
        for i, a in enumerate(some):
            for b in some[i + 1 :]:
                owners[a, b].add(k)
    owners = {pair: o for pair, o in owners.items() if len(o) > 1}
    by_size: dict[int, set] = defaultdict(set)
    for pair, o in owners.items():
        by_size[len(o)].add(pair)
    at_part: dict[int, set] = defaultdict(set)
    for pair in owners:
        at_part[pair[0]].add(pair)
        at_part[pair[1]].add(pair)

    def lose(pair, item):
        """pair is no longer in item."""
        o = owners[pair]
        if item in o:
            by_size[len(o)].discard(pair)
            o.discard(item)
            if len(o) > 1:
                by_size[len(o)].add(pair)

    nodes: list[tuple[int, int]] = []
    size = max(by_size, default=0)
    while size > 1:
        if not by_size[size]:
            size -= 1
            continue
        a, b = min(by_size[size])
        new, have = len(leaves) + len(nodes), set(owners[a, b])
        nodes.append((a, b))
        fresh: dict[int, set[int]] = defaultdict(set)
        for k in have:
            for pair in [p for gone in (a, b) for p in at_part[gone] if k in owners[p]]:
                lose(pair, k)
            parts[k] -= {a, b}
            for other in parts[k]:
                fresh[other].add(k)
            parts[k].add(new)
        for other, o in fresh.items():
            if len(o) > 1:
                pair = (other, new)
                owners[pair] = o
                by_size[len(o)].add(pair)
                at_part[other].add(pair)
                at_part[new].add(pair)
    return nodes, [sorted(p) for p in parts], leaves


def sharing_plans(terms: DataFrame) -> DataFrame:
    """One row a block of items: its items' ids, their parts, the nodes and the leaves (term, repeats)."""

    def run(rows):
        import pandas as pd

        rows = rows.sort_values(["item", "term"])
        items = [(i, g["item_id"].iloc[0], list(zip(g["term"], g["repeats"]))) for i, g in rows.groupby("item", sort=True)]
        nodes, parts, leaves = mine([leaf for _, _, leaf in items])
        return pd.DataFrame([{
            "block": int(rows["block"].iloc[0]), "items": [i for _, i, _ in items], "parts": parts, "left": [a for a, _ in nodes],
            "right": [b for _, b in nodes], "terms": [t for t, _ in leaves], "repeats": [int(r) for _, r in leaves],
        }])

    n = terms.select("item").distinct().count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    keyed = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    id_type = terms.schema["item_id"].dataType.simpleString()
    schema = f"block int, items array<{id_type}>, parts array<array<int>>, left array<int>, right array<int>, terms array<string>, repeats array<long>"
    return checkpoint(keyed.groupBy("block").applyInPandas(run, schema))


def document_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, n, terms, counts): each document with a term, its length, and those of `terms` (term) that it holds, by term_id.

    terms has (term, term_id) and is checkpointed; beyond BROADCAST_TERMS rows it is joined, not broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    small = terms.count() <= BROADCAST_TERMS
    shared = spark.sparkContext.broadcast({r.term.encode(): r.term_id for r in terms.toLocalIterator()} if small else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            ids, lengths, held, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = count_terms(text or "")
                if found:
                    mine = [(wanted[t], c) for t, c in found.items() if t in wanted] if small else list(found.items())
                    ids.append(doc_id)
                    lengths.append(found.total())
                    held.append([t for t, _ in mine])
                    counts.append([c for _, c in mine])
            kind = pa.int32() if small else pa.binary()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(held, pa.list_(kind)), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"]
            )

    if small:
        return stored(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>"))
    every = stored(rows.mapInArrow(run, "doc_id long, n long, terms array<binary>, counts array<long>").withColumn("row", F.monotonically_increasing_id()))
    flat = every.select("row", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("row", F.col("x.terms").cast("string").alias("term"), F.col("x.counts").alias("c"))
    mine = flat.join(terms, "term").groupBy("row").agg(F.collect_list(F.struct("term_id", "c")).alias("x"))
    return stored(
        every.select("row", "doc_id", "n").join(mine, "row", "left")
        .select("doc_id", "n", F.coalesce(F.col("x.term_id"), F.array().cast("array<int>")).alias("terms"), F.coalesce(F.col("x.c"), F.array().cast("array<long>")).alias("counts"))
    )


def term_weights(counted: DataFrame) -> tuple[int, int, DataFrame]:
    """N, L, and (term_id, w) of every counted term that a document holds."""
    n, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("terms").alias("term_id")).groupBy("term_id").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2 * n + 2)) / (F.lit(2) * F.col("df") + 1)))
    return n, length, checkpoint(df.select("term_id", weight.cast("long").alias("w")))


class Evaluator:
    """Scores batches of documents for the items of a wave of plans."""

    def __init__(self, plans: list[dict], weights: dict[int, int], number: dict[str, int], n: int, length: int):
        self.n, self.length, self.items = n, length, [i for p in plans for i in p["items"]]
        leaves = sorted({(number[t], r) for p in plans for t, r in zip(p["terms"], p["repeats"])})
        place = {leaf: i for i, leaf in enumerate(leaves)}
        # Leaves in the order of their terms, and how often each counts.
        self.terms = np.array([t for t, _ in leaves], np.int64)
        self.repeats = np.array([r for _, r in leaves], np.int64)
        self.weight = np.array([weights.get(t, 0) for t, _ in leaves], np.int64)
        self.nodes, self.sums, size = [], [], len(leaves)
        for p in plans:
            own = [place[number[t], r] for t, r in zip(p["terms"], p["repeats"])] + list(range(size, size + len(p["left"])))
            self.nodes += [(own[a], own[b]) for a, b in zip(p["left"], p["right"])]
            self.sums += [[own[x] for x in parts] for parts in p["parts"]]
            size += len(p["left"])
        self.leaves, self.size = len(leaves), size

    def __call__(self, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Scores, items by documents."""
        acc = np.zeros((self.size, len(lengths)), np.int64)
        m = 75 + (25 * lengths * self.n) // self.length
        at = np.repeat(np.arange(len(lengths)), [len(t) for t in terms])
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.int64)
        gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[at])
        low, high = np.searchsorted(self.terms, term), np.searchsorted(self.terms, term, side="right")
        # A term has a leaf for each number of repeats that items have of it, seldom more than one.
        while (more := low < high).any():
            low, high, at, gain = low[more], high[more], at[more], gain[more]
            acc[low, at] = self.repeats[low] * self.weight[low] * gain
            low = low + 1
        for k, (a, b) in enumerate(self.nodes, self.leaves):
            np.add(acc[a], acc[b], out=acc[k])
        return np.stack([acc[parts].sum(axis=0) for parts in self.sums]) if self.sums else np.zeros((0, len(lengths)), np.int64)


def _waves(plans: DataFrame) -> list[list[int]]:
    """Blocks of plans, in waves of bounded size; a block alone may exceed it."""
    out, size = [[]], 0
    for r in plans.select("block", (F.size("terms") + F.size("left")).alias("size")).orderBy("block").toLocalIterator():
        if out[-1] and size + r.size > WAVE_NODES:
            out.append([])
            size = 0
        out[-1].append(r.block)
        size += r.size
    return out


def best_documents(counted: DataFrame, evaluator: Evaluator, id_type: str, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): of each batch of documents the best k of each item of the wave."""
    shared = counted.sparkSession.sparkContext.broadcast(evaluator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate = shared.value
        names = ["item", "item_id", "doc_id", "score"]
        n = len(evaluate.items)
        ids = np.zeros((n, 0), np.int64)
        last, scores = np.zeros((n, 0), bool), np.zeros((n, 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(start, BATCH_DOCS)
                rows = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in part.column(c)]
                new = evaluate(part.column(1).to_numpy(), rows(2), rows(3))
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                own = part.column(0).fill_null(0).to_numpy()
                scores = np.concatenate([scores, new], axis=1)
                ids = np.concatenate([ids, np.broadcast_to(own, new.shape)], axis=1)
                last = np.concatenate([last, np.broadcast_to(null, new.shape)], axis=1)
                order = np.lexsort((ids, last, -scores), axis=1)[:, :k]
                scores, ids, last = (np.take_along_axis(x, order, axis=1) for x in (scores, ids, last))
        item, at = np.nonzero(scores > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array([evaluate.items[i] for i in item], id_arrow), pa.array(ids[item, at], mask=last[item, at]), pa.array(scores[item, at])], names
        )

    id_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    return counted.mapInArrow(run, f"item int, item_id {id_type}, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    terms = checkpoint(item_terms(items))
    plans = sharing_plans(terms)
    numbered = number_rows(terms.select("term").distinct().sort("term"), "term_id")
    numbered = checkpoint(numbered.select("term", F.col("term_id").cast("int").alias("term_id")))
    counted = document_terms(docs, numbered)
    n, length, weights = term_weights(counted)
    id_type = terms.schema["item_id"].dataType.simpleString()
    out = None
    for wave in _waves(plans):
        rows = [r.asDict() for r in plans.where(F.col("block").isin(wave)).collect()]
        wanted = plans.where(F.col("block").isin(wave)).select(F.explode("terms").alias("term")).distinct().join(numbered, "term").join(weights, "term_id", "left")
        known = wanted.collect()
        evaluator = Evaluator(rows, {r.term_id: r.w for r in known if r.w is not None}, {r.term: r.term_id for r in known}, n, length)
        best = best_documents(counted, evaluator, id_type, k).withColumn("wave", F.lit(wave[0] if wave else 0))
        out = best if out is None else out.unionByName(best)
    by_item = Window.partitionBy("wave", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t,
         row_number() OVER () AS rid
  FROM documents),
i AS (
  SELECT item_id, row_number() OVER () AS item,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
items AS (SELECT item, item_id, term, count(*) AS repeats FROM i GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT rid, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs),
g AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS gain FROM tf JOIN w USING (term), totals),
s AS (SELECT item, item_id, rid, doc_id, sum(repeats * gain)::BIGINT AS score FROM items JOIN g USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
