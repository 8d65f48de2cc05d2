"""Mixing sources to target weights by capped water-filling, and sampling whole and fractional repetitions.

A source's target is its weighted share of the budget, but at most max_epochs times its size; what capped sources
leave is shared among the rest by weight until none is above.

A source whose target is e times its size gives floor(e) copies of every document and one more of some, taken in
the order of a seeded hash until the fraction is met. Documents of a source are summed in hash bins first, so a
source with a third of all rows costs no more in one task than its bins, whose number follows the table's; only the
bin where the fraction ends is sorted by document. What remains is one cut of the hash per source, so texts are never
shuffled. Sources may be as many as hosts: they are ranked over range partitions, and levels are sums over them.

Defined results: a null source is a source of its own, last in order; a null text has size 0; a null doc_id is hashed
as an empty string; rows of one doc_id are taken alike; a source without words
gets target 0 and gives none; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import broadcast_if_small, checkpoint, read, word_count
from folioframe.operators.sheet import number_rows

MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents that share a hash bin, about, if all are of one source: the bin where a fraction ends is sorted in one task.
BIN_ROWS = 100_000


def water_fill(sources: DataFrame, budget: Column | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size, weight) with target: min(cap, level * weight), summing to the budget (default: all sizes).

    Sources whose share exceeds their cap are clamped to it, and what they leave is shared anew by weight among the rest,
    until none exceeds its cap. Each turn is one sum over the sources; only the level reaches the driver.
    """
    s = sources.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    total = s.agg((F.sum("source_size") if budget is None else F.max(budget)).alias("v")).first()["v"] or 0
    clamped, level = -1, None
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("cap")
        caps = F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0))
        found = s.agg(F.count_if(over).alias("n"), caps.alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("weights")).first()
        if found["n"] <= clamped:
            break
        clamped, level = found["n"], (total - found["caps"]) / found["weights"] if found["weights"] else None
        if level is None:
            break
    share = F.col("cap").cast("double") if level is None else F.lit(float(level)) * F.col("weight")
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), share).alias("target"))


def ranked_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ... cycle, repeating, by the code point order of source, null last."""
    ranked = number_rows(sources.orderBy(F.col("source").asc_nulls_last()), "_rank")
    return ranked.withColumn("weight", F.pmod("_rank", F.lit(cycle)) + 1).drop("_rank")


def _order_hash(docs: DataFrame, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(f"|{seed}")))


def plan_mix(docs: DataFrame, size: Column, seed: str = SEED, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source of docs (doc_id, source): source_size, target, whole (copies of each document), cut.

    Documents whose hash is at most cut get one copy more. The cut is the hash at which the sizes so far, with half
    of that document's, are still within the fraction; a null cut gives none.
    """
    order = _order_hash(docs, seed)
    digits, rows = 3, docs.count()
    while rows > BIN_ROWS * 16**digits:
        digits += 1
    bins = checkpoint(docs.groupBy("source", F.substring(order, 1, digits).alias("bin")).agg(F.sum(size).alias("bin_size")))
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    s = water_fill(ranked_weights(sizes), max_epochs=max_epochs)
    s = s.withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) + 1e-9))
    s = checkpoint(s.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    part = s.select(F.col("source").alias("s"), "part")
    edges = bins.join(part, bins["source"].eqNullSafe(part["s"])).where("part > 1e-6 and before < part and before + bin_size > part")
    edges = broadcast_if_small(checkpoint(edges.select(F.col("s").alias("edge_source"), F.col("bin").alias("edge"), F.col("before").alias("edge_before"), "part")))
    at_edge = docs.join(edges, docs["source"].eqNullSafe(edges["edge_source"]) & (F.substring(order, 1, digits) == edges["edge"]))
    at_edge = at_edge.select("edge_source", "edge", "edge_before", "part", order.alias("hash"), size.alias("size"))
    inside = Window.partitionBy("edge_source").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = at_edge.withColumn("here", F.col("edge_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cuts = at_edge.groupBy(F.col("edge_source").alias("cut_source")).agg(F.max(F.when(F.col("here") + F.col("size") / 2 <= F.col("part"), F.col("hash"))).alias("in_edge"))
    # Without a document of the edge bin, or without an edge bin, the cut is the end of the last bin before.
    full = bins.join(part, bins["source"].eqNullSafe(part["s"])).where("part > 1e-6 and before + bin_size <= part")
    full = full.groupBy(F.col("s").alias("full_source")).agg(F.concat(F.max("bin"), F.lit("g")).alias("in_full"))
    s = s.join(cuts, s["source"].eqNullSafe(cuts["cut_source"]), "left").join(full, s["source"].eqNullSafe(full["full_source"]), "left")
    return checkpoint(s.select("source", "source_size", "target", "whole", F.coalesce("in_edge", "in_full").alias("cut")))


def apply_mix(docs: DataFrame, plan: DataFrame, seed: str = SEED, prefix: str = "mix_") -> DataFrame:
    """docs with mix_source_size, mix_target and mix_copies: a join by source with the plan, which is broadcast if it is small.

    Columns of these names that docs already has, from an earlier mix, are replaced.
    """
    own = broadcast_if_small(plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns]), 100_000)
    extra = F.coalesce((_order_hash(docs, seed) <= own["__cut"]).cast("long"), F.lit(0))
    made = {"source_size": own["__source_size"], "target": own["__target"], "copies": (own["__whole"] + extra).cast("long")}
    kept = [docs[c] for c in docs.columns if c.removeprefix(prefix) == c or c.removeprefix(prefix) not in made]
    return docs.join(own, docs["source"].eqNullSafe(own["__source"])).select(*kept, *[v.alias(prefix + c) for c, v in made.items()])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = apply_mix(docs, plan_mix(docs, word_count(docs["text"])))
    sized = mixed.select("doc_id", word_count(mixed["text"]).alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), "mix_copies")
    return sized.select("doc_id", "size", "source_size", "target", (F.col("mix_copies") * F.col("size")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = apply_mix(docs, plan_mix(docs, word_count(docs["text"])), prefix="__mix_")
    copies = F.when(F.col("__mix_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))
    return mixed.withColumn("__mix_copy", F.explode(copies)).select(*[mixed[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || '|mix-1') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS here FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(max(here) FILTER (here * weight <= cap) OVER () * weight, cap)) AS target FROM l),
p AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-9) AS whole FROM t),
r AS (SELECT d.doc_id, d.size, source_size, target, whole, target - whole * source_size AS part,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT *, CASE WHEN before + size / 2 <= part AND part > 0 THEN 1 ELSE 0 END AS extra FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + extra))::BIGINT AS taken FROM b
"""
