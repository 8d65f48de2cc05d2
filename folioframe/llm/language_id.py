"""Language identification of web pages by fusing Bayesian evidence.

Four kinds of evidence meet in one posterior per page: the likelihood of its visible text under character trigrams,
the language that its markup declares, the address suffix, and a prior of its host. The host's prior is smoothed
towards its suffix's, and that towards the prior of all pages; all three, and how often a declaration is right, are
sums of text posteriors by grouped aggregation, with the page's own vote left out.

Trigram likelihoods are learnt from a bounded sample of labelled documents (SAMPLE of them, by a hash of doc_id, and at
least LEAST of every language that has as many); there are as many languages as labels. Every page is scored over its whole text. Only sums per host are joined back; a host of a third of all pages is one
row, summed in each task first, and broadcast only with the rest if they are few.

Defined results: a page without text, and a null html, rests on the other evidence; a null url has an empty host and
suffix; an unknown or missing declaration says nothing; repeated rows vote each; extra columns are ignored; without
labelled documents there are no languages and no rows; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, broadcast_if_small, checkpoint, let, read
from folioframe.llm.url_filters import host_and_path

#: Labelled documents that likelihoods are learnt from, about; a documented bound, not a limit on what is scored.
SAMPLE = 20_000
LEAST = 20
BUCKETS = 1 << 14
#: Trigrams of one text are far from independent: their log likelihood counts as that of so many at most.
TEXT_WEIGHT = 40.0
#: Strength, in pages, of the parent's prior in its child's, and of the prior that declarations are right.
STRENGTH = 5.0
DECLARED_RIGHT = 0.8

_DROP = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def visible_text(html: str | None) -> str:
    return unescape(_DROP.sub(" ", html or ""))


def trigram_buckets(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text, white space squeezed, a space at either end."""
    b = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def learn_trigrams(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, bucket]) from documents (doc_id, text, lang)."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages, total = sorted(counts), sum(counts.values())
    number = {x: i for i, x in enumerate(languages)}
    if not languages:
        return [], np.empty((0, BUCKETS))
    # Of a language one document in so many, by a hash; of a rare one more than its share.
    steps = {x: max(1, min(-(-total // sample), n // LEAST)) for x, n in counts.items()}
    if max(steps.values()) > 1:
        step = F.create_map(*[F.lit(v) for x in languages for v in (x, steps[x])])[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), step) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [number[lang] * BUCKETS + trigram_buckets(text) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at, n = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at // BUCKETS), pa.array(at % BUCKETS), pa.array(n)], ["lang", "bucket", "n"])

    seen = rows.select("text", "lang").mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), BUCKETS), 0.5)
    table[seen["lang"].to_numpy(), seen["bucket"].to_numpy()] += seen["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def mean_logs(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The mean of each language's logs at the trigrams of a text; a long text's trigrams are counted first."""
    if not len(at):
        return np.zeros(len(table))
    if len(at) <= BUCKETS:
        return table[:, at].mean(axis=1, dtype=np.float64)
    return np.array([row.astype(np.float64) @ np.bincount(at, minlength=BUCKETS) for row in table]) / len(at)


def text_votes(pages: DataFrame, logs: np.ndarray) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, declared, and votes: the text's log likelihood per language, tempered."""
    shared = pages.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    declared = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            said, votes = [], []
            for html in batch.column(2).to_pylist():
                found = declared.search(html or "")
                said.append(found[1].lower() if found else None)
                at = trigram_buckets(visible_text(html))
                votes.append(mean_logs(table, at) * min(len(at), TEXT_WEIGHT))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array([v.tolist() for v in votes], pa.list_(pa.float64()))],
                ["page_id", "url", "declared", "votes"],
            )

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"]).mapInArrow(vote, "page_id long, url string, declared string, votes array<double>")


def _softmax(scores: Column) -> Column:
    shares = lambda e: let(_total(e), lambda t: F.transform(e, lambda x: x / t))
    return let(scores, lambda s: let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp(x - top)), shares)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _sums(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """The posteriors of rows summed by language, an array `name` per group; partial sums, no gathering of rows."""
    sums = [F.sum(F.col("own")[i]).alias(f"_{i}") for i in range(n)]
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(*sums).select(*by, F.array(*[f"_{i}" for i in range(n)]).alias(name))


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def fuse_evidence(voted: DataFrame, languages: list[str], strength: float = STRENGTH) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, probability of pages (page_id, url, declared, votes)."""
    n = len(languages)
    names = F.array(*[F.lit(x) for x in languages])
    host = F.coalesce(host_and_path(voted["url"])[0], F.lit(""))
    rows = voted.withColumn("host", F.regexp_replace(host, r":\d*$", "")).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    rows = checkpoint(rows.withColumn("own", _softmax(F.col("votes"))))
    everything = checkpoint(_sums(rows, [], n, "all_sum"))
    if rows.isEmpty():
        return rows.select("page_id", "host", "suffix", "declared", F.lit("").alias("text_lang"), F.lit("").alias("lang"), F.lit(0.0).alias("probability"))
    total = everything.first()["all_sum"]
    prior = F.array(*[F.lit((v + 1.0) / (sum(total) + n)) for v in total])
    suffixes = broadcast_if_small(checkpoint(_sums(rows, ["suffix"], n, "suffix_sum").withColumnRenamed("suffix", "s")), 100_000)
    hosts = broadcast_if_small(checkpoint(_sums(rows, ["host"], n, "host_sum").withColumnRenamed("host", "h")), 100_000)
    said = broadcast_if_small(checkpoint(_sums(rows.where(F.array_contains(names, F.col("declared"))), ["declared"], n, "said_sum").withColumnRenamed("declared", "d")), 100_000)
    joined = rows.join(hosts, rows["host"] == hosts["h"]).join(suffixes, rows["suffix"] == suffixes["s"]).join(said, rows["declared"] == said["d"], "left")

    def smooth(sums: str, parent: Column) -> Column:
        """The group's sums without this page's, and `strength` pages of the parent's prior."""
        rest = _zip(F.col(sums), F.col("own"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
        return let(rest, lambda r: let(_total(r), lambda mass: _zip(r, parent, lambda x, p: (x + strength * p) / (mass + strength))))

    joined = joined.withColumn("suffix_prior", smooth("suffix_sum", prior)).withColumn("host_prior", smooth("host_sum", F.col("suffix_prior")))
    # How likely this declaration is in a page of each language: counted over the others, and a prior that it is right.
    right = F.transform(names, lambda x: F.when(x == F.col("d"), F.lit(DECLARED_RIGHT)).otherwise((1 - DECLARED_RIGHT) / max(n - 1, 1)))
    others = _zip(F.col("said_sum"), F.col("own"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    of_language = F.array(*[F.lit(float(v)) for v in total])
    declared = _zip(_zip(others, right, lambda x, p: x + strength * p), of_language, lambda x, t: F.log(x / (t + strength)))
    score = _zip(F.col("votes"), F.col("host_prior"), lambda v, p: v + F.log(p))
    score = F.when(F.col("d").isNull(), score).otherwise(_zip(score, declared, lambda x, y: x + y))
    final = joined.withColumn("posterior", _softmax(score)).withColumn("best", F.array_max("posterior"))
    text = F.when(F.array_max("votes") == F.array_min("votes"), F.lit(None)).otherwise(F.get(names, F.array_position("votes", F.array_max("votes")).cast("int") - 1))
    return final.select(
        "page_id", "host", "suffix", "declared", text.alias("text_lang"), F.get(names, F.array_position("posterior", F.col("best")).cast("int") - 1).alias("lang"), F.col("best").alias("probability")
    )


def identify_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    bounded_batches(pages.sparkSession)
    languages, logs = learn_trigrams(labelled)
    if not languages:
        return pages.sparkSession.createDataFrame([], "page_id long, host string, suffix string, declared string, text_lang string, lang string, probability double")
    return fuse_evidence(text_votes(pages, logs), languages)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
