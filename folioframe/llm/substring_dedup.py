"""Substring dedup by line hashing: of equal neighbouring units in the whole corpus, the earliest ranked ones stay.

A unit is a line, cut further at the ends of sentences and after marker words (those whose code points sum to a
multiple of MARKER), so that a passage holds whole units wherever it begins and ends and whatever lines it fills. Every
unit is hashed, together with the next one of its document; a unit of PASSAGE words also by itself. A unit is
normalised: words are runs of characters between ASCII white space, A-Z lower-cased; each character of Chinese,
Japanese, Thai, Lao, Khmer and Burmese is a word of its own. Digests are grouped over all documents with partial sums,
so a line in a third of all documents is one row a task before the shuffle; where its places are sought, they are dealt
to as many tasks as they ask for. What an earlier place has too is repeated;
repeated neighbours are one span, and spans of PASSAGE words or more are removed. A short unit that is alike by chance
is therefore left alone, but none is left out; with a passage of one word every repeated unit goes, as by plain hashes of lines. The spans are returned with their offsets in the original text.

Texts are cut twice, which is cheaper than to keep all units: once for the least doc_id of every digest, once for the
places of those met again.

Defined results: a null or empty text has no units; documents rank by doc_id, null last; rows that share a doc_id, or
have none, lose nothing to one another, so neither does a repeated row; within a document earlier places rank first;
extra columns are ignored; an empty table gives an empty result. A text of any length is taken whole. Digests have 64 bits; a span rests on several of them, so one collision removes nothing by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, broadcast_if_small, checkpoint, let, read
from folioframe.llm.jaccard_join import _mix

#: Words of the shortest span that is removed.
PASSAGE = 25
#: A unit of more windows than this, and than its share of all of them, is dealt to several tasks; such units are so many at most.
HOT_WINDOWS = 20_000
HOT_UNITS = 100_000
#: One word in so many, about, ends a unit.
MARKER = 8
#: Characters that end a sentence.
SENTENCE_ENDS = ".!?…。！？"
#: Code points written without blanks between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_ENDS = np.array([ord(c) for c in SENTENCE_ENDS], np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)[:n]


class Spans:
    """Hashes of any spans of a sequence of hashes: differences of running sums, the power at the start divided out."""

    def __init__(self, values: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)), dtype=np.uint64)])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), len(values) + 1)

    def __call__(self, first: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[first]) * self.inverse[first] + (stop - first).astype(np.uint64), seed)


def hashed_windows(texts: list[str], passage: int, marker: int) -> tuple[np.ndarray, ...]:
    """(text, digest, again, first word, words, start, characters) of every two neighbouring units, and of long units.

    again tells that the text has an equal one before.
    """
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += 32
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[: len(texts)]
    space = (points == 32) | ((points >= 9) & (points <= 13))
    wide = np.zeros(len(points), bool)
    high = np.flatnonzero(points >= UNSPACED[0][0])
    wide[high] = np.any([(points[high] >= lo) & (points[high] <= hi) for lo, hi in UNSPACED], axis=0)
    edge = space | wide
    first = np.flatnonzero(~space & (wide | np.concatenate([[True], edge[:-1]])))
    edges = np.flatnonzero(edge)
    stop = np.where(wide[first], first + 1, edges[np.minimum(np.searchsorted(edges, first, "right"), len(edges) - 1)])
    n = len(first)
    text = np.searchsorted(begins, first, "right") - 1
    sums = np.concatenate([[0], np.cumsum(points, dtype=np.int64)])
    lines = np.cumsum(points == 10)
    last = np.concatenate([text[1:] != text[:-1], np.ones(min(n, 1), bool)])
    ends_line = np.concatenate([lines[first[1:]] > lines[stop[:-1]- 1], np.ones(min(n, 1), bool)])
    cut = last | ends_line | np.isin(points[stop - 1], _ENDS) | ((sums[stop] - sums[first]) % marker == 0)
    to = np.flatnonzero(cut) + 1
    at = np.concatenate([np.zeros(min(n, 1), np.int64), to[:-1]])
    pair = np.flatnonzero(text[at[:-1]] == text[at[1:]]) if len(at) else at
    lone = np.flatnonzero(to - at >= passage)
    w0, w1 = np.concatenate([at[pair], at[lone]]), np.concatenate([to[pair + 1], to[lone]])
    order = np.lexsort((w1, w0))
    w0, w1 = w0[order], w1[order]
    digest = Spans(Spans(points.astype(np.uint64) + _U(1))(first, stop, 1))(w0, w1, 2)
    of = text[w0]
    again = np.ones(len(of), bool)
    again[np.unique(_mix(digest + of.astype(np.uint64) * _U(_BASE), 3), return_index=True)[1]] = False
    begin = np.searchsorted(text, np.arange(len(texts)))
    return of, digest, again, w0 - begin[of], w1 - w0, first[w0] - begins[of], stop[w1 - 1] - first[w0]


def _some_texts(texts: list[str], size: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of slices of about so many characters."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > size or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0


def _strings(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text"))


def text_windows(docs: DataFrame, passage: int = PASSAGE, marker: int = MARKER) -> DataFrame:
    """(doc_id, text_hash, digest, again, w0, words, start, chars) of docs (doc_id, text_hash, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in _some_texts(_strings(batch.column(2))):
                of, digest, again, *places = hashed_windows(texts, passage, marker)
                own = pa.array(row + of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(digest.view(np.int64)), pa.array(again), *[pa.array(p.astype(np.int32)) for p in places]],
                    ["doc_id", "text_hash", "digest", "again", "w0", "words", "start", "chars"],
                )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text_hash", "text").mapInArrow(cut, "doc_id long, text_hash long, digest long, again boolean, w0 int, words int, start int, chars int")


def _joined_runs(found) -> F.Column:
    """Windows (w0, w1, start, stop, first), sorted, as runs of such as overlap or touch."""
    begins = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i)["w0"] > F.get(found, i - 1)["w1"]))

    def run(b, end):
        head, tail = F.get(found, b), F.get(found, end - 1)
        first = F.array_min(F.transform(F.slice(found, b + 1, end - b), lambda x: x["first"]))
        return F.struct(head["start"].alias("start"), tail["stop"].alias("stop"), (tail["w1"] - head["w0"]).alias("n_words"), first["doc_id"].alias("first_doc_id"))

    return let(begins, lambda at: F.transform(at, lambda b, k: run(b, F.coalesce(F.get(at, k + 1), F.size(found)))))


def repeated_spans(docs: DataFrame, passage: int = PASSAGE, marker: int = MARKER) -> DataFrame:
    """One row per removed span: doc_id, text_hash, start, stop (in characters), n_words, first_doc_id (the earliest document that has a part of it)."""
    windows = text_windows(_documents(docs), passage, marker)
    groups = windows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    # Never broadcast: shared units are as many as the corpus is large.
    groups = checkpoint(groups.select(F.col("digest").alias("same"), "first_id", "n"))
    # A unit of very many windows is dealt to parts; there are few of those, whatever the size of the corpus.
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("n") / max(HOT_WINDOWS, total // HOT_UNITS)).cast("int")
    hot = broadcast_if_small(groups.select(F.col("same").alias("hot"), parts.alias("parts")).where("parts > 1"))
    dealt = windows.join(hot, F.col("digest") == F.col("hot"), "left")
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "w0"), F.col("parts"))).cast("int")).drop("hot", "parts")
    copies = groups.select("same", "first_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("of_part"))
    joined = dealt.join(copies.hint("merge"), (F.col("digest") == F.col("same")) & (F.col("part") == F.col("of_part")))
    later = joined.where(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    window = F.struct("w0", (F.col("w0") + F.col("words")).alias("w1"), "start", (F.col("start") + F.col("chars")).alias("stop"), F.struct(F.col("first_id").alias("doc_id")).alias("first"))
    found = later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(window)).alias("found"))
    return found.select("doc_id", "text_hash", F.inline(_joined_runs(F.col("found")))).where(F.col("n_words") >= passage)


def remove_spans(docs: DataFrame, spans: DataFrame, into: str = "removed") -> DataFrame:
    """docs with the spans (doc_id, text_hash, start, stop) cut out of text; a column `into`, replaced if docs has one, keeps their offsets.

    A text without spans is unchanged, with null in `into`. The cut joins what is left as it is, white space included.
    """
    columns = [c for c in docs.columns if c != into]
    cuts = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("__cuts"))
    joined = docs.join(cuts, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left")
    cut = F.col("__cuts")
    # What is kept lies between the end of one span and the start of the next.
    kept = F.transform(cut, lambda x, i: F.substring("text", F.coalesce(F.get(cut, i - 1)["stop"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get(cut, i - 1)["stop"], F.lit(0))))
    tail = F.substr("text", F.element_at(cut, -1)["stop"] + 1)
    text = F.when(cut.isNull(), docs["text"]).otherwise(F.concat(F.array_join(kept, ""), tail))
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in columns], cut.alias(into))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents")).drop("text_hash")


_WIDE = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in UNSPACED)

ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*(?:[{_WIDE}]|[^\x20\x09-\x0D{_WIDE}]+)') AS ps FROM documents),
p AS (SELECT doc_id, ps[i] AS p, i FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM d)),
w AS (SELECT doc_id, i, p, translate(regexp_replace(p, '^[\x20\x09-\x0D]+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
  sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM p),
c AS (SELECT *, contains('{SENTENCE_ENDS}', w[-1:]) OR list_sum(list_transform(string_split(w, ''), lambda x: ord(x))) % {MARKER} = 0
  OR lead(p) OVER (PARTITION BY doc_id ORDER BY i) ~ '(?s)^[\x20\x09-\x0D]*\n.*' AS cut FROM w),
k AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS unit FROM c),
u AS (SELECT doc_id, unit, string_agg(w, ' ' ORDER BY i) AS words, min(i) - 1 AS w0, max(i) AS w1, min(stop - length(w)) AS start, max(stop) AS stop FROM k GROUP BY doc_id, unit),
n AS (SELECT *, lead(words) OVER o AS words2, lead(w1) OVER o AS w2, lead(stop) OVER o AS stop2 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY unit)),
x AS (SELECT doc_id, words || ' ' || words2 AS words, w0, w2 AS w1, start, stop2 AS stop FROM n WHERE w2 IS NOT NULL
  UNION ALL SELECT doc_id, words, w0, w1, start, stop FROM u WHERE w1 - w0 >= {PASSAGE}),
g AS (SELECT *, first(doc_id) OVER o AS d1, first(w0) OVER o AS p1 FROM x WINDOW o AS (PARTITION BY words ORDER BY doc_id, w0)),
l AS (SELECT * FROM g WHERE NOT (doc_id = d1 AND w0 = p1)),
b AS (SELECT *, coalesce(w0 > max(w1) OVER (PARTITION BY doc_id ORDER BY w0, w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS begins FROM l),
r AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY doc_id ORDER BY w0, w1) AS run FROM b)
SELECT doc_id, min(start)::INT AS start, max(stop)::INT AS stop, (max(w1) - min(w0))::INT AS n_words, min(d1) AS first_doc_id
FROM r GROUP BY doc_id, run HAVING max(w1) - min(w0) >= {PASSAGE}
"""
