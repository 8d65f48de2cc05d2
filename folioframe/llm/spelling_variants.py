"""Spelling variants of a corpus: words within one edit, by an index of variable-length grams.

Words are counted over whole texts (a task folds its own counts first). Then

1. A gram dictionary is built from the words: grams longer than two are kept only where their prefix is frequent and they
   are common themselves, so frequent short grams give way to longer ones and no list of the index is needlessly long.
2. A word, with a mark at either end, is decomposed: at each place the longest gram of the dictionary, unless an earlier
   one covers it.
3. For each word the most grams that one edit can affect is bounded: those that the edit touches, and those beside it
   that a gram of the dictionary across the edit could cover. Near words share all other grams, at the same distance from
   the start (left of the edit) or from the end (right of it).
4. So each word is entered in its rarest lists only, one more than the bound, and those lists are merged: two near words
   meet in one of them. Pairs of about equal length are verified by the edit distance.

Words whose bound is no smaller than their number of grams can only be missed together; those are indexed again with
plain grams of two, where an edit affects two of at least seven. A list of over `HOT` words is merged by halves: of two
words within an edit, either the front or the back half of the shorter is in both.

Defined results: a null or empty text has no words; a null doc_id counts as empty in the hash of a run; repeated rows
count each time; extra columns are ignored; an empty table gives an empty result; a word without near words has n_near 0
and is its own root; of near words with the same count the first in code-point order is the form; texts of any length
are read whole, in pieces of a megabyte, and counts leave a task whenever it holds `HELD_WORDS`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, broadcast_if_small, checkpoint, read, stored

RUN = r"[A-Za-zÀ-ÿ]+"
#: Fixed values of the contract: the hash that deletes a code point, the least length and count, the ratio of a form.
DELETE_EVERY, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 199, 6, 5, 5
#: Grams have so many code points; those of the least length need no entry in the dictionary.
SHORT_GRAM, LONG_GRAM = 2, 4
#: A gram's extensions are kept where it has over one in so many of all grams; at most eight times as many are kept.
DICTIONARY_SHARE = 50_000
#: Least count of a gram whose extensions are kept.
LEAST_FREQUENT = 50
#: Words of a list that is merged as a whole.
HOT = 1000
#: Distinct words that a counting task holds.
HELD_WORDS = 500_000
PIECE = 1 << 20
FRONT, BACK = "^", "$"

# Shorter runs can't give a word of the least length.
_long_runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH).findall
_stop = re.compile(r"[^A-Za-zÀ-ÿ]").search


def runs_of(text: str) -> Counter:
    """The runs of letters of a text that are long enough, A-Z lower-cased, with their counts."""
    out, at = Counter(), 0
    while at < len(text):
        cut = _stop(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        out.update(_long_runs(text[at:end].encode().lower().decode()))
        at = end + 1
    return out


def damaged(doc_id: int | None, run: str) -> str:
    """The run, without one code point if the hash of its document and itself says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DELETE_EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of docs (doc_id, text): words of the least length that occur at least so often overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def leave() -> Iterator[pa.RecordBatch]:
            words = list(held)
            for k in range(0, len(words), 50_000):
                some = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[w] for w in some], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r, n in runs_of(text or "").items():
                    word = damaged(doc_id, r)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield from leave()
        yield from leave()

    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_dictionary(words: DataFrame) -> set[str]:
    """The longer grams of words (word) that are worth a list of their own.

    A gram is kept if its prefix has over `frequent` occurrences and it has over an eighth of that itself; as all
    grams together are DICTIONARY_SHARE times `frequent` at most, no more than 8 x DICTIONARY_SHARE are kept.
    """
    marked = F.concat(F.lit(FRONT), "word", F.lit(BACK))
    grams = words.select(marked.alias("w")).select(
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(SHORT_GRAM), F.lit(LONG_GRAM)),
                    lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - q + 1, F.lit(1))), lambda p: F.substring("w", p, q)),
                )
            )
        ).alias("gram")
    )
    counts = checkpoint(grams.groupBy("gram").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = max(LEAST_FREQUENT, total // DICTIONARY_SHARE)
    common = counts.where((F.col("n") * 8 > frequent) & (F.length("gram") > SHORT_GRAM))
    parents = counts.where(F.col("n") > frequent).select(F.col("gram").alias("prefix"))
    kept = common.join(parents, F.expr("substring(gram, 1, length(gram) - 1)") == F.col("prefix"), "left_semi").select("gram")
    return {r.gram for r in kept.toLocalIterator()}


class GramIndex:
    """Decomposes words into variable-length grams and bounds what an edit affects."""

    def __init__(self, dictionary: set[str]):
        self.grams = dictionary
        self.starts = {g[:k] for g in dictionary for k in range(1, len(g))}
        self.ends = {g[k:] for g in dictionary for k in range(1, len(g))}

    def decompose(self, s: str) -> list[tuple[int, str]]:
        """(place, gram) by place: the longest gram at each place that no earlier gram covers."""
        out, reach = [], 0
        for p in range(len(s) - SHORT_GRAM + 1):
            size = SHORT_GRAM
            for q in range(min(LONG_GRAM, len(s) - p), SHORT_GRAM, -1):
                if s[p : p + q] in self.grams:
                    size = q
                    break
            if p + size > reach:
                reach = p + size
                out.append((p, s[p:reach]))
        return out

    def affected(self, s: str, parts: list[tuple[int, str]]) -> int:
        """The most grams of s that one edit between its marks can affect."""
        spans = [(p, p + len(g)) for p, g in parts]
        # left[i]: the first place from where a gram could reach across a change at i; right[i]: how far one that starts before i could reach.
        left, right = list(range(len(s) + 1)), list(range(len(s) + 1))
        for i in range(1, len(s)):
            for k in range(min(LONG_GRAM - 1, i), 1, -1):
                if s[i - k : i] in self.starts:
                    left[i] = i - k
                    break
            for k in range(min(LONG_GRAM - 1, len(s) - i), 1, -1):
                if s[i : i + k] in self.ends:
                    right[i] = i + k
                    break
        most = 0
        for i in range(1, len(s)):
            # A code point put in before i; one replaced or deleted at i, which the closing mark isn't.
            for after in (i, i + 1)[: 1 + (i < len(s) - 1)]:
                n = 0
                for a, b in spans:
                    if b <= i:
                        n += a >= left[i]
                    elif a >= after:
                        n += b <= right[after]
                    else:
                        n += 1
                most = max(most, n)
        return most


def _grams(words: DataFrame, dictionary: set[str]) -> DataFrame:
    """(word, bound, grams) of words (word): the places and grams of each, and the most that an edit affects."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GramIndex(shared.value)
        for batch in batches:
            bounds, places, grams = [], [], []
            for word in batch.column(0).to_pylist():
                s = FRONT + word + BACK
                parts = index.decompose(s)
                bounds.append(index.affected(s, parts))
                places.append([p for p, _ in parts])
                grams.append([g for _, g in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bounds, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.string()))], ["word", "bound", "places", "grams"]
            )

    return words.select("word").mapInArrow(run, "word string, bound int, places array<int>, grams array<string>")


def _postings(words: DataFrame) -> DataFrame:
    """(list, word, size, parity) of words (word, bound, places, grams): each in its rarest lists, as many as its bound asks for.

    A list is a gram with its distance from the start or from the end. All of a word's entries of one gram stay
    together, so that near words which share a gram share it whole.
    """
    flat = words.select("word", "bound", F.size("grams").alias("n"), F.explode(F.arrays_zip("places", "grams")).alias("x"))
    flat = flat.select("word", "bound", "n", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"))
    lengths = checkpoint(flat.groupBy("gram").agg(F.count("*").alias("in_list")))
    ranked = flat.join(broadcast_if_small(lengths), "gram").groupBy("word", "bound", "n").agg(F.sort_array(F.collect_list(F.struct("in_list", "gram", "place"))).alias("x"))
    # The last gram that must be entered; with a bound of all grams, every one.
    last = F.element_at("x", F.least(F.col("bound") + 1, F.col("n")))
    # A bit of 64 for each letter, turned by every occurrence: an edit turns two at most.
    parity = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))
    kept = ranked.select("word", parity.alias("parity"), F.filter("x", lambda g: F.struct(g["in_list"], g["gram"]) <= F.struct(last["in_list"], last["gram"])).alias("x"))
    one = kept.select("word", F.length("word").alias("size"), "parity", F.explode("x").alias("x"))
    return one.select("word", "size", "parity", F.explode(F.array(F.xxhash64("x.gram", F.lit("<"), "x.place"), F.xxhash64("x.gram", F.lit(">"), F.col("size") - F.col("x.place")))).alias("list"))


def _halves(size: str, word: str):
    """What two words within an edit must share one of: for both lengths that the shorter may have, its front and its back half."""
    keys = []
    for length in (F.col(size) - 1, F.col(size)):
        half = F.floor(length / 2).cast("int")
        keys += [F.xxhash64(F.lit("<"), length, F.substring(F.col(word), F.lit(1), half)), F.xxhash64(F.lit(">"), length, F.right(F.col(word), length - half))]
    return F.array(*keys)


def _merged(postings: DataFrame) -> DataFrame:
    """(a, b) of different words in a common list that are within an edit; a comes first in code-point order.

    Pairs are verified where they meet, most by the parity of their letters alone. A long list is merged by halves of its words.
    """
    counts = checkpoint(postings.groupBy("list").agg(F.count("*").alias("in_list")).where(F.col("in_list") > HOT))
    hot = broadcast_if_small(counts.select("list"))
    parts = [
        (postings.join(hot, "list", "left_anti"), ["list"]),
        (postings.join(hot, "list", "left_semi").withColumn("half", F.explode(_halves("size", "word"))), ["list", "half"]),
    ]
    out = None
    for entries, keys in parts:
        left = entries.select(*keys, F.col("word").alias("a"), F.col("size").alias("la"), F.col("parity").alias("pa"))
        right = entries.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("word").alias("b"), F.col("size").alias("lb"), F.col("parity").alias("pb"))
        same = [F.col(k) == F.col(f"_{k}") for k in keys]
        met = left.join(right, [*same, F.col("a") < F.col("b"), F.abs(F.col("la") - F.col("lb")) <= 1, F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 2])
        near = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")
        out = near if out is None else out.unionByName(near)
    return out


def near_words(words: DataFrame, dictionary: set[str] | None = None) -> DataFrame:
    """(a, b), a before b, of the words (word, each once) that differ by exactly one code point put in, deleted or replaced."""
    grams = stored(_grams(words, gram_dictionary(words) if dictionary is None else dictionary))
    pairs = _merged(stored(_postings(grams)))
    # Two words of which an edit may affect every gram: again, with grams of two.
    open_words = grams.where(F.col("bound") >= F.size("grams")).select("word")
    if not open_words.isEmpty():
        pairs = pairs.unionByName(_merged(stored(_postings(stored(_grams(open_words, set()))))))
    return pairs.distinct()


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = stored(words)
    near = stored(near_words(words))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("near_n"))
    # The largest count, and of those the first word: the smallest of (-n, word).
    best = both.join(counts, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("b").alias("word"))).alias("best"))
    joined = words.join(best.select(F.col("a").alias("word"), "n_near", F.col("best.word").alias("near"), (-F.col("best.minus")).alias("near_n")), "word", "left")
    is_form = F.col("near_n") >= FORM_RATIO * F.col("n")
    rows = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    # A form has five times the count of its word, so chains are short; each turn doubles the steps taken.
    roots = checkpoint(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = roots.join(ahead, F.col("root") == F.col("_word"), "left")
        roots = checkpoint(further.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        moved = not roots.where("moved").isEmpty()
        roots = roots.select("word", "root")
        if not moved:
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(read(spark, sf_dir, "documents")))


# The hash is CRC-32, byte by byte over a table that is made first; near words meet by what they are without one code point.
ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda s, b: xor(s // 256, t[(xor(s, b) % 256) + 1]))) AS h
  FROM k, tab),
w AS (
  SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
p AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (
  SELECT x.word AS u, y.word AS v FROM p x JOIN p y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT p.word, w.word FROM p JOIN w ON w.word = p.a || p.b UNION SELECT w.word, p.word FROM p JOIN w ON w.word = p.a || p.b),
near AS (SELECT u, v, w.n AS vn, row_number() OVER (PARTITION BY u ORDER BY w.n DESC, encode(v)) AS k, count(*) OVER (PARTITION BY u) AS n_near FROM e JOIN w ON w.word = v),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN vn >= 5 * w.n THEN v END AS form, CASE WHEN vn >= 5 * w.n THEN vn END AS form_n FROM w LEFT JOIN near ON u = w.word AND k = 1),
up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word) JOIN f g ON g.word = up.root AND g.form IS NULL
"""
