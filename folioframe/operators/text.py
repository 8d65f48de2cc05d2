"""Text operators: tokens, script runs, CJK segmentation, counts, find and replace."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.plans.batches import ROWS, made_rows, parts

#: CJK ranges of the token rule, and the wider one of segmentation.
CJK = r"㐀-䶿一-鿿"
CJK_WIDE = r"㐀-䶿一-鿿豈-﫿"
_TOKEN = rf"[A-Za-z0-9][A-Za-z0-9'-]*|[{CJK}]"


def placed_matches(df: DataFrame, id_col: str, text_col: str, pattern: str, but: Broadcast | None = None) -> DataFrame:
    """(id, idx, word, start, stop) of all matches in a text, offsets in characters; a null text has none.

    but is a broadcast set of lower-case words: matches that are none of them alone are returned, with their place among all.

    Map-only: placing matches with built-in functions would take a window over each document's tokens, and so a shuffle
    of all of them.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).finditer
        left_out = but.value if but else frozenset()

        def rows(text: str | None) -> Iterator[tuple[int, str, int, int]]:
            for k, m in enumerate(find(text or "")):
                if m[0].lower() not in left_out:
                    yield k, m[0], m.start(), m.end()

        return made_rows(batches, rows, [id_col, "idx", "word", "start", "stop"], [pa.int32(), pa.string(), pa.int32(), pa.int32()])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(place, f"`{id_col}` {kind}, idx int, word string, start int, stop int")


def tokenize(df: DataFrame, id_col: str, text_col: str, but: Broadcast | None = None) -> DataFrame:
    """(id, tok_idx, word, start, stop): runs of ASCII letters and digits with ' and -, or single CJK characters."""
    return placed_matches(df, id_col, text_col, _TOKEN, but).withColumnRenamed("idx", "tok_idx")


def words_only(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word): the tokens without offsets, with no shuffle."""
    return df.select(F.col(id_col), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_TOKEN), 0)).alias("word"))


#: Distinct tokens that a counting task holds at most, about.
HELD_WORDS = 100_000


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """(word, freq): how often each lower-cased token occurs. Tokens are counted in tasks first, and only counts are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(_TOKEN).findall

        def made(held: Counter) -> pa.RecordBatch:
            # Tokens are ASCII or CJK: lower case is that of the tokens alone, not of what lies between them.
            return pa.RecordBatch.from_arrays([pa.array([w.lower() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "freq"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(find(text or ""))
                if len(held) >= HELD_WORDS:
                    yield made(held)
                    held = Counter()
        if held:
            yield made(held)

    return df.select(text_col).mapInArrow(count, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))


def script_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, run_idx, is_cjk, run, start, stop): alternating runs of CJK and other characters, whole text."""
    runs = placed_matches(df, id_col, text_col, rf"[{CJK}]+|[^{CJK}]+")
    return runs.select(id_col, F.col("idx").alias("run_idx"), contains_cjk(F.col("word")).alias("is_cjk"), F.col("word").alias("run"), "start", "stop")


def contains_cjk(text: Column) -> Column:
    return text.rlike(rf"[{CJK}]")


#: Words that are broadcast to segmentation at most: as one string for each first character and length, some 20 bytes a word.
BROADCAST_WORDS = 10_000_000
#: Runs that a task remembers the cuts of, and the characters of one at most.
HELD_RUNS, HELD_CHARS = 50_000, 64


def longest_word(held: dict) -> Callable[[str, int], int]:
    """A function of a text and a place: the length of the longest word there, 1 if there is none.

    held: under each first character, (length, words) with the longest first, the words in order and joined. A bit for the
    hash of each word, made once for a process, tells nearly all others apart; the rest are looked for in their string.
    """
    if "bits" not in held:
        slots = 1 << max(3, (8 * sum(len(own) // n for lists in held["words"].values() for n, own in lists)).bit_length())
        bits = bytearray(slots // 8)
        for lists in held["words"].values():
            for n, own in lists:
                for i in range(0, len(own), n):
                    h = hash(own[i : i + n]) & (slots - 1)
                    bits[h >> 3] |= 1 << (h & 7)
        held["bits"], held["slots"] = bits, slots
    words, bits, most = held["words"], held["bits"], held["slots"] - 1

    def longest(text: str, at: int) -> int:
        for n, own in words.get(text[at], ()):
            word = text[at : at + n]
            h = hash(word) & most
            # A slice at the end of the text is shorter, and so no word of that length.
            if bits[h >> 3] & (1 << (h & 7)) and len(word) == n:
                k = bisect_left(range(len(own) // n), word, key=lambda i: own[i * n : i * n + n])  # noqa: B023
                if own[k * n : k * n + n] == word:
                    return n
        return 1

    return longest


def segment_cjk(df: DataFrame, id_col: str, text_col: str, words: DataFrame) -> DataFrame:
    """(id, seg_idx, word, start, stop): greedy longest match of dictionary words (two characters or more) in CJK runs.

    A run without CJK is one segment. The dictionary's CJK words are counted: up to BROADCAST_WORDS go to every task, as
    strings, and texts are walked where they lie; beyond, substrings of the runs meet the dictionary in a join.
    """
    useful = _cjk_words(words)
    if useful.count() > BROADCAST_WORDS:
        return _segment_by_join(df, id_col, text_col, words).drop("at")
    found = _walked(df, id_col, text_col, useful).select(id_col, F.posexplode("segments").alias("seg_idx", "s"))
    return found.select(id_col, "seg_idx", "s.word", "s.start", "s.stop")


def segments(df: DataFrame, id_col: str, text_col: str, words: DataFrame) -> DataFrame:
    """(id, segments): what segment_cjk finds, a row a text, as an array of word, start, stop and at, where the segment's run starts."""
    useful = _cjk_words(words)
    if useful.count() <= BROADCAST_WORDS:
        return _walked(df, id_col, text_col, useful)
    found = _segment_by_join(df, id_col, text_col, words)
    own = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "word", "start", "stop", "at"))), lambda x: x.dropFields("seg_idx"))
    return found.groupBy(id_col).agg(own.alias("segments"))


def _cjk_words(words: DataFrame) -> DataFrame:
    return words.select("word").where(F.col("word").rlike(rf"^[{CJK_WIDE}]{{2,}}$")).distinct()


def _walked(df: DataFrame, id_col: str, text_col: str, useful: DataFrame) -> DataFrame:
    """(id, segments) by walking each text where it lies, with a broadcast dictionary."""
    joined = useful.groupBy(F.substring("word", 1, 1).alias("first"), F.length("word").alias("n")).agg(F.array_join(F.array_sort(F.collect_list("word")), "").alias("words"))
    words: dict[str, list[tuple[int, str]]] = {}
    for r in joined.toLocalIterator():
        words.setdefault(r.first, []).append((r.n, r.words))
    shared = df.sparkSession.sparkContext.broadcast({"words": {c: sorted(own, reverse=True) for c, own in words.items()}})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, runs = longest_word(shared.value), re.compile(rf"[{CJK_WIDE}]+|[^{CJK_WIDE}]+").finditer
        is_cjk = re.compile(rf"[{CJK_WIDE}]").match
        known: dict[str, list[int]] = {}

        def cuts(run: str) -> list[int]:
            """Lengths of a run's segments."""
            sizes = known.get(run)
            if sizes is None:
                sizes, at = [], 0
                while at < len(run):
                    sizes.append(longest(run, at))
                    at += sizes[-1]
                if len(run) <= HELD_CHARS:
                    if len(known) >= HELD_RUNS:
                        known.clear()
                    known[run] = sizes
            return sizes

        def batch_of(ids: pa.Array, ends: list[int], found: list[str], starts: list[int], stops: list[int], ats: list[int]) -> pa.RecordBatch:
            own = pa.StructArray.from_arrays([pa.array(found, pa.string()), *(pa.array(x, pa.int32()) for x in (starts, stops, ats))], ["word", "start", "stop", "at"])
            return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own)], [id_col, "segments"])

        for part in parts(batches):
            first, ends, found, starts, stops, ats = 0, [0], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                for run in runs(text or ""):
                    own, begin, at = run[0], run.start(), 0
                    for n in cuts(own) if is_cjk(own) else (len(own),):
                        found.append(own[at : at + n])
                        starts.append(begin + at)
                        stops.append(begin + at + n)
                        ats.append(begin)
                        at += n
                ends.append(len(found))
                if len(found) >= ROWS:
                    yield batch_of(part.column(0).slice(first, i + 1 - first), ends, found, starts, stops, ats)
                    first, ends, found, starts, stops, ats = i + 1, [0], [], [], [], []
            if len(ends) > 1:
                yield batch_of(part.column(0).slice(first), ends, found, starts, stops, ats)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(walk, f"`{id_col}` {kind}, segments array<struct<word:string,start:int,stop:int,at:int>>")


def _segment_by_join(df: DataFrame, id_col: str, text_col: str, words: DataFrame) -> DataFrame:
    """segment_cjk with a dictionary of any size; at is where a segment's run starts.

    Candidate substrings of each run meet the dictionary in a semi-join, so the dictionary is never held whole; the
    longest word at each place is then walked from the left.
    """
    longest = words.agg(F.max(F.length("word"))).first()[0] or 1
    runs = placed_matches(df, id_col, text_col, rf"[{CJK_WIDE}]+|[^{CJK_WIDE}]+")
    runs = runs.select(id_col, F.col("idx").alias("run_idx"), F.col("word").alias("run"), F.col("start").alias("at"), F.col("word").rlike(f"^[{CJK_WIDE}]").alias("cjk"))
    n = F.length("run")
    places = runs.where("cjk").select(id_col, "run_idx", "run", F.explode(F.sequence(F.lit(1), n)).alias("pos"))
    spans = places.select("*", F.explode(F.sequence(F.lit(2), F.lit(max(int(longest), 2)))).alias("size")).where(F.col("pos") + F.col("size") - 1 <= n)
    spans = spans.withColumn("word", F.substring("run", F.col("pos"), F.col("size")))
    known = spans.join(words.select("word").distinct(), "word", "left_semi").groupBy(id_col, "run_idx", "pos").agg(F.max("size").alias("size"))
    best = known.groupBy(id_col, "run_idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "size"))).alias("best"))
    joined = runs.join(best, [id_col, "run_idx"], "left")
    walk = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<pos:int,size:int>>").alias("out")),
        lambda s, p: F.when(
            p == s["next"],
            F.struct(
                (p + F.coalesce(F.try_element_at(F.col("best"), p), F.lit(1))).alias("next"),
                F.array_append(s["out"], F.struct(p.alias("pos"), F.coalesce(F.try_element_at(F.col("best"), p), F.lit(1)).alias("size"))).alias("out"),
            ),
        ).otherwise(s),
    )["out"]
    whole = F.array(F.struct(F.lit(1).alias("pos"), n.alias("size")))
    cut = joined.select(id_col, "run_idx", "run", "at", F.posexplode(F.when(F.col("cjk"), walk).otherwise(whole)).alias("i", "p"))

    order = Window.partitionBy(id_col).orderBy("run_idx", "i")
    start = F.col("at") + F.col("p.pos") - 1
    return cut.select(id_col, (F.row_number().over(order) - 1).alias("seg_idx"), F.substring("run", F.col("p.pos"), F.col("p.size")).alias("word"), start.alias("start"), (start + F.col("p.size")).alias("stop"), "at")


def text_stats(df: DataFrame, text_col: str) -> DataFrame:
    """df with chars, words, sentences and paragraphs: pieces that aren't empty."""
    pieces = lambda pattern: F.size(F.filter(F.split(F.col(text_col), pattern), lambda x: x != ""))
    return (
        df.withColumn("chars", F.length(text_col))
        .withColumn("words", pieces(r"(?U)\s+"))
        .withColumn("sentences", pieces("[。！？.!?]+"))
        .withColumn("paragraphs", pieces("\n+"))
    )


def doc_stats(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, chars, words) of a document's block texts in order, joined by a space."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), " ")
    whole = blocks.groupBy(id_col).agg(text.alias("text"))
    return whole.select(id_col, F.length("text").alias("chars"), F.size(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")).alias("words"))


def _pieces(text: Column, query: str, case_sensitive: bool) -> Column:
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.split(text, quoted if case_sensitive else f"(?iu){quoted}" if re.search("[^\x00-\x7f]", query) else f"(?i){quoted}")


def count_matches(text: Column, query: str, case_sensitive: bool = False) -> Column:
    return F.size(_pieces(text, query, case_sensitive)) - 1


def find_matches(df: DataFrame, id_col: str, text_col: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """(id, match_idx, start, stop) of every occurrence, none overlapping; an empty query finds nothing. Map-only."""
    if not query:
        return df.select(id_col, F.lit(0).alias("match_idx"), F.lit(0).alias("start"), F.lit(0).alias("stop")).limit(0)
    # Case is that of ASCII letters alone, unless the query has others.
    flags = "" if case_sensitive else "(?i)" if re.search("[^\x00-\x7f]", query) else "(?ai)"
    found = placed_matches(df, id_col, text_col, flags + re.escape(query))
    return found.select(id_col, F.col("idx").alias("match_idx"), "start", "stop")


#: Patterns that are broadcast together, about.
MANY_PATTERNS = 200_000


def automaton(patterns: Iterable[str]):
    """Finds all patterns in one pass over a text: a function of a text that gives (pattern, start), overlaps of one pattern left out."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p in patterns:
        machine.add_word(p, p)
    machine.make_automaton()

    def find(text: str) -> Iterator[tuple[str, int]]:
        free: dict[str, int] = {}
        for end, p in machine.iter(text):
            start = end + 1 - len(p)
            if start >= free.get(p, 0):
                free[p] = end + 1
                yield p, start

    return find if len(machine) else lambda text: []


def find_patterns(df: DataFrame, id_col: str, text_col: str, patterns: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(id, pattern, match_idx, start, stop) of every occurrence of each pattern (pattern), those of one not overlapping.

    All patterns are found in one pass over a text, in time of its length and the matches. Without case, patterns and
    texts are compared lower-cased, character by character, so that places are those of the text. Patterns are counted, as
    they go to every task; of more than MANY_PATTERNS, each so many are a pass of their own.
    """
    names = patterns.select("pattern").where("pattern <> ''").distinct()
    passes = max(1, -(-names.count() // MANY_PATTERNS))
    found = [_find_some(df, id_col, text_col, names.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k), case_sensitive) for k in range(passes)]
    return functools.reduce(DataFrame.unionByName, found)


def _find_some(df: DataFrame, id_col: str, text_col: str, names: DataFrame, case_sensitive: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast([r.pattern for r in names.toLocalIterator()])

    def low(text: str) -> str:
        lower = text.lower()
        # Where lower case changes the length, each character that it lengthens stays as it is.
        return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = (lambda x: x) if case_sensitive else low
        written: dict[str, list[str]] = {}
        for p in shared.value:
            written.setdefault(fold(p), []).append(p)
        find = automaton(written)

        def rows(text: str | None) -> Iterator[tuple[str, int, int, int]]:
            count: dict[str, int] = {}
            for p, start in find(fold(text or "")):
                k = count.get(p, 0)
                count[p] = k + 1
                for name in written[p]:
                    yield name, k, start, start + len(p)

        return made_rows(batches, rows, [id_col, "pattern", "match_idx", "start", "stop"], [pa.string(), pa.int32(), pa.int32(), pa.int32()])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(walk, f"`{id_col}` {kind}, pattern string, match_idx int, start int, stop int")


def replace_text(df: DataFrame, text_col: str, query: str, replacement: str, case_sensitive: bool = False) -> DataFrame:
    """df with every match replaced, and n_replaced."""
    if not query:
        return df.withColumn("n_replaced", F.lit(0))
    pieces = _pieces(F.col(text_col), query, case_sensitive)
    return df.withColumn("n_replaced", count_matches(F.col(text_col), query, case_sensitive)).withColumn(text_col, F.array_join(pieces, replacement))
