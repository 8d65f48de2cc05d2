"""Quality rules, line first.

Rules for punctuation, navigation and boilerplate judge each line; failing lines are removed, and a document that
loses too much of its text this way is rejected. Everything is one projection over the documents: built-in
expressions only, no shuffle, no Python. A document never leaves its row, so hot sources or groups of copies
change nothing.

Defined results: a null or empty text has no words and fails; repeated rows are judged alike; extra columns
pass through; an empty table gives an empty table. Counts of repeated words are exact at every length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import let, read, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least share of a document's word characters that must survive the line rules.
MIN_KEPT_SHARE = 0.5
#: Words of a line from which on it must end like a sentence.
SENTENCE_WORDS = 5
#: Phrases of licences, cookie notices and page frames, in English, French, German and Spanish.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|licen[sc]ed under|released under the|cookie policy|privacy policy|terms of (use|service)"
    r"|powered by|sign up for|subscribe to|click here|javascript is (disabled|required)"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|mentions l[éÉ]gales|conditions d'utilisation|abonnez-vous|cliquez ici"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|hier klicken|newsletter abonnieren"
    r"|todos los derechos reservados|pol[íÍ]tica de (privacidad|cookies)|t[éÉ]rminos de uso|suscr[íÍ]bete a|haga clic aqu[íÍ])|^\s*(copyright|©)"
)
NAVIGATION = r"(\s[|»›>•·]\s.*){3,}"
#: How a sentence ends: a mark, and whatever quotes and brackets it is in.
SENTENCE_END = r"[.!?…。！？:;][\"'”’»)\]]*\s*\z"

_SYMBOLS = "#*$%&|<>"


def _line_fails(line: Column) -> Column:
    """Punctuation: symbols on a third of the words, more exclamation marks than words, shouting, or a long line without a sentence's end.
    Navigation: a chain of separators. Boilerplate: its phrases.

    Cheap tests come first: the words of a line are counted only if its marks are suspicious.
    """
    words = F.size(words_of(line))
    symbols = F.length(line) - F.length(F.translate(line, _SYMBOLS, ""))
    marks = F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))
    shouting = (line == F.upper(line)) & (line != F.lower(line)) & (words >= 4)
    endless = ~line.rlike(SENTENCE_END) & (words >= SENTENCE_WORDS)
    return ((symbols >= 3) & (3 * symbols > words)) | ((marks >= 1) & (marks > words)) | shouting | endless | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")


#: Bits of a window's place beside its hash in one long.
PLACE_BITS = 20


def _repeated_words(w: Column) -> Column:
    """Of the words w, an expression that is bound: words that lie in a three-word window found at least twice.

    Equal windows are put side by side by a sort; the sorted places of repeated windows then tell how many words they
    cover, overlaps once. Hash and place share one long, so that the sort is a primitive one; if two neighbours of
    equal hashes differ in their words, or there are too many places for the long, the windows are sorted by their
    words instead. Both ways are exact.
    """
    same = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
    starts = F.sequence(F.lit(0), F.size(w) - 3)

    def covered(s: Column, alike, place) -> Column:
        hit = F.filter(F.transform(s, lambda x, i: F.when(alike(F.get(s, i - 1), x) | alike(x, F.get(s, i + 1)), place(x))), lambda x: x.isNotNull())
        return let(
            F.sort_array(hit),
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)).cast("long")),
                F.lit(0).cast("long"),
                lambda s, x: s + x,
            ),
        )

    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    hashed = lambda x: F.shiftright(x, PLACE_BITS)
    no = F.lit(False)
    met = lambda x, y: F.coalesce(hashed(x) == hashed(y), no)

    def packed(s: Column) -> Column:
        clash = F.exists(F.filter(F.transform(s, lambda x, i: F.when(met(F.get(s, i - 1), x), ~same(place(F.get(s, i - 1)), place(x)))), lambda x: x.isNotNull()), lambda x: x)
        return F.when(clash, spelt()).otherwise(covered(s, met, place))

    def spelt() -> Column:
        windows = F.transform(starts, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))
        alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), no)
        return let(F.sort_array(windows), lambda s: covered(s, alike, lambda x: x["i"]))

    keys = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) <= 1 << PLACE_BITS, let(F.sort_array(keys), packed)).otherwise(spelt())


def quality(text: Column, min_words: int = MIN_WORDS, min_kept_share: float = MIN_KEPT_SHARE) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_chars, base_failed, kept) of a text.

    n_kept_chars counts word characters on lines that pass the line rules. Words and lines are split once each.
    """
    text = F.coalesce(text, F.lit(""))
    chars = lambda c: F.length(F.translate(c, " \t\n\x0b\f\r", "")).cast("long")
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    of_lines = let(
        _lines_with_words(text),
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), chars(F.array_join(F.filter(x, lambda y: ~_line_fails(y)), "")).alias("n_kept_chars")
        ),
    )
    counts = F.struct(
        of_words.alias("w"), chars(text).alias("word_chars"), (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"), of_lines.alias("l")
    )

    def judged(c: Column) -> Column:
        n, repeated = c["w"]["n_words"], c["w"]["n_repeat_words"]
        failed = (n < min_words) | (100 * repeated > MAX_REPEAT_PERCENT * n)
        kept = ~failed & (c["l"]["n_kept_chars"] >= min_kept_share * c["word_chars"])
        return F.struct(
            n.alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["l"]["n_dup_lines"].alias("n_dup_lines"), repeated.alias("n_repeat_words"),
            c["l"]["n_kept_chars"].alias("n_kept_chars"), failed.alias("base_failed"), kept.alias("kept"),
        )

    return let(counts, judged)


def clean_lines(text: Column) -> Column:
    """The text without its failing lines, in order."""
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~_line_fails(x)), "\n")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", quality(docs["text"]).alias("q")).select(
        "doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their failing lines; n_chars, if there is such a column, counts what is left."""
    kept = docs.where(quality(docs["text"])["kept"])
    text = clean_lines(kept["text"])
    return kept.select(*[text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else kept[c] for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the rest lose their failing lines."""
    return clean_documents(docs)


def _line_fails_sql() -> str:
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    words = r"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))"
    symbols = "length(x) - length(translate(x, '#*$%&|<>', ''))"
    return f"""(3 * ({symbols}) > {words} AND {symbols} >= 3)
  OR length(x) - length(replace(x, '!', '')) > {words}
  OR ({words} >= 4 AND x = upper(x) AND x <> lower(x))
  OR ({words} >= {SENTENCE_WORDS} AND NOT regexp_matches(x, {quoted(SENTENCE_END)}))
  OR regexp_matches(x, {quoted(NAVIGATION)}) OR regexp_matches(x, {quoted(BOILERPLATE)})"""


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
base AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         length(regexp_replace(array_to_string(list_filter(l, lambda x: NOT (""" + _line_fails_sql() + r""")), ''), '[\x20\x09-\x0D]+', '', 'g')) AS kept_chars
  FROM d LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= 0.5 * word_chars AS kept
FROM f
"""
