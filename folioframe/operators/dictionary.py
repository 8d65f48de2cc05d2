"""Dictionaries as tables: word lists, affix rules, user words, and the index of delete variants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folioframe.plans.batches import ROWS

#: Words of a list that dictionaries of an editor are cut to, if asked for.
AFFIX_WORD_CAP = 100_000


def parse_dic(lines: DataFrame) -> DataFrame:
    """(line_no, word, flags, freq) of dictionary lines (line_no, line): the numeric first line, blanks and words with spaces go."""
    line = F.trim(F.col("line"))
    first = (F.col("line_no") == 0) & line.rlike(r"^\d+$")
    kept = lines.where((line != "") & ~first)
    head = F.trim(F.split(line, "\t")[0])
    word, flags = F.trim(F.split(head, "/")[0]), F.coalesce(F.get(F.split(head, "/"), F.lit(1)), F.lit(""))
    return kept.select("line_no", word.alias("word"), flags.alias("flags"), F.greatest(F.lit(1), 1000 - 10 * F.octet_length(word)).cast("long").alias("freq")).where(
        (F.col("word") != "") & ~F.col("word").contains(" ")
    )


def parse_aff(lines: DataFrame) -> DataFrame:
    """(kind, flag, entry_no, strip, add, cond) of affix lines (line_no, line): a header `SFX f Y|N count`, then count entries."""
    p = F.split(F.trim(F.col("line")), r"\s+")
    rows = lines.where(F.trim("line").rlike("^[SP]FX ")).select("line_no", p.alias("p"))
    header = F.get("p", F.lit(2)).isin("Y", "N") & F.get("p", F.lit(3)).rlike(r"^\d+$")
    rows = rows.select("line_no", "p", header.alias("header"), F.element_at("p", 1).alias("kind"), F.element_at("p", 2).alias("flag"))
    w = Window.partitionBy("kind", "flag").orderBy("line_no")
    rows = rows.withColumn("count", F.last(F.when(F.col("header"), F.col("p")[3].cast("int")), True).over(w)).withColumn("block", F.sum(F.col("header").cast("int")).over(w))
    entries = rows.where("not header and block > 0").withColumn("entry_no", F.row_number().over(Window.partitionBy("kind", "flag", "block").orderBy("line_no")))
    zero = lambda c: F.when(c == "0", "").otherwise(c)
    return entries.where("entry_no <= count").select(
        "kind", "flag", "entry_no", zero(F.get("p", F.lit(2))).alias("strip"), zero(F.split(F.coalesce(F.get("p", F.lit(3)), F.lit("")), "/")[0]).alias("add"), F.coalesce(F.get("p", F.lit(4)), F.lit(".")).alias("cond")
    )


#: Rules that are broadcast at most.
FEW_RULES = 100_000


def expand_affixes(stems: DataFrame, rules: DataFrame, per_stem: int = 5, cap: int | None = None) -> DataFrame:
    """(word, freq) of stems (line_no, word, flags, freq) under rules: the stem and its derivations, the first per_stem of each.

    Suffix conditions without brackets must end the stem, those with brackets always pass; prefixes have no condition.
    A word's first sighting weighs freq, later derivations half; a stem without flags sets the weight anew. All words are
    returned, or the first `cap` by line.
    """
    flagged = stems.where("flags <> ''").select("*", F.posexplode(F.filter(F.split("flags", ""), lambda x: x != "")).alias("flag_pos", "flag"))
    r = rules.withColumn("kind_no", F.when(F.col("kind") == "SFX", 0).otherwise(1))
    r = F.broadcast(r) if rules.count() <= FEW_RULES else r
    met = flagged.join(r, "flag")
    w = F.col("word")
    # A condition is taken literally unless it has brackets; "." stands for any.
    passes = (F.col("cond") == ".") | F.col("cond").contains("[") | w.endswith(F.col("cond"))
    suffix = F.when((F.col("kind") == "SFX") & w.endswith(F.col("strip")) & passes, F.concat(F.substring(w, F.lit(1), F.length(w) - F.length("strip")), "add"))
    prefix = F.when((F.col("kind") == "PFX") & w.startswith(F.col("strip")), F.concat("add", F.substring(w, F.length("strip") + 1, F.length(w))))
    derived = met.withColumn("made", F.coalesce(suffix, prefix)).where("made is not null and made <> ''")
    rows = derived.select("line_no", F.col("made").alias("word"), "freq", F.struct("flag_pos", "kind_no", "entry_no").alias("at"), F.lit(False).alias("sets"))
    low = F.struct(F.lit(-1).alias("flag_pos"), F.lit(0).alias("kind_no"), F.lit(0).alias("entry_no"))
    own = stems.select("line_no", "word", "freq", low.alias("at"), (F.col("flags") == "").alias("sets"))
    order = Window.partitionBy("line_no").orderBy("at")
    first = own.unionByName(rows).dropDuplicates(["line_no", "word"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_stem)
    seen = Window.partitionBy("word").orderBy("line_no", "n")
    marked = first.withColumn("k", F.row_number().over(seen)).withColumn("last_set", F.max(F.when(F.col("sets"), F.col("k"))).over(Window.partitionBy("word")))
    start = F.coalesce("last_set", F.lit(1))
    total = F.sum(F.when(F.col("k") == start, F.col("freq")).when(F.col("k") > start, F.floor(F.col("freq") / 2)).otherwise(0)).cast("long")
    made = marked.groupBy("word").agg(total.alias("freq"), F.min(F.struct("line_no", "n")).alias("at"))
    return (made if cap is None else made.orderBy("at").limit(cap)).select("word", "freq")


def load_wordlist(lines: DataFrame) -> DataFrame:
    """(word, freq) of `word freq pos` lines (line): # comments go, a missing, bad or non-positive count is 1, duplicates sum."""
    line = F.trim(F.col("line"))
    p = F.split(line, r"\s+")
    n = F.when(F.get(p, F.lit(1)).rlike(r"^-?\d+$"), F.get(p, F.lit(1)).try_cast("long"))
    rows = lines.where((line != "") & ~line.startswith("#")).select(p[0].alias("word"), F.when(n > 0, n).otherwise(1).cast("long").alias("freq"))
    return rows.groupBy("word").agg(F.sum("freq").alias("freq"))


def build_dictionary(words: DataFrame, user_dict: DataFrame | None, lang: str) -> DataFrame:
    """(lang, word, freq): words lower-cased and trimmed (zh keeps case), counts below 1 are 1, user words weigh one more."""
    norm = (lambda c: F.trim(c)) if lang == "zh" else (lambda c: F.lower(F.trim(c)))
    rows = words.select(norm(F.col("word")).alias("word"), F.when(F.col("freq") > 0, F.col("freq")).otherwise(1).cast("long").alias("freq"))
    if user_dict is not None:
        own = user_dict.where(F.col("lang") == lang).select(norm(F.col("word")).alias("word"), (F.col("frequency") + 1).cast("long").alias("freq"))
        rows = rows.unionByName(own)
    return rows.where("word <> ''").groupBy("word").agg(F.sum("freq").alias("freq")).select(F.lit(lang).alias("lang"), "word", "freq")


def max_distance(words: DataFrame, lang: str) -> int:
    """Edits that a fuzzy search allows: by the language alone, so that a word's suggestions don't change as its list grows."""
    return 1 if lang == "zh" else 2


def upsert_user_words(user_dict: DataFrame | None, events: DataFrame) -> DataFrame:
    """The user dictionary after events (op add or remove, word, lang, source, inc, ts).

    Per key (lower, trimmed word; lang) only additions after the last removal count; a new word keeps its first source
    and time, an old one adds up. Removal lower-cases without trimming.
    """
    add = F.col("op") == "add"
    keyed = events.select("op", F.when(add, F.lower(F.trim("word"))).otherwise(F.lower("word")).alias("word"), "lang", "source", F.when(F.col("inc") > 0, F.col("inc")).otherwise(1).alias("inc"), "ts").where("word <> ''")
    gone = keyed.where("op = 'remove'").groupBy("word", "lang").agg(F.max("ts").alias("gone_at"))
    adds = keyed.where("op = 'add'").join(gone, ["word", "lang"], "left").where("gone_at is null or ts > gone_at")
    new = adds.groupBy("word", "lang").agg(F.sum("inc").cast("long").alias("n"), F.min_by("source", "ts").alias("s"), F.min("ts").alias("c"), F.max("ts").alias("u"))
    if user_dict is None:
        return new.select("word", "lang", F.col("n").alias("frequency"), F.col("s").alias("source"), F.col("c").alias("created_at"), F.col("u").alias("last_used"))
    old = user_dict.join(gone, ["word", "lang"], "left_anti")
    both = old.join(new, ["word", "lang"], "full_outer")
    return both.select(
        "word", "lang", (F.coalesce("frequency", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("frequency"),
        F.coalesce("source", "s").alias("source"), F.coalesce("created_at", "c").alias("created_at"), F.greatest("last_used", "u").alias("last_used"),
    )


def in_user_dict(df: DataFrame, user_dict: DataFrame, lang: str, word_col: str = "word") -> DataFrame:
    """Rows whose word is in the user dictionary."""
    keys = user_dict.where(F.col("lang") == lang).select(F.col("word").alias("_key")).distinct()
    return df.join(keys, F.lower(F.trim(df[word_col])) == keys["_key"], "left_semi")


def list_words(user_dict: DataFrame, lang: str) -> DataFrame:
    return user_dict.where(F.col("lang") == lang).orderBy(F.desc("frequency"), "word")


def dict_stats(words: DataFrame) -> DataFrame:
    return words.groupBy("lang").agg(F.count("*").alias("n_words"))


def with_variants(df: DataFrame, source: str, distance: int, name: str) -> DataFrame:
    """df with a row for each that a column's word becomes by up to distance deletions of characters, itself included, each once; never empty."""
    columns = [c for c in df.columns if c != name]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(batch: pa.RecordBatch, owner: list[int], made: list[str | None]) -> pa.RecordBatch:
            at = pa.array(owner, pa.int64())
            return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(made, pa.string())], [*columns, name])

        for batch in batches:
            owner, made = [], []
            for i, word in enumerate(batch.column(columns.index(source)).to_pylist()):
                found = delete_variants(word, distance)
                owner += [i] * len(found)
                made += found
                if len(made) >= ROWS:
                    yield batch_of(batch, owner, made)
                    owner, made = [], []
            if made:
                yield batch_of(batch, owner, made)

    return df.select(*columns).mapInArrow(grow, StructType([*df.select(*columns).schema.fields, StructField(name, StringType())]))


def delete_variants(word: str | None, distance: int) -> list[str | None]:
    if not word or not distance:
        return [word]
    if distance > 2 or len(word) <= distance:
        found = level = {word}
        for _ in range(distance):
            level = {w[:i] + w[i + 1 :] for w in level if len(w) > 1 for i in range(len(w))}
            found = found | level
        return list(found)
    once = [word[:i] + word[i + 1 :] for i in range(len(word))]
    if distance == 1:
        return list({word, *once})
    # Of two deletions the first is made already: the second is at its place or behind it.
    return list({word, *once, *(w[:j] + w[j + 1 :] for i, w in enumerate(once) for j in range(i, len(w)))})


def deletes_index(words: DataFrame, distance: int) -> DataFrame:
    """words with a row per delete variant, in column `delete`; write it bucketed by (lang, delete) to keep it."""
    return with_variants(words, "word", distance, "delete")
