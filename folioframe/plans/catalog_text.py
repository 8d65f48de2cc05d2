"""Queries over documents, words and markup, and their DuckDB SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import scalar as S
from folioframe.operators import dictionary as B
from folioframe.operators import documents as D
from folioframe.operators import markup as M
from folioframe.operators import spelling as C
from folioframe.operators import text as T
from folioframe.operators.sheet import _cut, number_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_TOKENS = "regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''-]*|[㐀-䶿一-鿿]')"
#: Words seen five times or more are the corpus's dictionary.
_WORDS = f"""tok AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents),
words AS (SELECT lower(word) AS word, count(*) AS freq FROM tok GROUP BY 1 HAVING count(*) >= 5)"""
_CHECKABLE = "octet_length(encode(word)) > 1 AND NOT regexp_matches(word, '^[0-9.,]+$') AND NOT regexp_matches(word, '[㐀-䶿一-鿿]')"


def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.count_words(_t(spark, sf, "documents"), "text")


def corpus_words(spark: SparkSession, sf: str, least: int = 5) -> DataFrame:
    return word_counts(spark, sf).where(F.col("freq") >= least)


def words_and_misses(spark: SparkSession, sf: str, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """The corpus's frequent words as a dictionary, and its other checkable words as queries; the corpus is counted once."""
    counts = _cut(word_counts(spark, sf))
    misses = counts.where((F.col("freq") < least) & S.is_checkable(F.col("word"))).select(F.col("word").alias("query"))
    return counts.where(F.col("freq") >= least), misses


@query("tokenize", f"""
WITH t AS (SELECT doc_id, text, {_TOKENS} AS ws, regexp_split_to_array(text, '[A-Za-z0-9][A-Za-z0-9''-]*|[㐀-䶿一-鿿]') AS gaps FROM documents),
u AS (SELECT doc_id, i - 1 AS tok_idx, ws[i] AS word, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t))
SELECT doc_id, tok_idx::INT AS tok_idx, word, start::INT AS start, (start + length(word))::INT AS stop FROM u""")
def tokenize(spark, sf):
    return T.tokenize(_t(spark, sf, "documents"), "doc_id", "text")


_HAN = "".join(chr(0x4E00 + i) for i in range(26))
_LATIN = "abcdefghijklmnopqrstuvwxyz"


@query("script_runs", rf"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'aeiou', '一七三上下'), '[㐀-䶿一-鿿]+|[^㐀-䶿一-鿿]+') AS rs FROM documents)
SELECT doc_id, (i - 1)::INT AS run_idx, regexp_matches(rs[i], '[㐀-䶿一-鿿]') AS is_cjk, list_sum(list_transform(rs[1:i], lambda x: length(x)))::INT AS stop FROM (SELECT doc_id, rs, unnest(range(1, len(rs) + 1)) AS i FROM t)""")
def script_runs(spark, sf):
    """Texts whose vowels are made CJK characters."""
    docs = _t(spark, sf, "documents").select("doc_id", F.translate("text", "aeiou", "一七三上下").alias("text"))
    return T.script_runs(docs, "doc_id", "text").select("doc_id", "run_idx", "is_cjk", "stop")


def _han(c):
    """Latin letters as CJK characters, one for one."""
    return F.translate(F.lower(c), _LATIN, _HAN)


_HAN_SQL = f"translate(lower({{}}), '{_LATIN}', '{_HAN}')"


@query("segment_cjk", rf"""WITH RECURSIVE {_WORDS}, dict AS (SELECT DISTINCT {_HAN_SQL.format("word")} AS w FROM words WHERE length(word) > 1), most AS (SELECT max(length(w)) AS n FROM dict),
t AS (SELECT doc_id, regexp_extract_all({_HAN_SQL.format("text")}, '[㐀-䶿一-鿿豈-﫿]+|[^㐀-䶿一-鿿豈-﫿]+') AS rs FROM documents), r AS (SELECT doc_id, i, rs[i] AS run FROM (SELECT doc_id, rs, unnest(range(1, len(rs) + 1)) AS i FROM t)),
kinds AS (SELECT DISTINCT run FROM r WHERE regexp_matches(run, '[㐀-䶿一-鿿豈-﫿]')), places AS (SELECT run, unnest(range(1, length(run) + 1)) AS pos FROM kinds),
spans AS (SELECT run, pos, unnest(range(2, least(length(run) - pos + 1, (SELECT n FROM most)) + 1)) AS size FROM places),
best AS (SELECT run, pos, max(size) AS size FROM spans WHERE substr(run, pos, size) IN (SELECT w FROM dict) GROUP BY ALL),
walk AS (SELECT run, 1::BIGINT AS pos FROM kinds UNION ALL SELECT walk.run, walk.pos + coalesce(best.size, 1) FROM walk LEFT JOIN best ON best.run = walk.run AND best.pos = walk.pos WHERE walk.pos + coalesce(best.size, 1) <= length(walk.run)),
cuts AS (SELECT run, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS cuts FROM walk GROUP BY run)
SELECT doc_id, sum(coalesce(n, 1))::BIGINT AS n_segments, md5(string_agg(coalesce(cuts, '1'), ';' ORDER BY i)) AS digest FROM r LEFT JOIN cuts USING (run) GROUP BY doc_id""")
def segment_cjk(spark, sf):
    """Texts and the dictionary with their letters made CJK characters; the digest is of each run's cuts."""
    words = _cut(corpus_words(spark, sf).where(F.length("word") > 1).select(_han(F.col("word")).alias("word")))
    docs = _t(spark, sf, "documents").select("doc_id", _han(F.col("text")).alias("text"))
    found = T.segments(docs, "doc_id", "text", words).where(F.size("segments") > 0)
    mark = lambda x, i: F.when(i == 0, "").when(x["start"] == x["at"], ";").otherwise(",")
    cuts = F.array_join(F.transform("segments", lambda x, i: F.concat(mark(x, i), (x["start"] - x["at"] + 1).cast("string"))), "")
    return found.select("doc_id", F.size("segments").cast("long").alias("n_segments"), F.md5(cuts).alias("digest"))


@query("checkable_words", f"WITH {_WORDS} SELECT word, {_CHECKABLE} AS checkable FROM words")
def checkable_words(spark, sf):
    return corpus_words(spark, sf).select("word", S.is_checkable(F.col("word")).alias("checkable"))


@query("text_stats", r"""
SELECT doc_id, length(text)::INT AS chars, len(list_filter(regexp_split_to_array(text, '[\s\x{00a0}]+'), lambda x: x <> ''))::INT AS words,
  len(list_filter(regexp_split_to_array(text, '[。！？.!?]+'), lambda x: x <> ''))::INT AS sentences, len(list_filter(regexp_split_to_array(text, '\n+'), lambda x: x <> ''))::INT AS paragraphs
FROM documents""")
def text_stats(spark, sf):
    return T.text_stats(_t(spark, sf, "documents"), "text").select("doc_id", "chars", "words", "sentences", "paragraphs")


@query("find_matches", "SELECT doc_id, (len(string_split(lower(text), 'tion')) - 1)::BIGINT AS n_matches FROM documents WHERE contains(lower(text), 'tion')")
def find_matches(spark, sf):
    return T.find_matches(_t(spark, sf, "documents"), "doc_id", "text", "tion").groupBy("doc_id").agg(F.count("*").alias("n_matches"))


@query("find_patterns", """WITH p AS (SELECT DISTINCT pattern FROM (SELECT unnest(['TION', 'the ', 'a', 'aa', 'ñ', 'é']) AS pattern UNION ALL SELECT lower(n_name) FROM nation)),
c AS (SELECT doc_id, pattern, string_split(lower(text), lower(pattern)) AS ps FROM documents, p WHERE contains(lower(text), lower(pattern))), u AS (SELECT *, unnest(range(1, len(ps))) AS i FROM c)
SELECT doc_id, pattern, (i - 1)::INT AS match_idx, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(pattern))::INT AS start FROM u""")
def find_patterns(spark, sf):
    """Places of some syllables and of the names of nations."""
    names = _t(spark, sf, "nation").select(F.lower("n_name").alias("pattern"))
    some = spark.createDataFrame([(p,) for p in ("TION", "the ", "a", "aa", "ñ", "é")], "pattern string")
    return T.find_patterns(_t(spark, sf, "documents"), "doc_id", "text", some.unionByName(names)).select("doc_id", "pattern", "match_idx", "start")


@query("replace_text", "SELECT doc_id, md5(replace(text, 'tion', 'xyz')) AS digest, (len(string_split(text, 'tion')) - 1)::INT AS n_replaced FROM documents")
def replace_text(spark, sf):
    r = T.replace_text(_t(spark, sf, "documents"), "text", "tion", "xyz", case_sensitive=True)
    return r.select("doc_id", F.md5("text").alias("digest"), F.col("n_replaced"))


@query("word_list", f"WITH {_WORDS} SELECT word, sum(freq)::BIGINT AS freq FROM (SELECT word, freq FROM words UNION ALL SELECT word, 1 FROM words) GROUP BY word")
def word_list(spark, sf):
    w = corpus_words(spark, sf)
    lines = w.select(F.concat_ws(" ", "word", "freq", F.lit("n")).alias("line")).unionByName(w.select(F.concat("word", F.lit(" x")).alias("line"))).unionByName(w.select(F.lit("# comment").alias("line")))
    return B.load_wordlist(lines)


_USER_EVENTS = "SELECT CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, ' U' || user_id AS word0, event_type, 'en' AS lang, event_type AS source, (event_id % 4)::INT AS inc, ts, event_id FROM events"


def user_events(spark, sf):
    e = _t(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    word = F.when(op == "add", F.concat(F.lit(" U"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string")))
    return e.select(op.alias("op"), word.alias("word"), F.lit("en").alias("lang"), F.col("event_type").alias("source"), (F.col("event_id") % 4).cast("int").alias("inc"), "ts")


_USER_DICT = f"""ev AS ({_USER_EVENTS}), k AS (SELECT op, lower(trim(word0)) AS word, lang, CASE WHEN inc > 0 THEN inc ELSE 1 END AS inc, ts FROM ev),
gone AS (SELECT word, max(ts) AS gone_at FROM k WHERE op = 'remove' GROUP BY word),
ud AS (SELECT k.word, lang, sum(inc)::BIGINT AS frequency, min(ts) AS created_at, max(ts) AS last_used FROM k LEFT JOIN gone USING (word) WHERE op = 'add' AND (gone_at IS NULL OR ts > gone_at) GROUP BY ALL)"""


@query("user_dict", f"WITH {_USER_DICT} SELECT * FROM ud")
def user_dict(spark, sf):
    return B.upsert_user_words(None, user_events(spark, sf)).drop("source")


@query("in_user_dict", f"WITH {_USER_DICT} SELECT DISTINCT user_id FROM events WHERE 'u' || user_id IN (SELECT word FROM ud)")
def in_user_dict(spark, sf):
    e = _t(spark, sf, "events").withColumn("word", F.concat(F.lit("U"), F.col("user_id").cast("string")))
    return B.in_user_dict(e, user_dict(spark, sf), "en").select("user_id").distinct()


@query("dict_stats", f"WITH {_USER_DICT} SELECT lang, count(*) AS n_words FROM ud GROUP BY lang")
def dict_stats(spark, sf):
    return B.dict_stats(user_dict(spark, sf))


@query("list_words", f"WITH {_USER_DICT} SELECT word, frequency, row_number() OVER (ORDER BY frequency DESC, word) - 1 AS pos FROM ud")
def list_words(spark, sf):
    return number_rows(B.list_words(user_dict(spark, sf), "en").select("word", "frequency"), "pos")


@query("build_dictionary", f"WITH {_WORDS}, {_USER_DICT} SELECT 'en' AS lang, word, sum(freq)::BIGINT AS freq FROM (SELECT word, freq FROM words UNION ALL SELECT word, frequency + 1 FROM ud) GROUP BY word")
def build_dictionary(spark, sf):
    return B.build_dictionary(corpus_words(spark, sf), user_dict(spark, sf), "en")


def _stems(spark, sf):
    """Stems with flags and rules, made from the corpus: every word of the dictionary may take -s, -ed and re-."""
    w = corpus_words(spark, sf)
    line_no = F.xxhash64("word").bitwiseAND(F.lit((1 << 62) - 1)) + 1
    return w.select(line_no.alias("line_no"), F.concat("word", F.when(F.length("word") > 4, "/SDR").otherwise("")).alias("line"))


@query("affix_words", f"""WITH {_WORDS}, s AS (SELECT word, greatest(1, 1000 - 10 * octet_length(encode(word))) AS freq, length(word) > 4 AS flagged FROM words),
m AS (SELECT word AS made, freq, NOT flagged AS sets, true AS own, word AS stem FROM s UNION ALL SELECT word || 's', freq, false, false, word FROM s WHERE flagged
  UNION ALL SELECT word || 'd', freq, false, false, word FROM s WHERE flagged AND word LIKE '%e' UNION ALL SELECT 're' || word, freq, false, false, word FROM s WHERE flagged)
SELECT made AS word, count(*) AS n_stems FROM m GROUP BY made""")
def affix_words(spark, sf):
    stems = _cut(B.parse_dic(_stems(spark, sf)))
    lines = ["SFX S Y 1", "SFX S 0 s .", "SFX D Y 1", "SFX D 0 d e", "PFX R Y 1", "PFX R 0 re ."]
    aff = spark.range(1).select(F.posexplode(F.array(*map(F.lit, lines))).alias("line_no", "line"))
    rules = B.parse_aff(aff)
    made = B.expand_affixes(stems, rules)
    back = made.select("word").join(
        stems.select("word").unionByName(
            stems.where("flags <> ''").select(F.explode(F.array(F.concat("word", F.lit("s")), F.when(F.col("word").endswith("e"), F.concat("word", F.lit("d"))), F.concat(F.lit("re"), "word"))).alias("word"))
        ),
        "word",
    )
    return back.groupBy("word").agg(F.count("*").alias("n_stems"))


@query("spell_check_mixed", rf"""WITH {_WORDS}, d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE {_HAN_SQL.format("text")} END AS text FROM documents), m AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM d)
SELECT doc_id, word, 'en' AS lang, count(*) AS n FROM m WHERE {_CHECKABLE} AND lower(word) NOT IN (SELECT word FROM words) GROUP BY ALL""")
def spell_check_mixed(spark, sf):
    """Mixed mode: English texts, and others with their letters made CJK characters, whose segments are words of the zh list or single, and so no errors."""
    words = _cut(corpus_words(spark, sf))
    zh = words.where(F.length("word") > 1).select(_han(F.col("word")).alias("word"), "freq").unionByName(words.limit(1).select(F.lit("的").alias("word"), "freq"))
    text = F.when(F.col("lang") == "en", F.col("text")).otherwise(_han(F.col("text")))
    found = C.spell_check(_t(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id", "text", {"en": words, "zh": zh}, lang="mixed")
    return found.groupBy("doc_id", "word", "lang").agg(F.count("*").alias("n"))


_CUT2 = "list_distinct(list_concat([{0}], list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)), flatten(list_transform(range(1, length({0})), lambda i: list_transform(range(i + 1, length({0}) + 1), lambda j: substr({0}, 1, i - 1) || substr({0}, i + 1, j - i - 1) || substr({0}, j + 1))))))"
@query("deletes_index", f"""WITH {_WORDS} SELECT word, unnest({_CUT2.format("word")}) AS delete FROM words WHERE length(word) > 2 UNION ALL SELECT word, unnest(CASE WHEN length(word) = 2 THEN list_distinct([word, word[1], word[2]]) ELSE [word] END) FROM words WHERE length(word) <= 2""")
def deletes_index(spark, sf):
    return B.deletes_index(corpus_words(spark, sf), 2).select("word", "delete")


# Within two edits: a word never becomes empty, so that words of one letter have no variants but themselves.
_NEAR = f"""WITH {_WORDS}, q AS (SELECT DISTINCT lower(word) AS query FROM tok WHERE {_CHECKABLE} AND lower(word) NOT IN (SELECT word FROM words)),
dq AS (SELECT * FROM (SELECT query, unnest({_CUT2.format("query")}) AS d FROM q) WHERE d <> ''),
dw AS (SELECT * FROM (SELECT word, freq, unnest({_CUT2.format("word")}) AS d FROM words) WHERE d <> ''),
c AS (SELECT DISTINCT query, word, freq FROM dq JOIN dw USING (d) WHERE query <> word AND abs(length(query) - length(word)) <= 2)"""
# Optimal string alignment up to 2: plain edits, or a swap of neighbours that nothing comes between, and one more edit or swap on one side.
_ONE = "(levenshtein({0}, {1}) <= 1 OR (length({0}) > 1 AND length({1}) > 1 AND damerau_levenshtein({0}, {1}) <= 1))"
_SIDE = "CASE WHEN {0} = {1} THEN 0 WHEN length({0}) = 0 OR length({1}) = 0 THEN abs(length({0}) - length({1})) WHEN " + _ONE + " THEN 1 ELSE 2 END"
_SWAP = "list_bool_or(list_transform(range(1, length(query)), lambda i: list_bool_or(list_transform([i - 1, i, i + 1], lambda j: j >= 1 AND j < length(word) AND query[i] = word[j + 1] AND query[i + 1] = word[j] AND ({0}) + ({1}) <= 1))))".format(
    _SIDE.format("query[1:i - 1]", "word[1:j - 1]"), _SIDE.format("query[i + 2:]", "word[j + 2:]")
)
def _best(n: int) -> str:
    """The n best words of each query."""
    return f"""{_NEAR}, l AS (SELECT *, levenshtein(query, word) AS lev FROM c), s AS (SELECT *, CASE WHEN lev <= 1 THEN lev WHEN length(query) > 1 AND length(word) > 1 AND damerau_levenshtein(query, word) <= 1 THEN 1 WHEN lev <= 2 OR {_SWAP} THEN 2 ELSE 3 END AS distance FROM l WHERE lev <= 4),
k AS (SELECT query, word, distance::INT AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, abs(length(query) - length(word)), freq DESC, word)::INT AS rank FROM s WHERE distance <= 2
QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, abs(length(query) - length(word)), freq DESC, word) <= {n})"""


_RANKED = _best(3)


@query("fuzzy_candidates", f"{_NEAR} SELECT query, word FROM c")
def fuzzy_candidates(spark, sf):
    words, misses = words_and_misses(spark, sf)
    return C.fuzzy_candidates(misses, B.deletes_index(words, 2), 2).select("query", "word")


@query("rank_candidates", f"{_RANKED} SELECT * FROM k")
def rank_candidates(spark, sf):
    words, misses = words_and_misses(spark, sf)
    return C.suggest(misses, words, 3, 2).select("query", "word", "distance", "rank")


@query("spell_suggestions", f"""{_RANKED}, g AS (SELECT query, string_agg(word, ',' ORDER BY rank) AS suggestions FROM k GROUP BY query),
t AS (SELECT doc_id, text, {_TOKENS} AS ws, regexp_split_to_array(text, '[A-Za-z0-9][A-Za-z0-9''-]*|[㐀-䶿一-鿿]') AS gaps FROM documents),
u AS (SELECT doc_id, i - 1 AS tok_idx, ws[i] AS word, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t))
SELECT doc_id, tok_idx::INT AS tok_idx, u.word, start::INT AS start, coalesce(suggestions, '') AS suggestions FROM u JOIN q ON lower(u.word) = q.query LEFT JOIN g ON g.query = q.query""")
def spell_suggestions(spark, sf):
    """Every misspelt token with its three best corrections within two edits."""
    found = C.spell_check(_t(spark, sf, "documents"), "doc_id", "text", {"en": _cut(corpus_words(spark, sf))}, n=3)
    return found.select("doc_id", "tok_idx", "word", "start", F.array_join("suggestions", ",").alias("suggestions"))


@query("spell_check", f"""{_best(8)}, g AS (SELECT query, string_agg(word, ',' ORDER BY rank) AS suggestions FROM k GROUP BY query)
SELECT doc_id, tok.word, coalesce(suggestions, '') AS suggestions, count(*) AS n FROM tok JOIN q ON lower(tok.word) = q.query LEFT JOIN g ON g.query = q.query GROUP BY ALL""")
def spell_check(spark, sf):
    """Misspelt words of each document with their eight best corrections, and how often they occur."""
    found = C.spell_check(_t(spark, sf, "documents"), "doc_id", "text", {"en": _cut(corpus_words(spark, sf))})
    return found.groupBy("doc_id", "word", F.array_join("suggestions", ",").alias("suggestions")).agg(F.count("*").alias("n"))


@query("edit_distance", "SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::INT AS distance FROM part a JOIN part b ON a.p_partkey = b.p_partkey + 1")
def edit_distance(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", "p_name")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, F.col("a") == F.col("b") + 1).select("a", "b", F.levenshtein("x", "y").alias("distance"))


@query("osa_distance")
def osa(spark, sf):
    """Optimal string alignment of each customer name with the segment's: SQL has the unrestricted form only."""
    c = _t(spark, sf, "customer")
    return c.select("c_custkey", S.osa_distance(F.lower("c_name"), F.lower("c_mktsegment")).alias("distance"))


@query("mark_errors", f"""WITH {_WORDS}, e AS (SELECT DISTINCT doc_id, lower(word) AS word FROM tok WHERE {_CHECKABLE} AND lower(word) NOT IN (SELECT word FROM words))
SELECT e.doc_id, e.word, (len(string_split(lower(d.text), e.word)) - 1)::BIGINT AS n FROM e JOIN documents d USING (doc_id)""")
def mark_errors(spark, sf):
    docs = _t(spark, sf, "documents")
    errors = C.misspelt(docs, "doc_id", "text", _cut(corpus_words(spark, sf))).select("doc_id", "word", F.array().cast("array<string>").alias("suggestions"))
    runs = docs.select("doc_id", F.lit(0).alias("run_idx"), F.col("text").alias("content"))
    return C.mark_errors(runs, errors).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


# Documents ----------------------------------------------------------------------------------------------------------


def _lines(spark, sf):
    return M.text_lines(_t(spark, sf, "documents"), "doc_id", "text")


@query("compare_docs", r"""
WITH l AS (SELECT source, doc_id % 2 AS side, trim(unnest(string_split(text, chr(10)))) AS text FROM documents), p AS (SELECT DISTINCT source, side, text FROM l WHERE text <> '')
SELECT source, md5(text) AS digest, CASE WHEN side = 1 THEN 'add' ELSE 'del' END AS change FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.source = a.source AND b.text = a.text AND b.side <> a.side)""")
def compare_docs(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("text"))
    c = D.compare_docs(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "source")
    return c.select("source", F.md5("text").alias("digest"), "change")


#: Lines that begin with some letters made headings, items, quotes, fences and tables.
_STYLES = (("A-B", "## "), ("C-D", "- "), ("E-F", "1. "), ("G-H", "> "), ("I", "```\n"), ("J", "| k | v |\n|---|:-:|\n| a | b |\n\n"))
_STYLED_SQL = functools.reduce(lambda x, m: rf"regexp_replace({x}, '(?m)^([{m[0]}])', '{m[1]}\1', 'g')", _STYLES, "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")
_STYLED = f"""ln AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split({_STYLED_SQL}, chr(10)) AS ls FROM documents))),
f AS (SELECT *, line LIKE '```%' AS fence, sum((line LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM ln),
plain AS (SELECT * FROM f WHERE NOT fence AND fences % 2 = 0),
bl AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^#+ ') THEN 'heading' WHEN regexp_matches(line, '^[-*] ') THEN 'bullet' WHEN regexp_matches(line, '^\\d\\. ') THEN 'ordered' WHEN starts_with(line, '> ') THEN 'quote'
  WHEN line = '| k | v |' THEN 'table' ELSE 'paragraph' END AS block_type FROM plain WHERE trim(line) <> '' AND line NOT IN ('|---|:-:|', '| a | b |')
  UNION ALL SELECT doc_id, 'code' FROM (SELECT doc_id, unnest(range(0, (max(fences) + 1)::BIGINT // 2)) FROM f GROUP BY doc_id))"""


def _styled(spark, sf):
    text = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\r", "\n")
    text = functools.reduce(lambda x, m: F.regexp_replace(x, f"(?md)^([{m[0]}])", f"{m[1]}$1"), _STYLES, text)
    return _t(spark, sf, "documents").select("doc_id", text.alias("text"))


@query("markdown_toc", rf"""WITH {_STYLED} SELECT doc_id, line_no::INT AS line_no, length(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 1))::INT AS level, regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 2) AS title
FROM plain WHERE regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$')""")
def markdown_toc(spark, sf):
    return M.markdown_toc(_styled(spark, sf), "doc_id", "text").select("doc_id", "line_no", "level", "title")


@query("markdown_blocks", rf"""WITH {_STYLED} SELECT doc_id, block_type, count(*) AS n FROM bl GROUP BY ALL""")
def markdown_blocks(spark, sf):
    """Blocks of every kind, as lines that begin with some letters are made headings, items, quotes, fences and tables."""
    return M.markdown_blocks(_styled(spark, sf), "doc_id", "text").groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


_MARKS = {" the ": " **the** ", " de ": " *de* ", " und ": " `und` ", " of ": " [of](http://x) ", " le ": " ![le](y.png) "}
_MARKED = functools.reduce(lambda x, m: f"replace({x}, '{m[0]}', '{m[1]}')", _MARKS.items(), "text")


@query("markdown_inlines", rf"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace({_MARKED}, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents),
b AS (SELECT doc_id, regexp_replace(line, '^(#+ |[-*] |\d\. |> )', '') AS t FROM l WHERE trim(line) <> '' AND trim(line) NOT LIKE '|%'),
p AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?s){M._INLINE}')) AS p FROM b UNION ALL SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '(?s){M._INLINE}'), lambda x: x <> '')) || chr(0) FROM b)
SELECT doc_id, CASE WHEN p LIKE '%' || chr(0) THEN 'text' WHEN p LIKE '**%' THEN 'bold' WHEN p LIKE '*%' THEN 'italic' WHEN p LIKE '`%' THEN 'code' WHEN p LIKE '!%' THEN 'image' ELSE 'link' END AS kind, count(*) AS n FROM p GROUP BY ALL""")
def markdown_inlines(spark, sf):
    """Some words set in bold, italic, as code, links and images."""
    text = functools.reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), _MARKS.items(), F.col("text"))
    docs = _t(spark, sf, "documents").select("doc_id", text.alias("text"))
    return M.markdown_inlines(M.markdown_blocks(docs, "doc_id", "text")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("markdown_tables")
def markdown_tables(spark, sf):
    """Tables of orders written as Markdown, one document per customer, read back."""
    return M.markdown_tables(_order_markdown(spark, sf), "doc_id", "text").select("doc_id", "row", "col", "value", "is_header")


def _order_markdown(spark, sf):
    o = _t(spark, sf, "orders")
    line = F.concat_ws("|", F.lit(""), F.col("o_orderkey").cast("string"), "o_orderstatus", F.lit(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n")
    head = "# Orders\n\n| key | status |\n|---|:-:|\n"
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit(head), body, F.lit("\n\nend")).alias("text"))


ORACLES["markdown_tables"] = """WITH r AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row FROM orders)
SELECT doc_id, row, 0 AS col, o_orderkey::VARCHAR AS value, false AS is_header FROM r UNION ALL SELECT doc_id, row, 1, o_orderstatus, false FROM r
UNION ALL SELECT DISTINCT doc_id, 0, 0, 'key', true FROM r UNION ALL SELECT DISTINCT doc_id, 0, 1, 'status', true FROM r"""


def _headings(spark, sf):
    """Events as headings: level from the event's number, a document per user."""
    e = _t(spark, sf, "events")
    return D.headings(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("block_idx"), (F.col("event_id") % 7 % 3 + 1).cast("int").alias("level"), F.lit("heading").alias("block_type"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("text")))


_HEADS = "h AS (SELECT user_id AS doc_id, event_id AS block_idx, (event_id % 7 % 3 + 1)::INT AS level, CASE WHEN event_id % 5 > 0 THEN event_type END AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS heading_no FROM events)"


@query("headings", f"WITH {_HEADS} SELECT doc_id, heading_no, level, coalesce(text, '标题 ' || heading_no) AS text FROM h")
def headings(spark, sf):
    return _headings(spark, sf).select("doc_id", "heading_no", "level", "text")


_NUMBERED = f"""WITH {_HEADS}, g AS (SELECT *, sum((level < 1)::INT) OVER w AS g1, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY heading_no)),
n AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc_id, g1 ORDER BY heading_no) AS n1, sum((level = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY heading_no) AS n2, sum((level = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY heading_no) AS n3 FROM g),
o AS (SELECT *, array_to_string(list_filter([CASE WHEN n1 > 0 THEN n1::INT END, CASE WHEN level >= 2 AND n2 > 0 THEN n2::INT END, CASE WHEN level >= 3 AND n3 > 0 THEN n3::INT END], lambda x: x IS NOT NULL), '.') AS number FROM n)"""


@query("number_outline", _NUMBERED + " SELECT doc_id, heading_no, number FROM o")
def number_outline(spark, sf):
    return D.number_outline(_headings(spark, sf), 3).select("doc_id", "heading_no", "number")


@query("build_toc", _NUMBERED + " SELECT doc_id, heading_no, repeat('　', level - 1) || number || '  ' || coalesce(text, '标题 ' || heading_no) AS line, 'heading-' || block_idx AS target FROM o")
def build_toc(spark, sf):
    return D.build_toc(_headings(spark, sf))


@query("outline_level", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size ELSE (p_size % 10)::INT END AS level FROM part WHERE p_size % 3 = 0 OR p_size % 10 > 0")
def outline_level(spark, sf):
    p = _t(spark, sf, "part")
    style = F.concat(F.lit("Heading "), (F.col("p_size") % 10).cast("string"))
    return p.select("p_partkey", S.outline_level(style, F.when(F.col("p_size") % 3 == 0, F.col("p_size"))).alias("level")).where("level is not null")


@query("join_comments", """WITH c AS (SELECT conv_id, turn, role, text FROM conversations) SELECT a.conv_id, a.turn, b.role AS comment_author, b.text AS comment_text FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def join_comments(spark, sf):
    """Each turn as a run, anchored to the comment that the next turn is."""
    c = _t(spark, sf, "conversations")
    runs = c.select(F.col("conv_id").alias("doc_id"), "turn", (F.col("turn") + 1).cast("string").alias("comment_id"))
    comments = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("id"), F.col("role").alias("author"), F.col("text").alias("content"))
    return D.join_comments(runs, comments).select(F.col("doc_id").alias("conv_id"), "turn", "comment_author", "comment_text")


@query("comments_by_author", "SELECT role AS author, count(*) AS n_comments FROM conversations GROUP BY role")
def comments_by_author(spark, sf):
    return D.comments_by_author(_t(spark, sf, "conversations").withColumnRenamed("role", "author"))


@query("number_footnotes", """WITH r AS (SELECT user_id, event_id, (event_id % 7 - 1)::INT AS note FROM events), f AS (SELECT user_id, note, min(event_id) AS first FROM r WHERE note NOT IN (-1, 0) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first)::INT AS footnote_no FROM f) SELECT user_id, event_id, note, footnote_no FROM r JOIN n USING (user_id, note)""")
def number_footnotes(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 7 - 1).cast("int").alias("note"))
    return D.number_footnotes(e, "user_id", "note", "event_id")


@query("group_lists", """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, sum(starts) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS list_no FROM c""")
def group_lists(spark, sf):
    return D.group_lists(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], ["event_type"]).select("user_id", "event_id", "list_no")


@query("change_ranges", """WITH r AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'view' THEN 'insert' WHEN 'click' THEN 'delete' END AS kind FROM events),
c AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS starts FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c),
a AS (SELECT user_id, island, kind, count(*) AS n_runs, string_agg(event_type, '' ORDER BY event_id) AS text FROM g WHERE kind IS NOT NULL GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY island)::INT AS range_no, kind, n_runs, text FROM a""")
def change_ranges(spark, sf):
    kind = F.when(F.col("event_type") == "view", "insert").when(F.col("event_type") == "click", "delete")
    return D.change_ranges(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], kind, "event_type")


def _tracked(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "insert").when(F.col("event_type") == "click", "delete").alias("track"))


@query("accept_changes", "SELECT event_id, NULL::VARCHAR AS track FROM events WHERE event_type <> 'click'")
def accept_changes(spark, sf):
    return D.accept_changes(_tracked(spark, sf))


@query("reject_changes", "SELECT event_id, NULL::VARCHAR AS track FROM events WHERE event_type <> 'view'")
def reject_changes(spark, sf):
    return D.reject_changes(_tracked(spark, sf))


@query("element_counts", f"WITH {_STYLED} SELECT doc_id, count(*) FILTER (block_type = 'heading') AS n_heading, count(*) FILTER (block_type = 'bullet') AS n_bullet, count(*) AS n_blocks FROM bl GROUP BY doc_id")
def element_counts(spark, sf):
    return D.element_counts(M.markdown_blocks(_styled(spark, sf), "doc_id", "text"), ["heading", "bullet"])


@query("elements", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '(?m)^([A-M])', '- \1', 'g'), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[-*] ') GROUP BY doc_id")
def elements(spark, sf):
    """Lines that begin with A to M made items of a list, and picked."""
    docs = _t(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"(?md)^([A-M])", "- $1").alias("text"))
    return D.elements(M.markdown_blocks(docs, "doc_id", "text"), "bullet").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("doc_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def doc_text(spark, sf):
    return D.doc_text(_t(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", "\n")


@query("doc_stats", r"WITH d AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT doc_id, length(t)::INT AS chars, len(list_filter(regexp_split_to_array(t, '[\s\x{00a0}]+'), lambda x: x <> ''))::INT AS words FROM d")
def doc_stats(spark, sf):
    c = _t(spark, sf, "conversations")
    return T.doc_stats(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), "text"))


def _slides(spark, sf):
    """Conversations as slides: a turn is a slide, its role the title, its lines the bullets."""
    c = _t(spark, sf, "conversations")
    body = F.to_json(F.struct(F.col("role").alias("title"), F.split("text", "\n").alias("bullets"), F.array(F.struct(F.lit("1").alias("x"), F.lit("z").alias("y"), F.col("turn").cast("string").alias("w"), F.lit("3").alias("h"), F.col("role").alias("text"))).alias("shapes")))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("slide_no"), body.alias("body"))


@query("slides_table", "SELECT conv_id AS doc_id, turn AS slide_no, role AS title, md5(text) AS digest, '' AS notes, 1 AS n_shapes FROM conversations")
def slides_table(spark, sf):
    return D.slides_table(_slides(spark, sf)).select("doc_id", "slide_no", "title", F.md5("bullets").alias("digest"), "notes", "n_shapes")


@query("slide_shapes", "SELECT conv_id AS doc_id, turn AS slide_no, 0 AS shape_no, 1.0::DOUBLE AS x, 0.0::DOUBLE AS y, turn::DOUBLE AS w, 3.0::DOUBLE AS h, role AS text FROM conversations")
def slide_shapes(spark, sf):
    return D.slide_shapes(_slides(spark, sf))


_S = "'(?is)<{t}\\b[^>]*>.*?</{t}\\s*>'"


_ACTIVE = (
    """<a onclick="x('y')" on_x=1 ON1='"' title="on y">a</a><a href="javascript:f()">b</a><img src= 'data:text/html,x'><a HREF=javascript:g(1)>c</a><iframe><form></iframe>d</form >"""
    """<svg onload=z><math></svg></math><noscript>e</noscript><script>if (a < b) {}</script ><p onx = y>f</p><input><object data="x">g</object>"""
)


def _sanitise_sql() -> str:
    """Every rule as one replacement of RE2, which has neither look-ahead nor back-reference: a branch for each element."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    x = f"({quoted(_ACTIVE)} || html)"
    every = (*M.REMOVED, *M.WITH_CONTENT)
    steps = [(f"(?is)<{t}\\b.*?</{t}>", "") for t in M.WITH_CONTENT]
    steps += [("(?is)" + "|".join(f"<{t}\\b[^>]*>.*?</{t}>" for t in M.REMOVED), ""), ("(?is)" + "|".join(f"</?{t}\\b[^>]*>" for t in every), "")]
    steps += [("(?i)\\s+on\\w+\\s*=\\s*" + q, "") for q in ('"[^"]*"', "'[^']*'", "[^\\s>]+")]
    steps += [(f"(?i)(href|src)\\s*=\\s*{q}\\s*{kind}[^{q}]*{q}", '\\1="#"') for kind in ("javascript:", "data:text/html") for q in ('"', "'")]
    steps += [("(?i)(href|src)\\s*=\\s*javascript:[^\\s>]+", '\\1="#"')]
    for pattern, new in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"SELECT page_id, md5({x}) AS digest FROM pages"


@query("sanitize_html", _sanitise_sql())
def sanitize_html(spark, sf):
    """Pages with active content of every kind put in front."""
    return _t(spark, sf, "pages").select("page_id", F.md5(M.sanitize_html(F.concat(F.lit(_ACTIVE), "html"))).alias("digest"))


@query("escape_html", """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM pages""")
def escape_html(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.md5(S.escape_html(F.col("html"))).alias("digest"))


@query("fold_math", r"""SELECT p_partkey, 'a $' || trim(regexp_replace(p_name || chr(10) || '  ' || p_type, '\s+', ' ', 'g')) || '$ b $$' || trim(regexp_replace(p_type || '  ' || p_brand, '\s+', ' ', 'g')) || '$$' AS folded FROM part""")
def fold_math(spark, sf):
    p = _t(spark, sf, "part")
    text = F.concat(F.lit("a $"), "p_name", F.lit("\n  "), "p_type", F.lit("$ b $$"), "p_type", F.lit("  "), "p_brand", F.lit("$$"))
    return p.select("p_partkey", S.fold_math(text).alias("folded"))


@query("slugify", r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(' ' || p_name || ' (' || p_brand || ')'), '[^\w一-龥\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM part")
def slugify(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", S.slugify(F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))
