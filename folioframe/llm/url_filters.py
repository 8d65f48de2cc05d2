"""URL filters: host and path rules, and trust that spreads over the link graph.

A page that a rule fits gets the rule's verdict; the longest rule wins. For the rest, hosts are judged by two
personalised PageRanks: trust starts from hosts with allowed pages and follows links; distrust starts from hosts
with blocked pages and follows links backwards, to those that point there. Both count pages, whatever their number in
all; a host is blocked where distrust exceeds `margin` times its trust. Masses are spread until no host's changes by
more than TOLERANCE of itself, so a host is reached from any distance.

DataFrame functions only. Links are counted per pair of hosts before any iteration, so a host of a third of all
pages is one node; each turn is a join by host and a partial sum by host, checkpointed every few turns.

Defined results: a null url, or one without "://", has empty host and path, fits no rule, and is allowed unless the
empty host is distrusted, which it never is (it has no links and no seeds); a null html has no links; repeated rows
are judged alike and count each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import broadcast_if_small, checkpoint, read

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING = 0.85
#: Largest change of a host's mass, as a share of it, at which masses count as settled.
TOLERANCE = 1e-4
MARGIN = 1.0
#: Masses that differ by less than this share of them are equal: sums differ so with the order of their terms.
EQUAL = 1e-9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted, from pages (host, html)."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
    dst = host_and_path(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")))[0]
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, mass): personalised PageRank from seeds (host, seed) along edges (src, dst, n), until it is settled.

    A turn's change is at most `damping` times the last one's where no new host is reached, so it ends; only whether it
    is settled reaches the driver, every few turns.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    shares = checkpoint(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    start = checkpoint(seeds.select("host", ((1 - damping) * F.col("seed")).alias("mass")))
    mass = start
    if shares.isEmpty():
        return mass
    while True:
        for _ in range(4):
            before = mass
            moved = shares.join(mass.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (damping * F.col("mass") * F.col("share")).alias("mass"))
            mass = moved.unionByName(start).groupBy("host").agg(F.sum("mass").alias("mass"))
        both = checkpoint(mass.join(before.withColumnRenamed("mass", "before"), "host", "left"))
        mass = both.select("host", "mass")
        if both.where(F.col("before").isNull() | (F.col("mass") - F.col("before") > tolerance * F.col("mass"))).isEmpty():
            return mass


def judge_urls(pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict of pages (page_id, url, html)."""
    host, path = host_and_path(pages["url"])
    split = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("ruled", verdict)
    counts = checkpoint(
        ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    )
    edges = checkpoint(host_links(split.select("host", "html")))
    trust = propagate(counts.where("good > 0").select("host", F.col("good").alias("seed")), edges)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(counts.where("bad > 0").select("host", F.col("bad").alias("seed")), back)
    blocked = distrust.withColumnRenamed("mass", "distrust").join(trust.withColumnRenamed("mass", "trust"), "host", "left")
    blocked = blocked.where(F.col("distrust") > margin * (1 + EQUAL) * F.coalesce("trust", F.lit(0.0))).select(F.col("host").alias("blocked_host"))
    blocked = broadcast_if_small(checkpoint(blocked))
    judged = ruled.drop("html").join(blocked, ruled["host"] == blocked["blocked_host"], "left")
    by_host = F.when(F.col("blocked_host").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _oracle() -> str:
    split = r"""
WITH p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules AS (SELECT * FROM (VALUES """
    split += ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    split += r""") AS t(verdict, rule, rhost, rpath)),
f AS (SELECT page_id, any_value(q.host) AS host, any_value(q.path) AS path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
  FROM q LEFT JOIN rules ON (q.host = rhost OR q.host LIKE '%.' || rhost) AND starts_with(q.path, rpath) GROUP BY page_id),
c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad, count(*) AS n FROM f WHERE host <> '' GROUP BY host),
lk AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS t FROM q),
e AS (SELECT src, lower(regexp_extract(substr(t, instr(t, '//') + 2), '^([^/?#]*)', 1)) AS dst, count(*) AS n FROM lk GROUP BY 1, 2),
g AS (SELECT * FROM e WHERE src <> '' AND dst <> '' AND src <> dst),
s0 AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM g),
s1 AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM g),
t0 AS (SELECT host, 0.15 * good AS mass FROM c WHERE good > 0),
d0 AS (SELECT host, 0.15 * bad AS mass FROM c WHERE bad > 0)"""
    # Eighty turns are settled, at 0.85 a turn, beyond the tolerance of any graph of that width.
    for name, shares in (("t", "s0"), ("d", "s1")):
        split += f""",
{name}(turn, host, mass) AS (SELECT 0, host, mass FROM {name}0 UNION ALL
  SELECT turn, host, sum(mass) FROM (
    SELECT turn + 1 AS turn, dst AS host, 0.85 * mass * share AS mass FROM {name} JOIN {shares} ON src = host WHERE turn < 80
    UNION ALL SELECT turns.turn, host, mass FROM (SELECT turn + 1 AS turn FROM {name} WHERE turn < 80 LIMIT 1) turns, {name}0)
  GROUP BY turn, host)"""
    return split.replace("WITH p", "WITH RECURSIVE p", 1) + f"""
SELECT page_id, f.host, f.path, rule, coalesce(ruled, CASE WHEN coalesce(d.mass, 0) > {1 + EQUAL} * coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN (SELECT * FROM t WHERE turn = 80) t USING (host) LEFT JOIN (SELECT * FROM d WHERE turn = 80) d USING (host)
"""


ORACLE = _oracle()
