"""Document structure over blocks (doc_id, block_idx, block_type, level, style, text) and runs (doc_id, block_idx, run_idx, kind, content, track, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.plans.islands import changes, islands


def compare_docs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, text, change): paragraphs of the right that the left lacks (add), and the reverse (del), as sets of trimmed texts.

    Long texts are joined by a hash first, and by equality.
    """

    def paragraphs(df: DataFrame) -> DataFrame:
        t = df.select(key, F.trim("text").alias("text")).where("text <> ''").distinct()
        return t.withColumn("_h", F.xxhash64("text"))

    a, b = paragraphs(left), paragraphs(right)
    on = [key, "_h", "text"]
    added = b.join(a, on, "left_anti").select(key, "text", F.lit("add").alias("change"))
    return added.unionByName(a.join(b, on, "left_anti").select(key, "text", F.lit("del").alias("change")))


def headings(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_idx, heading_no, level, text) of heading blocks in order; a blank title is `标题 n`."""
    found = blocks.where("level >= 1").withColumn("heading_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx")))
    title = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.concat(F.lit("标题 "), F.col("heading_no").cast("string"))).otherwise(F.col("text"))
    return found.select("doc_id", "block_idx", "heading_no", "level", title.alias("text"))


def number_outline(heads: DataFrame, deepest: int = 9) -> DataFrame:
    """heads with `number`: a counter per level, reset by shallower headings; those that aren't zero joined by dots.

    The count at level k is that of level-k headings since the last shallower one: two running sums per level.
    """
    out = heads
    here = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for k in range(1, deepest + 1):
        out = out.withColumn(f"_g{k}", F.sum((F.col("level") < k).cast("int")).over(here))
        inside = Window.partitionBy("doc_id", f"_g{k}").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_n{k}", F.sum((F.col("level") == k).cast("int")).over(inside))
        parts.append(F.when((F.col(f"_n{k}") > 0) & (F.col("level") >= k), F.col(f"_n{k}").cast("string")))
    return out.withColumn("number", F.concat_ws(".", *parts)).drop(*[f"_{x}{k}" for k in range(1, deepest + 1) for x in "gn"])


def build_toc(heads: DataFrame) -> DataFrame:
    """(doc_id, heading_no, line, target): an ideographic space per level, number, two spaces, title."""
    numbered = number_outline(heads)
    line = F.concat(F.repeat(F.lit("　"), F.col("level") - 1), "number", F.lit("  "), "text")
    return numbered.select("doc_id", "heading_no", line.alias("line"), F.concat(F.lit("heading-"), F.col("block_idx").cast("string")).alias("target"))


def join_comments(runs: DataFrame, comments: DataFrame) -> DataFrame:
    """runs with the comment that each is anchored to, if any: comment_author, comment_text."""
    c = comments.select("doc_id", F.col("id").alias("comment_id"), F.col("author").alias("comment_author"), F.col("content").alias("comment_text"))
    return runs.join(c, ["doc_id", "comment_id"], "left")


def comments_by_author(comments: DataFrame) -> DataFrame:
    return comments.groupBy("author").agg(F.count("*").alias("n_comments"))


def number_footnotes(refs: DataFrame, by: str = "doc_id", note: str = "footnote_id", order: str = "pos") -> DataFrame:
    """refs with footnote_no: by first reference in the document, repeats alike; ids -1 and 0 have none and go."""
    real = refs.where(~F.col(note).cast("string").isin("-1", "0"))
    first = real.groupBy(by, note).agg(F.min(order).alias("_first"))
    numbered = first.withColumn("footnote_no", F.row_number().over(Window.partitionBy(by).orderBy("_first", note)))
    return real.join(numbered.drop("_first"), [by, note])


def footnote_list(numbered: DataFrame, notes: DataFrame, by: str = "doc_id", note: str = "footnote_id") -> DataFrame:
    """(by, footnote_no, note id, text) of referenced notes in the order of their numbers."""
    return numbered.select(by, "footnote_no", note).distinct().join(notes.select(by, note, "text"), [by, note], "left")


def group_lists(rows: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """rows with list_no: consecutive rows that agree in `same` are one list."""
    flagged = rows.withColumn("_starts", changes(same, by, order))
    return islands(flagged, by, order, F.col("_starts"), "list_no").drop("_starts")


def change_ranges(runs: DataFrame, by: list[str], order: list[str], kind: Column, text: str = "content", compat: bool = False) -> DataFrame:
    """(by, range_no, kind, n_runs, text): neighbouring runs with the same mark (insert or delete); others end a range.

    compat drops a range that unmarked text follows, as some editors do.
    """
    marked = runs.withColumn("_kind", kind)
    flagged = marked.withColumn("_starts", changes(["_kind"], by, order))
    grouped = islands(flagged, by, order, F.col("_starts"), "_island")
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    ranges = grouped.groupBy(*by, "_island", "_kind").agg(F.count("*").alias("n_runs"), F.array_join(F.transform(pairs, lambda x: x["_t"]), "").alias("text"))
    if compat:
        nxt = F.lead(F.struct("_kind"), 1).over(Window.partitionBy(*by).orderBy("_island"))
        ranges = ranges.withColumn("_next", nxt).where("_kind is not null and not (_next is not null and _next._kind is null)").drop("_next")
    ranges = ranges.where("_kind is not null")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("_island"))
    return ranges.select(*by, number.alias("range_no"), F.col("_kind").alias("kind"), "n_runs", "text")


def accept_changes(runs: DataFrame) -> DataFrame:
    """Deleted runs go, inserted ones lose their mark."""
    return runs.where("track is null or track <> 'delete'").withColumn("track", F.lit(None).cast("string"))


def reject_changes(runs: DataFrame) -> DataFrame:
    """Inserted runs go, deleted ones lose their mark."""
    return runs.where("track is null or track <> 'insert'").withColumn("track", F.lit(None).cast("string"))


def elements(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where(F.col("block_type") == kind)


def element_counts(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per document: the number of blocks of each kind, and of all."""
    return blocks.groupBy("doc_id").agg(*[F.count_if(F.col("block_type") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_blocks"))


def doc_text(runs: DataFrame, by: list[str], order: list[str], text: str = "content", sep: str = "") -> DataFrame:
    """(by, text): the pieces of a document in order, joined."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    return runs.groupBy(*by).agg(F.array_join(F.transform(pieces, lambda x: x["_t"]), sep).alias("text"))


def slides_table(slides: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, slide_no, title, bullets, notes, n_shapes) of slides (doc_id, slide_no, body: JSON)."""
    shape = "title string, bullets array<string>, notes string, shapes array<struct<x: string, y: string, w: string, h: string, text: string>>"
    s = slides.withColumn("_s", F.from_json(body, shape))
    return s.select("doc_id", "slide_no", F.coalesce("_s.title", F.lit("")).alias("title"), F.coalesce(F.array_join("_s.bullets", "\n"), F.lit("")).alias("bullets"), F.coalesce("_s.notes", F.lit("")).alias("notes"), F.coalesce(F.size("_s.shapes"), F.lit(0)).alias("n_shapes"))


def slide_shapes(slides: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, slide_no, shape_no, x, y, w, h, text): one row per shape, numbers coerced, 0 where there is none."""
    shape = "shapes array<struct<x: string, y: string, w: string, h: string, text: string>>"
    s = slides.select("doc_id", "slide_no", F.posexplode(F.from_json(body, shape)["shapes"]).alias("shape_no", "s"))
    return s.select("doc_id", "slide_no", "shape_no", *[F.coalesce(F.col(f"s.{k}").try_cast("double"), F.lit(0.0)).alias(k) for k in "xywh"], F.coalesce("s.text", F.lit("")).alias("text"))
