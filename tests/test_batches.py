"""Map-only steps hold a bounded number of rows, whatever a batch of documents makes."""

import pyarrow as pa
from pyspark.sql import functions as F

from folioframe.operators import text as T
from folioframe.plans.batches import ROWS, made_rows


def test_rows_leave_in_short_batches():
    ids, texts = pa.array([1, 2, 3]), pa.array(["x" * 40_000, None, "x" * 10])
    batch = pa.RecordBatch.from_arrays([ids, texts], ["id", "text"])
    out = list(made_rows([batch], lambda t: ((k, c) for k, c in enumerate(t or "")), ["id", "k", "c"], [pa.int32(), pa.string()]))
    assert max(b.num_rows for b in out) <= ROWS
    table = pa.Table.from_batches(out)
    assert table["id"].to_pylist() == [1] * 40_000 + [3] * 10
    assert table["k"].to_pylist() == [*range(40_000), *range(10)]


def test_segments_are_those_of_segment_cjk(spark):
    docs = spark.createDataFrame([(1, "一七三x一七"), (2, ""), (3, None), (4, "ab")] + [(k, "一七" * 20_000) for k in (5, 6)], "id int, text string")
    words = spark.createDataFrame([("一七",), ("七三",)], "word string")
    rows = T.segment_cjk(docs, "id", "text", words)
    packed = T.segments(docs, "id", "text", words)
    flat = packed.select("id", F.posexplode("segments").alias("seg_idx", "s")).select("id", "seg_idx", "s.word", "s.start", "s.stop")
    assert rows.exceptAll(flat).isEmpty() and flat.exceptAll(rows).isEmpty()
    first = packed.where("id = 1").first().segments
    assert [(s.word, s.start, s.at) for s in first] == [("一七", 0, 0), ("三", 2, 0), ("x", 3, 3), ("一七", 4, 4)]
    assert {r.id: r.n for r in packed.select("id", F.size("segments").alias("n")).collect()} == {1: 4, 2: 0, 3: 0, 4: 1, 5: 20_000, 6: 20_000}
