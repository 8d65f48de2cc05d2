"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Each passage becomes a vector: shares of hashed words and of
hashed three-byte strings, classes of bytes, word lengths, repetition. A layer encodes it, gated attention weighs the
passages of the document, and the weighted sum is scored. The weights are learnt from document labels alone, by gradient
descent over small batches of a bounded sample of labelled documents (SAMPLE of them, by a hash of doc_id, with texts of
SAMPLE_BYTES at most), with all their passages.

The sample's features reach the driver, which learns a few thousand weights; every document is then scored where it
lies, in one pass without a shuffle, its whole text. A task works through texts in slices of SLICE_BYTES.

Defined results: a null or empty text is one passage of zeros; null or missing labels are not learnt from; a doc_id
with several labels is good if one of them is; of rows that share a doc_id the greatest text is learnt from; with
labels of one kind only, or none, every score is their share, or a half; repeated rows score alike; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, checkpoint, read

PASSAGE_WORDS = 50
#: Labelled documents that are learnt from at most, and the bytes of their texts: their features take some two times as many.
SAMPLE = 4_000
SAMPLE_BYTES = 32 << 20
SLICE_BYTES = 1_000_000
THRESHOLD = 0.3
HIDDEN, ATTENTION = 16, 8
#: Passes over the sample, documents of a batch, learning rate, decay of the weights.
EPOCHS, BATCH, RATE, DECAY = 16, 128, 0.01, 1e-4
#: Hash buckets of words, and of three-byte strings.
WORD_BUCKETS = GRAM_BUCKETS = 64

#: Classes of bytes; those not named are the last class.
_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b";:", b"-", b"'\"`", b"()[]{}",
    b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"@", b"/\\", b"_", b"=+~^", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)),
)
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
CLASSES = len(_GROUPS) + 1
FEATURES = CLASSES + 6 + WORD_BUCKETS + GRAM_BUCKETS
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features [passage, FEATURES], document of each passage) of a slice of texts, every document with one passage at least."""
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = _SPACE[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stops = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    doc = np.searchsorted(ends, starts, side="right")
    words = np.bincount(doc, minlength=len(texts))
    within = np.arange(len(starts)) - (np.cumsum(words) - words)[doc]
    passages = np.maximum(-(-words // PASSAGE_WORDS), 1)
    first = np.cumsum(passages) - passages
    of_word = first[doc] + within // PASSAGE_WORDS
    count = int(passages.sum())
    # A byte belongs to the passage of the word that began last, if that is in its own document.
    of_doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    at = np.searchsorted(starts, np.arange(len(data)), side="right") - 1
    of_byte = np.where((at >= 0) & (doc[at] == of_doc), of_word[at], first[of_doc]) if len(starts) else first[of_doc]
    shares = np.bincount(of_byte * CLASSES + _CLASS[data], minlength=count * CLASSES).reshape(count, CLASSES).astype(np.float64)
    size = np.maximum(shares.sum(axis=1), 1)
    n = np.bincount(of_word, minlength=count).astype(np.float64)
    safe = np.maximum(n, 1)
    length = (stops - starts).astype(np.float64)
    # Polynomial hashes of words from sums over the bytes; the power at the start is divided out by its inverse.
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), base)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(pow(int(base), -1, 1 << 64)))]))
    hashes = (sums[stops] - sums[starts]) * inverse[starts]
    keyed = hashes ^ (of_word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    kinds = np.bincount(of_word[np.unique(keyed, return_index=True)[1]], minlength=count)
    again = np.bincount(of_word[1:], weights=(hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1]), minlength=count) if len(starts) > 1 else np.zeros(count)
    capital = np.bincount(of_word, weights=(data[starts] >= 65) & (data[starts] <= 90), minlength=count) if len(starts) else np.zeros(count)
    mean = np.bincount(of_word, weights=length, minlength=count) / safe
    spread = np.sqrt(np.maximum(np.bincount(of_word, weights=length**2, minlength=count) / safe - mean**2, 0))
    bucket = (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(58)).astype(np.int64)
    words_of = np.bincount(of_word * WORD_BUCKETS + bucket, minlength=count * WORD_BUCKETS).reshape(count, WORD_BUCKETS) / safe[:, None]
    low = data.astype(np.uint32)
    gram = (((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int64) if len(data) > 2 else np.empty(0, np.int64)
    grams = np.bincount(of_byte[: len(gram)] * GRAM_BUCKETS + gram, minlength=count * GRAM_BUCKETS).reshape(count, GRAM_BUCKETS) / size[:, None]
    features = np.column_stack([shares / size[:, None], n / PASSAGE_WORDS, mean / 10, spread / 10, kinds / safe, again / safe, capital / safe, words_of, grams])
    return features, np.repeat(np.arange(len(texts)), passages)


class AttentionModel:
    """Gated attention over encoded passages: the weights, their learning, and scores of bags."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed).normal
        self.shift, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.w = {
            "E": draw(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": draw(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "U": draw(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "a": draw(0, ATTENTION**-0.5, ATTENTION), "c": draw(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, bag: np.ndarray, bags: int):
        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = np.clip((v * u) @ w["a"], -30, 30)
        e = np.exp(s)
        share = e / np.bincount(bag, weights=e, minlength=bags)[bag]
        z = np.column_stack([np.bincount(bag, weights=share * h[:, j], minlength=bags) for j in range(h.shape[1])])
        return h, v, u, share, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))

    def gradients(self, x: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of the bags' labels, by weight."""
        w, bags = self.w, len(labels)
        h, v, u, share, z, p = self._forward(x, bag, bags)
        d = (p - labels) / bags
        dz = d[:, None] * w["c"]
        dh = share[:, None] * dz[bag]
        ds = np.einsum("ij,ij->i", h, dz[bag])
        ds = share * (ds - np.bincount(bag, weights=share * ds, minlength=bags)[bag])
        dv, du = ds[:, None] * w["a"] * u * (1 - v**2), ds[:, None] * w["a"] * v * u * (1 - u)
        dh += dv @ w["V"].T + du @ w["U"].T
        de = dh * (1 - h**2)
        return {"E": x.T @ de, "e": de.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}

    def learn(self, features: np.ndarray, bag: np.ndarray, labels: np.ndarray, seed: int = 11) -> AttentionModel:
        """Adam over batches of documents; bag numbers the documents, a document's passages side by side."""
        self.shift, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        w, order, step = self.w, np.random.default_rng(seed), 0
        first, stop = np.searchsorted(bag, np.arange(len(labels))), np.searchsorted(bag, np.arange(len(labels)), "right")
        m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        for _ in range(EPOCHS):
            mixed = order.permutation(len(labels))
            for at in range(0, len(labels), BATCH):
                some = mixed[at : at + BATCH]
                rows = np.concatenate([np.arange(first[i], stop[i]) for i in some])
                x = np.clip((features[rows] - self.shift) / self.scale, -8, 8)
                g = self.gradients(x, np.repeat(np.arange(len(some)), stop[some] - first[some]), labels[some])
                step += 1
                for k in w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    w[k] -= RATE * (m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8) + DECAY * w[k])
        return self

    def score(self, features: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        return self._forward(np.clip((features - self.shift) / self.scale, -8, 8), bag, bags)[-1]


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, budget: int = SAMPLE_BYTES) -> AttentionModel | float:
    """A model learnt from labels (doc_id, quality) that are not held out; their share if they are of one kind.

    At most `sample` documents, in the order of a hash, and of those only so many that their texts take at most `budget`
    bytes: one that would exceed it is passed over.
    """
    known = labels.where(labels["quality"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy(known["doc_id"].cast("long").alias("id")).agg(F.max((known["quality"] == 1).cast("int")).alias("good"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, good = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            at = 0
            for part in slices([t or b"" for t in texts]):
                x, bag = passage_features(part)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + bag]), pa.array(good[at + bag]), pa.array(list(x.astype(np.float32)))], ["id", "good", "x"])
                at += len(part)

    # At most `sample` rows, so their texts may meet in one group each and be sorted by id.
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"]).join(F.broadcast(chosen), "id").groupBy("id", "good").agg(F.max("text").alias("text"))
    rows = checkpoint(rows.withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))))
    within, held = [], 0
    for r in rows.select("id", "size").orderBy(F.xxhash64("id"), "id").collect():
        if held + r.size <= budget:
            within.append((r.id,))
            held += r.size
    if len(within) < rows.count():
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(within, "id long")), "id", "left_semi")
    found = rows.select("id", "text", "good").mapInArrow(features, "id long, good int, x array<float>").toArrow()
    ids, good = found["id"].to_numpy(), found["good"].to_numpy()
    _, first, bag = np.unique(ids, return_index=True, return_inverse=True)
    if len(set(good[first])) < 2:
        return float(good[first].mean()) if len(good) else 0.5
    by = np.argsort(bag, kind="stable")
    x = np.asarray(found["x"].combine_chunks().flatten()).reshape(-1, FEATURES)[by]
    return AttentionModel().learn(x, bag[by], good[first].astype(np.float64))


def score_documents(docs: DataFrame, model: AttentionModel | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if isinstance(model, float):
                found = np.full(len(texts), model)
            else:
                found = np.concatenate([model.score(*passage_features(part), len(part)) for part in slices(texts)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, learn_quality(docs, read(spark, sf_dir, "labels")))
