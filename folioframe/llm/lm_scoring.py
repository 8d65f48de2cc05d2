"""Scoring texts by context-tree weighting over bytes, and by a word-unigram base.

A text is its bytes, A-Z lower-cased, and an end. The next byte is eight binary decisions, each in the contexts of
the last 0 to DEPTH bytes. Every context and decision prefix is a node with counts of zeros and ones from all
training texts, and a Krichevsky-Trofimov estimate of them; a node's weighted probability is half its own estimate
and half the product of its children's (the contexts one byte longer). The probability of a bit is the mixture of the
estimates along the path that those weights imply, down to the deepest context that training has seen.

Scale: the model isn't broadcast. Documents form blocks of so many rows, long texts each one of their own; a block knows
its distinct byte strings of DEPTH + 1 and its distinct words, and asks only for those. Keys are dealt to buckets: byte strings by the two bytes
before the next, so that a bucket holds whole subtrees; words by their hash. Bucket by bucket, counts of all blocks are
merged (in salted parts first, if there are many blocks), trees weighted, and answers sent back to the blocks, in the
order of their keys, which a block makes again; there they are summed per document. Only the nodes of depth 0 and 1 (65,536 at most) pass through the driver.

Defined results: a null or empty text is its end alone; a null doc_id counts as an empty string where rows are dealt to
training; repeated rows count each; without training rows every bit has probability one half; extra columns are
ignored; an empty table gives an empty table. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, checkpoint, read
from folioframe.llm.jaccard_join import Shingler, _mix

DEPTH = 6
#: 2 to this power is the number of rows of a block.
BLOCK_BITS = 12
#: Characters of a text from which on it is a block of its own.
LONG_TEXT = 100_000
#: Blocks whose answers one task gives at most.
SALT_BLOCKS = 512
#: Key of the end in the table of words.
END = np.uint64(0x5EED_0E2D_0000_0001)

_U = np.uint64
_STRINGS, _WORDS = 0, 1


def byte_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key of each byte and end with its context: last byte, the one before, ..., then the byte; and the document of each.

    Contexts before the start of a text are filled with 0xFF, which also is the end; UTF-8 never holds it.
    """
    pad = b"\xff" * DEPTH
    data = np.frombuffer((pad + pad.join([*texts, b""])).lower(), np.uint8).astype(np.uint64)
    keys = data[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        keys |= data[DEPTH - back : len(data) - back] << _U(8 * (DEPTH - back + 1))
    lengths = np.array([len(t) for t in texts]) + DEPTH
    ends = np.cumsum(lengths)
    use = np.ones(len(keys), bool)
    for i in range(1, DEPTH):
        use[ends - i] = False
    return keys[use], np.repeat(np.arange(len(texts)), lengths - DEPTH + 1)


def word_keys(texts: list[bytes], hasher: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word, and of each text's end, and the document of each."""
    hashes, doc = hasher.word_hashes(texts)
    return np.concatenate([hashes, np.full(len(texts), END)]), np.concatenate([doc, np.arange(len(texts))])


def _slices(texts: list[bytes], size: int = 500_000) -> Iterator[list[bytes]]:
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > size or i == len(texts) - 1:
            yield texts[first : i + 1]
            first, held = i + 1, 0


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(k)
    k, n = k[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _distinct(keys: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs, or 0 if nothing is learnt from them."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)) if learn else np.zeros(len(first), np.int64)


class Lookup:
    """Values by key: a table of hashed places finds most keys at once, a search in the sorted keys the rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by]
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.place = np.zeros(1 << self.bits, np.int32)
        self.place[self._hash(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> _U(29))) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place[self._hash(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return self.values[at]


def _pack(values: np.ndarray, steps: bool = False) -> bytes:
    """Bytes of an array, plane by plane, compressed; steps: of a sorted array, by its differences."""
    values = np.diff(values, prepend=values.dtype.type(0)) if steps else values
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values.view(np.uint8)
    return len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def _unpack(data: bytes, kind, steps: bool = False) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if steps else values


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys >> _U(8 * (DEPTH - 1)) if kind == _STRINGS else keys, 5) % _U(buckets)).astype(np.int64)


class BlockKeys:
    """The distinct keys of a block, strings and words, with their training counts, from its texts in slices."""

    def __init__(self, hasher: Shingler):
        self.hasher, self.parts = hasher, ([], [])

    def add(self, texts: list[bytes], learn: bool) -> None:
        for some in _slices(texts):
            for kind, keys in enumerate((byte_strings(some)[0], word_keys(some, self.hasher)[0])):
                self.parts[kind].append(_distinct(keys, learn))
                if len(self.parts[kind]) > 16:
                    self.parts[kind][:] = [_merge(*zip(*self.parts[kind], strict=True))]

    def by_bucket(self, kind: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, keys, counts), keys in order."""
        keys, n = _merge(*zip(*self.parts[kind], strict=True)) if self.parts[kind] else _merge([], [])
        at = _bucket(kind, keys, buckets)
        for b in np.unique(at):
            yield int(b), keys[at == b], n[at == b]


def count_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, block, keys, counts) of docs (block, text, train, alone): a block's distinct keys with their training counts.

    Rows of a block lie side by side, those aside that are alone in theirs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Shingler()

        def finish(block: int, held: BlockKeys) -> pa.RecordBatch:
            rows = [
                {"kind": kind, "bucket": b, "block": block, "keys": _pack(keys, steps=True), "counts": _pack(n)}
                for kind in (_STRINGS, _WORDS) for b, keys, n in held.by_bucket(kind, buckets)
            ]
            return pa.RecordBatch.from_pylist(rows, schema)

        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        block, held = None, BlockKeys(hasher)
        for batch in batches:
            blocks, train, alone = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for i in np.flatnonzero(alone):
                own = BlockKeys(hasher)
                own.add([texts[i]], train[i])
                yield finish(int(blocks[i]), own)
            for this in dict.fromkeys(blocks[~alone].tolist()):
                if this != block:
                    if block is not None:
                        yield finish(block, held)
                    block, held = this, BlockKeys(hasher)
                here = np.flatnonzero((blocks == this) & ~alone)
                for learn in (True, False):
                    held.add([texts[i] for i in here if train[i] == learn], learn)
        if block is not None:
            yield finish(block, held)

    return docs.select("block", "text", "train", "alone").mapInArrow(count, "kind int, bucket long, block long, keys binary, counts binary")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    y = x + 8
    shift = np.log(x)
    for i in range(1, 8):
        shift = shift + np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of a string with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Nodes:
    """The nodes of one depth: sorted keys (context, decision prefix), counts, and the weight of stopping here."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        own = log_kt(zeros, ones)
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones(len(keys)) if below is None else np.exp(own - np.log(2) - self.weighted)

    @classmethod
    def count(cls, strings: np.ndarray, n: np.ndarray, deeper: Nodes | None) -> Nodes:
        """strings: contexts of this depth and the next byte, distinct, with counts."""
        context, byte = strings >> _U(8), strings & _U(255)
        keys, bits = [], []
        for k in range(8):
            keys.append(context << _U(8) | _U(1 << k) | byte >> _U(8 - k))
            bits.append(byte >> _U(7 - k) & _U(1))
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        ones = np.bincount(at, weights=np.concatenate(bits) * np.tile(n, 8), minlength=len(every))
        zeros = np.bincount(at, weights=np.tile(n, 8), minlength=len(every)) - ones
        return cls(every, zeros, ones, None if deeper is None else np.bincount(np.searchsorted(every, deeper.parents()), weights=deeper.weighted, minlength=len(every)))

    def parents(self) -> np.ndarray:
        """Keys of the nodes one byte shorter: the oldest byte of the context goes."""
        return self.keys >> _U(16) << _U(8) | self.keys & _U(255)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.keys, self.zeros, self.ones, self.stop


def subtrees(keys: np.ndarray, n: np.ndarray) -> list[Nodes]:
    """Nodes of depth DEPTH down to 2, from distinct byte strings and their counts."""
    found: list[Nodes] = []
    for depth in range(DEPTH, 1, -1):
        if depth < DEPTH:
            keys, n = _merge([keys >> _U(16) << _U(8) | keys & _U(255)], [n])
        found.append(Nodes.count(keys, n, found[-1] if found else None))
    return found


def log10_probability(keys: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log10 probability of each key's last byte in its context; tables by depth, deepest first, down to 0.

    The chance of the bit that comes is mixed, never one minus another's, so that none rounds to 0.
    """
    context, byte = keys >> _U(8), keys & _U(255)
    total = np.zeros(len(keys))
    for k in range(8):
        prefix, bit = _U(1 << k) | byte >> _U(8 - k), byte >> _U(7 - k) & _U(1)
        chance = np.full(len(keys), np.nan)
        for back, (node, zeros, ones, stop) in enumerate(tables):
            if not len(node):
                continue
            want = context >> _U(8 * back) << _U(8) | prefix
            at = np.minimum(np.searchsorted(node, want), len(node) - 1)
            own = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            mixed = np.where(np.isnan(chance), own, stop[at] * own + (1 - stop[at]) * chance)
            chance = np.where(node[at] == want, mixed, chance)
        total += np.log10(np.where(np.isnan(chance), 0.5, chance))
    return total


def _arrays(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [_unpack(k, np.uint64, steps=True) for k in table["keys"].to_pylist()], [_unpack(n, np.int64) for n in table["counts"].to_pylist()]


def build_model(counted: DataFrame, salts: int) -> DataFrame:
    """(kind, bucket, blob, total, kinds, node, zeros, ones, below): a bucket's part of the model, and what its depth-1 nodes get from it."""

    def merge(table: pa.Table) -> pa.Table:
        keys, n = _merge(*_arrays(table))
        return pa.table({"kind": table["kind"][:1], "bucket": table["bucket"][:1], "keys": pa.array([_pack(keys[n > 0], steps=True)]), "counts": pa.array([_pack(n[n > 0])])})

    def build(table: pa.Table) -> pa.Table:
        keys, n = _merge(*_arrays(table))
        keys, n = keys[n > 0], n[n > 0]
        up = (np.empty(0, np.int64), *[np.empty(0)] * 3)
        # The counts are the model; where answers are given, the nodes are made from them again.
        blob = pickle.dumps((_pack(keys, steps=True), _pack(n)))
        if table["kind"][0].as_py() == _STRINGS:
            last = subtrees(keys, n)[-1]
            parent, at = np.unique(last.parents(), return_inverse=True)
            up = (parent.astype(np.int64), *(np.bincount(at, weights=v, minlength=len(parent)) for v in (last.zeros, last.ones, last.weighted)))
        return pa.table({
            "kind": table["kind"][:1], "bucket": table["bucket"][:1], "blob": pa.array([blob], pa.binary()), "total": pa.array([int(n.sum())]), "kinds": pa.array([len(n)]),
            "up": pa.array([[{"node": int(a), "zeros": b, "ones": c, "below": d} for a, b, c, d in zip(*up, strict=True)]], pa.list_(pa.struct([("node", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("below", pa.float64())]))),
        })

    rows = counted.select("kind", "bucket", "block", "keys", "counts")
    if salts > 1:
        rows = rows.groupBy("kind", "bucket", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")).applyInArrow(merge, "kind int, bucket long, keys binary, counts binary")
    return rows.groupBy("kind", "bucket").applyInArrow(build, "kind int, bucket long, blob binary, total long, kinds long, up array<struct<node: long, zeros: double, ones: double, below: double>>")


def top_tables(model: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of depth 1 and 0, from the sums that the buckets pass up: one row per first context byte and prefix."""
    up = model.select(F.explode("up").alias("u")).groupBy("u.node").agg(*[F.sum(f"u.{c}").alias(c) for c in ("zeros", "ones", "below")]).orderBy("node").toArrow()
    one = Nodes(*(up[c].to_numpy() for c in ("node", "zeros", "ones", "below"))) if up.num_rows else Nodes(np.empty(0, np.int64), *[np.empty(0)] * 3)
    one.keys = one.keys.astype(np.uint64)
    every, at = np.unique(one.keys & _U(255), return_inverse=True)
    return [one.table(), Nodes(every, *(np.bincount(at, weights=v, minlength=len(every)) for v in (one.zeros, one.ones, one.weighted))).table()]


def answer_blocks(counted: DataFrame, model: DataFrame, top, salts: int, tasks: int) -> DataFrame:
    """(block, kind, bucket, values): log10 probabilities of a block's byte strings, training counts of its words, in the order of its keys."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("values", pa.binary())])

    def answer(asked: pa.Table, part: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return schema.empty_table()
        # A block that several tasks read has sent several lists of keys: one answer, to all of them in order.
        lists: dict[int, list[np.ndarray]] = {}
        for block, k in zip(asked["block"].to_pylist(), asked["keys"].to_pylist(), strict=True):
            lists.setdefault(block, []).append(_unpack(k, np.uint64, steps=True))
        keys = [k[0] if len(k) == 1 else np.unique(np.concatenate(k)) for k in lists.values()]
        want = np.unique(np.concatenate(keys))
        blob = pickle.loads(part["blob"][0].as_py())
        known, n = _unpack(blob[0], np.uint64, steps=True), _unpack(blob[1], np.int64)
        if asked["kind"][0].as_py() == _WORDS:
            at = np.minimum(np.searchsorted(known, want), max(len(known) - 1, 0))
            values = np.where(known[at] == want, n[at], 0).astype(np.float64) if len(known) else np.zeros(len(want))
        else:
            values = log10_probability(want, [x.table() for x in subtrees(known, n)] + top.value)
        if asked["kind"][0].as_py() == _STRINGS:
            values = values.astype(np.float32)
        out = [_pack(values[np.searchsorted(want, k)]) for k in keys]
        same = lambda name: [asked[name][0].as_py()] * len(out)
        return pa.table([pa.array(list(lists), pa.int64()), pa.array(same("kind"), pa.int32()), pa.array(same("bucket"), pa.int64()), pa.array(out, pa.binary())], schema=schema)

    salt = F.pmod(F.xxhash64("block"), F.lit(salts).cast("long"))
    by = ("kind", "bucket", "salt")
    asked = counted.select("kind", "bucket", salt.alias("salt"), "block", "keys").repartition(tasks, *by)
    parts = model.select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "blob").repartition(tasks, *by)
    return asked.groupBy("kind", "bucket", "salt").cogroup(parts.groupBy("kind", "bucket", "salt")).applyInArrow(answer, "block long, kind int, bucket long, values binary")


def score_blocks(docs: DataFrame, answers: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """doc_id, train, n_bytes, n_tokens, n_known, base_sum, score, of docs (block, doc_id, text, train)."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score", pa.float64()),
    ])

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        hasher, out, tables = Shingler(), [], []
        texts = [t or b"" for t in rows["text"].cast(pa.binary()).to_pylist()]
        own = BlockKeys(hasher)
        own.add(texts, False)
        given = dict(zip(zip(found["kind"].to_pylist(), found["bucket"].to_pylist(), strict=True), found["values"].to_pylist(), strict=True))
        for kind in (_STRINGS, _WORDS):
            keys, values = [], []
            for b, k, _ in own.by_bucket(kind, buckets):
                keys.append(k)
                values.append(_unpack(given.pop((kind, b)), np.float32 if kind == _STRINGS else np.float64))
            tables.append(Lookup(np.concatenate(keys), np.concatenate(values).astype(np.float64)))
        for some in _slices(texts):
            (keys, doc), (words, of) = byte_strings(some), word_keys(some, hasher)
            bits = np.bincount(doc, weights=tables[_STRINGS](keys), minlength=len(some))
            c = tables[_WORDS](words)
            out.append((np.bincount(of, minlength=len(some)), np.bincount(of, weights=c > 0, minlength=len(some)), np.bincount(of, weights=np.log10(c + 0.5), minlength=len(some)), bits))
        n, known, base, bits = (np.concatenate(x) for x in zip(*out, strict=True))
        size = pa.array([len(t) for t in texts], pa.int64())
        return pa.table([rows["doc_id"], rows["train"], size, pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(bits)], schema=schema)

    both = docs.repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block"))
    return both.applyInArrow(score, "doc_id long, train boolean, n_bytes long, n_tokens long, n_known long, base_sum double, score double")


def score_texts(docs: DataFrame, block: Column | None = None, place: Column | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of docs (doc_id, text, train); learns from rows with train.

    bits_per_byte is the code length of the text and its end, for each of its bytes and the end. block numbers the
    blocks and place the rows in them, alike whenever docs is read, rows of a block side by side; without the two the
    rows are checkpointed and numbered in the order that they then have.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.coalesce(docs["train"], F.lit(False)).alias("train")]
    if block is None or place is None:
        rows = checkpoint(docs.select(*columns)).withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.shiftright("place", block_bits))
    else:
        rows = docs.select(*columns, block.cast("long").alias("block"), place.cast("long").alias("place"))
    long = F.coalesce(F.length("text") >= LONG_TEXT, F.lit(False))
    rows = rows.select("doc_id", "text", "train", long.alias("alone"), F.when(long, F.xxhash64("block", "place")).otherwise(F.col("block")).alias("block"))
    blocks = max(1, -(-docs.count() >> block_bits))
    buckets, salts = min(4096, max(32, blocks)), max(1, -(-blocks // SALT_BLOCKS))
    counted = checkpoint(count_blocks(rows, buckets))
    model = checkpoint(build_model(counted, salts))
    totals = model.where(F.col("kind") == _WORDS).agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    top = spark.sparkContext.broadcast(top_tables(model))
    # A task takes a few blocks, or a few parts of the model, however many there are.
    answers = answer_blocks(counted, model, top, salts, max(32, buckets * salts // 4))
    scored = score_blocks(rows, answers, buckets, max(32, blocks // 4))
    base = F.col("base_sum") - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), F.lit(5)) == 1
    # A block is so many rows of a file, by their place in it.
    block = F.xxhash64(F.col("_metadata.file_path"), F.shiftright(F.col("_metadata.row_index"), BLOCK_BITS))
    scored = score_texts(docs.withColumn("train", ~out), block, F.col("_metadata.row_index"))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
