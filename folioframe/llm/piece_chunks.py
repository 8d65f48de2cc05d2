"""SentencePiece BPE through a table of distinct chunks: each marked word is segmented once, and its ids join back by position.

The model's pieces never hold a whitespace marker behind another character, so no merge crosses from a word into the
marker of the next one: a text falls into chunks, markers and the word behind them, that are segmented apart exactly as
within the text. `check_model` refuses a model of which that isn't true.

1. A map-only pass cuts texts into chunks. A block of texts (so many bytes, whole texts) numbers its chunks by their
   count, and the numbered chunks are dealt to buckets by a hash. A second pass writes the texts as numbers.
2. A bucket has all blocks' requests for its chunks: each distinct chunk is segmented once, and its ids go back to every
   block that asked. A chunk of every text is one request a block, read as a stream, so no key is hot.
3. A block's answers come before its texts in one sorted stream; ids are put together by position, and decoded.

Rows on the way are packed as compressed Arrow messages, so that both shuffles together stay near the size of the input.
Memory of a task: the distinct chunks of one block, or those of one bucket up to a bound, after which it forgets them.

Defined results: a null or empty text has no tokens and decodes to the empty text; the marker character itself is read as
a space, as the library does; repeated rows and null doc_ids are encoded like any other; extra columns are ignored; an
empty table gives an empty table; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bounded_batches, read, stored

MARK = "▁"
#: Bytes of text, and texts, that make a block full. The last text may exceed the bytes.
BLOCK_BYTES = 16 << 20
BLOCK_TEXTS = 65_536
#: Texts whose numbers make one packed row.
PACKED_TEXTS = 1024
#: Buckets of chunks at most, as a block sends each a packed row; and chunks that a bucket's task remembers.
MOST_BUCKETS = 1024
REMEMBERED = 2_000_000
_REQUEST, _TEXTS = 0, 1
_PACKED = "bucket int, kind int, block long, size int, payload binary"
_NAMES = ["bucket", "kind", "block", "size", "payload"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def check_model(processor) -> None:
    """Raise ValueError if texts can't be cut at whitespace markers, or spaces don't become markers one by one."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError("a piece crosses from a word into the next marker")
    if processor.normalize("  ﬁ A\t") != f"{MARK * 3}ﬁ{MARK}A\t":
        raise ValueError("the model's normalisation isn't the identity with a leading marker")
    if MARK not in pieces or not all(f"<0x{b:02X}>" in pieces for b in range(256)):
        raise ValueError("the model lacks the marker, or falls back to the unknown piece and not to bytes")


def piece_bytes(processor) -> list[bytes]:
    """What each id stands for when decoded."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        elif processor.is_control(i):
            out.append(b"")
        else:
            out.append((" ⁇ " if processor.is_unknown(i) else piece.replace(MARK, " ")).encode())
    return out


_chunks = re.compile(" +[^ ]*").findall


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first marker and with spaces for others; the library puts a marker before the first."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if text[0] == " " or "  " in text:
        return [c[1:] for c in _chunks(" " + text)]
    return text.split(" ")


def _small(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in as few bytes as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _pack(**columns) -> bytes:
    """Arrays or lists of any lengths as one compressed Arrow message."""
    lists = []
    for values in columns.values():
        values = values if isinstance(values, pa.Array) else pa.array(values)
        lists.append(pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values))
    batch = pa.RecordBatch.from_arrays(lists, list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> list[pa.Array]:
    return [c[0].values for c in pa.ipc.open_stream(payload).read_next_batch().columns]


def _arrow_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of 4 MB or so."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _NAMES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _NAMES)


class Block:
    """Texts whose chunks are numbered together, by falling count, ties by the chunk itself."""

    def __init__(self):
        self.ids, self.texts, self.bytes = [], [], 0
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__

    def add(self, doc_id: int | None, text: str) -> None:
        chunks = chunks_of(text)
        self.ids.append(doc_id)
        self.texts.append(np.fromiter(map(self.known.__getitem__, chunks), np.uint32, len(chunks)))
        self.bytes += len(text)

    def numbered(self) -> tuple[list[str], np.ndarray]:
        """The chunks by number, and the number of each by its order of appearance."""
        chunks = sorted(self.known)
        came = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        counts = np.bincount(np.concatenate(self.texts), minlength=len(chunks))
        by = np.argsort(-counts[came], kind="stable")
        number = np.empty(len(chunks), np.uint32)
        number[came[by]] = np.arange(len(chunks), dtype=np.uint32)
        return [chunks[i] for i in by], number

    def requests(self, buckets: int) -> Iterator[tuple]:
        """A row for each bucket that has chunks of the block: the chunks, and the steps between their numbers."""
        chunks, _ = self.numbered()
        key = self.key(chunks)
        bucket = np.fromiter((zlib.crc32(c.encode()) % buckets for c in chunks), np.int64, len(chunks))
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for part in np.split(order, cuts[1:]) if len(order) else []:
            payload = _pack(chunk=pa.array([chunks[i] for i in part], pa.large_string()), step=_small(np.diff(part, prepend=0)))
            yield int(bucket[part[0]]), _REQUEST, key, len(chunks), payload

    def rows(self) -> Iterator[tuple]:
        """The texts as numbers of chunks."""
        chunks, number = self.numbered()
        key = self.key(chunks)
        for k in range(0, len(self.ids), PACKED_TEXTS):
            some = self.texts[k : k + PACKED_TEXTS]
            flat = number[np.concatenate(some)]
            # The two halves of the numbers, each alike within itself, are packed better than whole numbers.
            payload = _pack(
                doc_id=pa.array(self.ids[k : k + PACKED_TEXTS], pa.int64()), length=_small(np.array([len(x) for x in some])), low=_small(flat & 0xFFFF), high=_small(flat >> 16)
            )
            yield 0, _TEXTS, key, len(chunks), payload

    @staticmethod
    def key(chunks: list[str]) -> int:
        """A digest of the chunks in order: blocks of one key have the same numbers, and one cut differently would find no answers, not wrong ones."""
        return int.from_bytes(hashlib.blake2b(f"{len(chunks)} {' '.join(chunks)}".encode(), digest_size=8).digest(), "little", signed=True)


def cut_into_chunks(docs: DataFrame, rows_of) -> DataFrame:
    """The rows that rows_of(block) gives of each block of docs (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block = Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(doc_id, text or "")
                if block.bytes >= BLOCK_BYTES or len(block.ids) >= BLOCK_TEXTS:
                    yield from rows_of(block)
                    block = Block()
        if block.ids:
            yield from rows_of(block)

    return docs.mapInArrow(lambda batches: _arrow_rows(rows(batches)), _PACKED)


def segment_chunks(requests: DataFrame, model: bytes) -> DataFrame:
    """Requests answered with the ids of each chunk. requests is sorted by bucket within partitions."""
    shared = requests.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_proto=shared.value).encode
        bare = array("I", encode_mark(encode)).tobytes()
        held: dict[str, bytes] = {}
        at = None
        for batch in batches:
            for bucket, _, block, size, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at or len(held) > REMEMBERED:
                    at, held = bucket, {}
                asked, step = _unpack(payload)
                chunks = asked.to_pylist()
                new = list(dict.fromkeys(c for c in chunks if c not in held))
                for c, ids in zip(new, encode(new, num_threads=1)):
                    held[c] = array("I", ids).tobytes() or bare
                found = list(map(held.__getitem__, chunks))
                ids = np.frombuffer(b"".join(found), np.uint32)
                yield 0, _REQUEST, block, size, _pack(step=step, length=_small(np.fromiter(map(len, found), np.int64, len(found)) // 4), ids=_small(ids))

    return requests.mapInArrow(lambda batches: _arrow_rows(rows(batches)), _PACKED)


def encode_mark(encode) -> list[int]:
    """The ids of a marker with nothing behind it, which the library doesn't give for an empty text: those of two texts differ by it."""
    return encode("a ")[len(encode("a")) :]


class Spellings:
    """Byte strings by id, put one after another for many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """For each run of ids, so many as lengths says, their strings joined."""
        n = self.length[ids]
        done = np.cumsum(n)
        whole = self.data[np.repeat(self.start[ids] - done + n, n) + np.arange(int(n.sum()))].tobytes()
        ends = np.concatenate([[0], done])[np.cumsum(lengths)].tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


def join_by_position(rows: DataFrame, model: bytes, with_ids: bool) -> DataFrame:
    """Texts put together from their blocks' answers. rows is sorted by block and kind within partitions."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        meaning = piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=shared.value))
        decimal, meaning = Spellings([b",%d" % i for i in range(len(meaning))]), Spellings(meaning)
        at, ids_of, text_of, tokens = None, [], [], np.empty(0, np.int64)
        for batch in batches:
            for _, kind, block, size, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    at, ids_of, text_of, tokens = block, [None] * size, [None] * size, np.zeros(size, np.int64)
                got = [c.to_numpy(zero_copy_only=False) if c.type != pa.int64() else c for c in _unpack(payload)]
                if kind == _REQUEST:
                    step, lengths, ids = got
                    numbers = np.cumsum(step, dtype=np.int64)
                    lengths, ids = lengths.astype(np.int64), ids.astype(np.int64)
                    tokens[numbers] = lengths
                    for number, i, t in zip(numbers.tolist(), decimal(ids, lengths), meaning(ids, lengths)):
                        ids_of[number], text_of[number] = i, t
                    continue
                doc_ids, lengths, low, high = got
                flat = low.astype(np.int64) | high.astype(np.int64) << 16
                ends = np.cumsum(lengths, dtype=np.int64)
                counts = np.diff(np.concatenate([[0], np.cumsum(tokens[flat])])[ends], prepend=0)
                numbers, names, sums, every, texts = flat.tolist(), [], [], [], []
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    own = numbers[a:b]
                    # The first comma and the first marker's space aren't part of the text.
                    ids = b"".join(map(ids_of.__getitem__, own))[1:]
                    text = b"".join(map(text_of.__getitem__, own))[1:]
                    names.append(hashlib.sha256(ids).hexdigest())
                    sums.append(hashlib.sha256(text).hexdigest())
                    if with_ids:
                        every.append([int(i) for i in ids.split(b",")] if ids else [])
                        texts.append(text.decode(errors="replace"))
                out = [doc_ids, pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(sums, pa.string())]
                if with_ids:
                    out += [pa.array(every, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False, steady: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs (doc_id, text); with_ids adds ids and decoded.

    docs is read twice, once for its chunks and once for their places. steady: it has the same rows in the same
    partitions and order each time, as a scan of files has; else it is stored first.
    """
    import sentencepiece

    spark = docs.sparkSession
    bounded_batches(spark)
    with open(model_file, "rb") as f:
        model = f.read()
    check_model(sentencepiece.SentencePieceProcessor(model_proto=model))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(4 * parts, MOST_BUCKETS)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    docs = docs if steady else stored(docs)
    requests = cut_into_chunks(docs, lambda block: block.requests(buckets)).repartition(parts, "bucket").sortWithinPartitions("bucket")
    texts = cut_into_chunks(docs, Block.rows)
    rows = segment_chunks(requests, model).unionByName(texts).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return join_by_position(rows, model, with_ids)


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), model_file or public_tokenizers.path("piece_bpe_32k.model"), steady=True)
