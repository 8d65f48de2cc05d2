"""Spelling variants, ranked search and sentencepiece encoding against brute force and the library itself, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioframe.llm import jaccard_join, piece_chunks, ranked_search, spelling_variants
from folioframe.llm.common import stored

LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"wörter{'abcdef'[i % 6]}{'ghijk'[i % 5]}x" for i in range(40_000)) + "\n" + "tail " * 70_000 + "x" * 3_000_000
ROWS = [
    (1, "Harbour harbour harbor lights"), (2, None), (3, ""), (None, "harbour harbor"), (5, "   \n\t "), (6, LONG), (6, LONG), (7, "▁ harbour ▁▁ ünïcode 漢字 🎉\x00 <s>"),
    (7, "harbour the harbour"),
]
CLASH = ["word", "n", "term", "item", "block", "bucket", "kind", "payload", "list", "form", "root", "score", "rank", "terms", "counts"]


@pytest.fixture(scope="module", params=["rows", "empty", "clashing"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    if request.param == "empty":
        return df.limit(0)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if request.param == "clashing" else df


# --- spelling variants


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute_words(rows) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 6 and n >= 5})


def brute_variants(counts: dict) -> set[tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in best.items() if counts[f] >= 5 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def invented(seed: int, size: int) -> dict[str, int]:
    """Words of a few syllables, with edits of one another; some of one letter over and over."""
    draw = random.Random(seed)
    words = {"".join(draw.choices(["an", "tion", "e", "ri", "ñ", "sch", "a", "ing"], k=draw.randint(3, 6))) for _ in range(size)}
    words |= {"a" * k for k in range(6, 14)} | {"abab" * k for k in range(2, 5)}
    for w in sorted(words)[: size // 2]:
        k = draw.randrange(len(w))
        words |= {w[:k] + "q" + w[k:], w[:k] + "e" + w[k + 1 :], w[:k] + w[k + 1 :]}
    return {w: draw.choice([5, 6, 30, 200, 1500]) for w in sorted(words) if len(w) >= 6}


@pytest.mark.parametrize("seed,hot,frequent,longest", [(1, 1000, 50, 4), (2, 3, 5, 6), (3, 0, 2, 4)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, seed, hot, frequent, longest):
    """With lists merged whole and by halves, few and many long grams, and words of which an edit can affect every gram."""
    monkeypatch.setattr(spelling_variants, "HOT", hot)
    monkeypatch.setattr(spelling_variants, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(spelling_variants, "LONG_GRAM", longest)
    counts = invented(seed, 300)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert len(spelling_variants.gram_dictionary(words)) > 0
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.group_variants(words).collect()}
    assert got == brute_variants(counts)


@pytest.mark.parametrize("seed", range(4))
def test_near_words_share_all_but_the_affected_grams(seed):
    """The bound of either word holds for every edit, whatever grams the dictionary has."""
    draw = random.Random(seed)
    grams = {"".join(draw.choices("abñ", k=draw.randint(3, 6))) for _ in range(60)} | {"^ab", "^aba", "ab$", "bab$"}
    index = spelling_variants.GramIndex(grams)
    for _ in range(1500):
        w = "".join(draw.choices("abñ", k=draw.randint(6, 12)))
        k, x = draw.randrange(len(w)), draw.choice("abñz")
        for v in (w[:k] + w[k + 1 :], w[:k] + x + w[k:], w[:k] + x + w[k + 1 :], w + x):
            s, t = f"^{w}$", f"^{v}$"
            a, b = index.decompose(s), index.decompose(t)
            fronts, backs = {(p, g) for p, g in b}, {(len(t) - p, g) for p, g in b}
            kept = sum((p, g) in fronts or (len(s) - p, g) in backs for p, g in a)
            assert kept >= len(a) - index.affected(s, a)


def test_words_of_whole_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + k, "harbour " * 7 + "ünder-Überall ünderzüge" * 3) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = brute_words(rows)
    assert {r.word: r.n for r in spelling_variants.count_words(frame).collect()} == counts
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.group_variants(spelling_variants.count_words(frame)).collect()}
    # Runs that lost a code point are near their whole form.
    assert got == brute_variants(counts) and any(f == "harbour" for _, f, *_ in got)


def test_words_held_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling_variants, "PIECE", 100)
    monkeypatch.setattr(spelling_variants, "HELD_WORDS", 3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    counts = brute_words(rows)
    assert {r.word: r.n for r in spelling_variants.count_words(docs).collect()} == counts
    assert spelling_variants.group_variants(spelling_variants.count_words(docs)).count() == len(counts)


# --- ranked search


def brute_search(items, docs, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def vocabulary(seed: int, n: int, size: int) -> list[tuple[int, str]]:
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "the", "THE", "The"] * 4
    return [(k, " ".join(draw.choices(words, k=draw.randint(0, size)))) for k in range(n)]


@pytest.mark.parametrize("block,wave,batch,small", [(256, 20_000, 256, 500_000), (7, 50, 13, 500_000), (256, 20_000, 256, 0)])
def test_search_ranks_as_every_pair_does(spark, monkeypatch, block, wave, batch, small):
    """In one block of items and one wave or in many; with terms broadcast or joined."""
    for name, value in (("BLOCK_ITEMS", block), ("WAVE_NODES", wave), ("BATCH_DOCS", batch), ("BROADCAST_TERMS", small), ("PIECE", 40)):
        monkeypatch.setattr(ranked_search, name, value)
    docs = vocabulary(1, 150, 60) + [(77, "w1 w2 w2"), (77, "w1 w2 w2"), (None, "w1 w2 w2"), (500, None), (501, "—"), (502, "w9 " * 300)]
    items = vocabulary(2, 40, 30) + [(900, None), (901, "unheard of"), (7, "w1 w1 w1 w2"), (902, "w1 w1 w1 w2")]
    got = ranked_search.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 5)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(items, docs, 5)


def test_shared_sets_are_made_once():
    """Nodes give back every item's leaves, each once, and save additions."""
    draw = random.Random(5)
    base = [tuple(draw.sample(range(50), 8)) for _ in range(6)]
    items = [sorted({*draw.choice(base), *draw.choice(base), *draw.sample(range(50), 3)}) for _ in range(40)]
    nodes, parts, leaves = ranked_search.mine(items)

    def spread(x):
        return [leaves[x]] if x < len(leaves) else [y for side in nodes[x - len(leaves)] for y in spread(side)]

    assert [sorted(y for x in p for y in spread(x)) for p in parts] == items
    assert len(nodes) + sum(len(p) - 1 for p in parts) < 0.6 * sum(len(i) - 1 for i in items)


def test_search_edges(docs):
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    got = Counter(tuple(r) for r in ranked_search.search(items, docs).collect())
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got == brute_search(rows, rows, 20)
    assert ranked_search.search(items.limit(0), docs).count() == 0 and ranked_search.search(items, docs.limit(0)).count() == 0


# --- sentencepiece


def library(text):
    import public_tokenizers as P
    import sentencepiece

    sp = library.held = getattr(library, "held", None) or sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = sp.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), ids, sp.decode(ids)


@pytest.mark.parametrize("size,packed", [(32 << 20, 1024), (200, 3)])
def test_pieces_are_the_librarys(spark, docs, monkeypatch, size, packed):
    """In one block a task, and in a block every few texts."""
    import public_tokenizers as P

    monkeypatch.setattr(piece_chunks, "BLOCK_BYTES", size)
    monkeypatch.setattr(piece_chunks, "PACKED_TEXTS", packed)
    draw = random.Random(1)
    texts = ["".join(draw.choices("ab  the tion▁\n\t 12éñ日🎉\x00 <s> 　", k=draw.randrange(0, 60))) for _ in range(300)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(more)
    got = piece_chunks.encode_documents(frame, P.path("piece_bpe_32k.model"), with_ids=True).collect()
    by_text = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, hash((tuple(r.ids), r.decoded))) for r in got)
    assert by_text == Counter((r.doc_id, *library(r.text)[:3], hash((tuple(library(r.text)[3]), library(r.text)[4]))) for r in frame.collect())


def test_chunks_of_random_texts():
    import sentencepiece  # noqa: F401

    library("")
    sp, draw = library.held, random.Random(2)
    meaning = piece_chunks.piece_bytes(sp)
    for _ in range(5000):
        text = "".join(draw.choices("ab  the tion▁\n\t 12éñ日🎉\x00 <s>", k=draw.randrange(0, 40)))
        ids = [i for c in piece_chunks.chunks_of(text) for i in sp.encode(c) or piece_chunks.encode_mark(sp.encode)]
        assert ids == sp.encode(text) and b"".join(meaning[i] for i in ids)[1:].decode() == sp.decode(ids)


# --- near duplicates of repeated ids


def test_a_repeated_id_loses_only_what_is_alike(spark):
    a, z = " ".join(f"a{k}" for k in range(30)), " ".join(f"z{k}" for k in range(30))
    docs = spark.createDataFrame([(3, a, 1), (5, a + " more", 2), (5, z, 3), (6, a, 4), (None, a, 5), (7, "", 6), (7, z + " and", 7), (8, None, 8)], "doc_id long, text string, tag int")
    kept = jaccard_join.near_duplicate_stage(spark, stored(docs), "")
    assert kept.columns == docs.columns and {r.tag for r in kept.collect()} == {1, 3, 5, 6, 8}


# --- bounds of earlier operators


def test_long_texts_in_bounded_memory(spark):
    """Trigrams of a long text are counted; learning takes texts within its budget; encoding forgets long pre-tokens."""
    import numpy as np
    import public_tokenizers as P

    from folioframe.llm import byte_bpe, language_id, quality_classifier

    table = np.log(np.random.default_rng(1).random((3, language_id.BUCKETS)) + 0.1)
    at = np.random.default_rng(2).integers(0, language_id.BUCKETS, language_id.BUCKETS * 2)
    assert np.allclose(language_id.mean_logs(table, at), table[:, at].mean(axis=1)) and np.allclose(language_id.mean_logs(table, at[:9]), table[:, at[:9]].mean(axis=1))
    assert (language_id.mean_logs(table, at[:0]) == 0).all()

    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices("good fine text here".split() if i % 2 else "$$ BUY ### now".split(), k=40)), i % 2) for i in range(80)] + [(500, "good " * 400_000, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality_classifier.learn_quality(docs, labels, budget=100_000)
    scores = {r.doc_id: r.score for r in quality_classifier.score_documents(docs, model).collect()}
    assert min(scores[i] for i in range(1, 80, 2)) > max(scores[i] for i in range(0, 80, 2))
    assert isinstance(quality_classifier.learn_quality(docs, labels, budget=0), float)

    tokens = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    codec = byte_bpe.PieceCodec(byte_bpe.serialise_model(tokens), tokens, P.PATTERN)
    for k in range(3):
        codec.encode("a" * (byte_bpe.REMEMBERED_SIZE // 2 + 10 + k))
    assert codec.size <= byte_bpe.REMEMBERED_SIZE and len(codec.known) <= 2
