"""Operators against brute force on small fixtures, exact round trips, and held-out figures."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import byte_bpe, common, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, quality_classifier, quality_rules, substring_dedup, url_filters
from folioframe.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: low[x] for x in linked}


def families(seed: int):
    """Families of copies with a few to many words changed, a common passage, and exact copies."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefg", k=5))
    passage = [word() for _ in range(60)]
    docs = []
    for family in range(12):
        base = [word() for _ in range(draw.choice([8, 40, 150]))]
        for _ in range(draw.choice([1, 5, 40])):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
                text[draw.randrange(len(text))] = word()
            docs.append(" ".join(text + passage * (family % 2)))
    docs += ["", "one two", "ONE two", "x y z"]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,frequent", [(1, 2), (2, 8)])
def test_jaccard_components_are_those_of_all_pairs(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(jaccard_join.frequent_tokens, "__defaults__", (frequent, 1000))
    docs = families(seed)
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * (k := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - k)]
    for _ in range(len(links)):
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    got = jaccard_join.near_duplicate_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), low[i]) for i, s in sets.items()}


def test_a_hot_bucket_of_unrelated_sets(spark, monkeypatch):
    """Hundreds of sets share one prefix token under the first order, none is like another but two."""
    monkeypatch.setattr(jaccard_join, "frequent_tokens", lambda docs, words: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    shingler, order = jaccard_join.Shingler(5), jaccard_join.TokenOrder(np.empty(0, np.uint64), np.empty(0, np.int64))
    key = lambda text: int(order.prefix(shingler([text.encode()])[0], 0, 80)[0])
    hot = min((f"hot{i} a b c d" for i in range(100_000)), key=key)
    texts = [f"{hot} " + " ".join(f"u{i}x{k}" for k in range(9)) for i in range(600)]
    texts += [texts[7] + " more", texts[11] + " and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicate_components(docs).where("doc_id <> component_id").collect()}
    assert got == {600: 7, 601: 11}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_fuse_filter_has_every_key(n):
    draw = np.random.default_rng(n)
    keys, others = draw.integers(0, 1 << 63, n).astype(np.uint64), draw.integers(0, 1 << 63, 20_000).astype(np.uint64)
    f = exact_dedup.BinaryFuseFilter.build(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.01


def test_screening_loses_no_duplicate(spark):
    old = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    new = spark.createDataFrame([(1000 + i, f"text {i}") for i in range(400, 900)] + [(5000, "text 401")], "doc_id long, text string")
    got = {r.keep_id: r.group_size for r in exact_dedup.dedup_batch(exact_dedup.index_snapshot(old), new).collect()}
    assert len(got) == 900 and got[5000] == 3 and got[1450] == 2 and got[10] == 1 and got[1899] == 1


def test_batches_larger_than_their_snapshots(spark, monkeypatch):
    """Two snapshots of a few texts each; the batch's digests are dealt to several parts of every shard."""
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 20)
    one = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    two = spark.createDataFrame([(i, f"text {i}") for i in range(30, 60)], "doc_id long, text string")
    new = spark.createDataFrame([(5000 + i, f"text {i}") for i in range(20, 3000)], "doc_id long, text string")
    got = {r.keep_id: r.group_size for r in exact_dedup.dedup_batch([exact_dedup.index_snapshot(one), exact_dedup.index_snapshot(two)], new).collect()}
    assert got == {**{i: 1 for i in range(20)}, **{5000 + i: 2 if i < 60 else 1 for i in range(20, 3000)}}


@pytest.mark.parametrize("sizes,weights", [([100, 10, 10], [1, 1, 1]), ([5, 50, 500], [9, 1, 1]), ([7, 7, 7], [1, 2, 3]), ([1, 1000, 3, 0], [1, 1, 2, 5])])
def test_water_filling(spark, sizes, weights):
    cap = [3 * s for s in sizes]
    target, total = [0.0] * len(sizes), float(sum(sizes))
    while True:
        free = [i for i in range(len(sizes)) if target[i] < cap[i]]
        left = total - sum(cap[i] for i in range(len(sizes)) if i not in free)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > cap[i]]
        for i in over or free:
            target[i] = cap[i] if over else share[i]
        if not over:
            break
    rows = [(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
    got = mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight long"))
    assert [r.target for r in got.orderBy("source").collect()] == pytest.approx(target)


def test_mix_meets_targets(spark):
    rows = QUERIES["op1_mix_sources"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")).collect():
        assert abs(r.taken - r.target) <= r.size
    assert rows.where("taken > 3 * size").count() == 0


def test_mixing_again_gives_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = lambda d: sorted((r.doc_id, r.mix_copies, round(r.mix_target, 6)) for r in d.collect())
    mix = lambda d: mixing.apply_mix(d, mixing.plan_mix(d, mixing.word_count(d["text"])))
    once = mix(docs)
    again = mix(once.repartition(3))
    assert rows(once) == rows(again) and once.columns == again.columns
    assert mixing.mixing_stage(spark, once, SF).columns == once.columns


def test_many_sources_and_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 1 / 64)
    rows = [(i, f"host{i % 70:03d}" if i % 3 else "hot", "w " * (i % 7 + 1)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.apply_mix(docs, mixing.plan_mix(docs, mixing.word_count(docs["text"]))).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += len(r.text.split())
        taken[r.source] += r.mix_copies * len(r.text.split())
        target[r.source] = r.mix_target
    assert sum(target.values()) == pytest.approx(sum(sizes.values())) and all(t <= 3 * sizes[s] + 1e-6 for s, t in target.items())
    assert all(abs(taken[s] - target[s]) <= 7 for s in target)


def test_encoding_is_tiktokens(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_byte_bpe"](spark, SF).collect():
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    tokens = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec = byte_bpe.PieceCodec(byte_bpe.serialise_model(tokens), tokens, P.PATTERN)
    multi = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    draw = random.Random(5)
    for _ in range(2000):
        text = "".join(draw.choices(" \n\t'sdmtrelv aeéß😀漢字.,!?#\x00\x1c\x85\xa0　１²Ⅷ", k=draw.randint(0, 50)))
        assert codec.encode(text) == multi.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()


def brute_ctw(train: list[bytes], text: bytes, depth: int) -> float:
    """Context-tree weighting by recursion over dictionaries, log10 of the text's probability."""
    counts: dict = {}
    below: dict = {}
    for t in train:
        s = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(s)):
            for k in range(8):
                node = (1 << k) | s[i] >> (8 - k)
                for d in range(depth + 1):
                    key = (s[i - d : i], node)
                    counts.setdefault(key, [0, 0])[s[i] >> (7 - k) & 1] += 1
                    if d:
                        below.setdefault((s[i - d + 1 : i], node), set()).add(key)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted: dict = {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[key])
        weighted[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(weighted[c] for c in below[key])) - math.log(2)
    total, s = 0.0, b"\xff" * depth + text + b"\xff"
    for i in range(depth, len(s)):
        for k in range(8):
            node, one = (1 << k) | s[i] >> (8 - k), None
            for d in range(depth, -1, -1):
                key = (s[i - d : i], node)
                if key in counts:
                    z, o = counts[key]
                    p = (o + 0.5) / (z + o + 1)
                    stop = math.exp(kt(z, o) - math.log(2) - weighted[key]) if d < depth else 1.0
                    one = p if one is None else stop * p + (1 - stop) * one
            one = 0.5 if one is None else one
            total += math.log10(one if s[i] >> (7 - k) & 1 else 1 - one)
    return total


def test_scores_are_those_of_the_tree(spark):
    texts = ["abracadabra", "the cat sat on the mat", "The cat", "", "été à la mer", "zzzz"] * 2 + ["banana bandana", "mat the on"]
    rows = [(i, t, i % 3 > 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(2), block_bits=1).collect()}
    train = [t.encode().lower() for _, t, learn in rows if learn]
    for i, t, _ in rows:
        assert got[i] == pytest.approx(brute_ctw(train, t.encode().lower(), lm_scoring.DEPTH), rel=1e-5)


def test_long_texts_are_blocks_of_their_own(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, "".join(draw.choices("abc ", k=draw.choice([5, 400]))), i % 4 > 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").coalesce(2)
    score = lambda: {r.doc_id: (r.score, r.n_bytes, r.bits_per_byte) for r in lm_scoring.score_texts(docs, block_bits=3).collect()}
    together = score()
    monkeypatch.setattr(lm_scoring, "LONG_TEXT", 100)
    apart = score()
    for i, t, _ in rows:
        assert apart[i] == pytest.approx(together[i]) and apart[i][1] == len(t)
        assert apart[i][2] == pytest.approx(-apart[i][0] / math.log10(2) / (len(t) + 1))


def test_scores_look_six_bytes_back(spark):
    # The last byte depends on the byte six places before it, so that a tree of depth 5 can't tell these texts apart.
    rows = [(i, ("a-----x", "b-----y")[i % 2], i < 8) for i in range(10)] + [(10, "a-----y", False)]
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()}
    train = [t.encode() for _, t, learn in rows if learn]
    for i, t, _ in rows:
        assert got[i] == pytest.approx(brute_ctw(train, t.encode(), 6), rel=1e-5)
    assert abs(brute_ctw(train, b"a-----y", 6) - brute_ctw(train, b"a-----y", 5)) > 0.1


def test_no_bit_has_probability_zero():
    # A billion ones and no zero in the deepest node, and a stop weight of one above.
    for n in (1e9, 1e12):
        deep, top = [lm_scoring.Nodes(np.array([k], np.uint64), np.zeros(1), np.full(1, n), None).table() for k in (ord("a") << 8 | 1, 1)]
        got = lm_scoring.log10_probability(np.array([ord("a") << 8, ord("a") << 8 | 255], np.uint64), [deep, top])
        assert got == pytest.approx([math.log10(0.5 / (n + 1)) + 7 * math.log10(0.5), 7 * math.log10(0.5)], rel=1e-9)
    # In the model as it is stored: 2e8 times 'a' then 'x', whose first bit is 0, and the unseen end, whose first bit is 1.
    keys = np.array([int.from_bytes(b"a" * lm_scoring.DEPTH + b"x", "big")], np.uint64)
    unseen = np.array([int.from_bytes(b"a" * lm_scoring.DEPTH + c, "big") for c in (b"\xff", b"y")], np.uint64)
    assert np.isfinite(lm_scoring.log10_probability(unseen, [x.table() for x in lm_scoring.subtrees(keys, np.array([200_000_000]))])).all()


def test_base_scores(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_lm_scoring"](spark, SF).collect()}
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(seen.values()), len(seen)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(seen[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality_classifier"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got) > 50


def test_attention_gradients():
    """Against finite differences of the loss, weight by weight; and shares of attention that sum to one."""
    draw = np.random.default_rng(0)
    x, bag = draw.normal(size=(9, quality_classifier.FEATURES)), np.array([0, 0, 1, 1, 1, 2, 3, 3, 3])
    y = np.array([1.0, 0.0, 1.0, 0.0])
    m = quality_classifier.AttentionModel()
    assert np.allclose(np.bincount(bag, weights=m._forward(x, bag, 4)[3]), 1)

    def loss() -> float:
        p = m._forward(x, bag, 4)[-1]
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    for name, g in m.gradients(x, bag, y).items():
        for i in draw.integers(0, m.w[name].size, 12):
            at, step = np.unravel_index(i, m.w[name].shape), 1e-6
            was = m.w[name][at]
            m.w[name][at] = was + step
            up = loss()
            m.w[name][at] = was - step
            down = loss()
            m.w[name][at] = was
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-8)
    monkey = quality_classifier.AttentionModel().learn(np.tile(x, (20, 1)), np.repeat(np.arange(80), np.tile([2, 3, 1, 3], 20)), np.tile(y, 20))
    assert ((monkey.score(x, bag, 4) > 0.5) == (y == 1)).all()


def test_a_quality_of_words_alone(spark):
    """Good and bad texts of the same letters, lengths and marks: only the words tell them apart."""
    draw, words = random.Random(4), ["stone", "notes", "onset", "tones", "seton"]
    rows = [(i, " ".join(draw.choices(words[:3] if i % 2 else words[2:], k=draw.randint(60, 200)))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = quality_classifier.learn_quality(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = quality_classifier.score_documents(docs, model).where("held_out").collect()
    assert sum((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got) >= 0.97 * len(got) > 200


def test_learning_twice_gives_the_same(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionByName(docs.withColumn("text", F.lit(""))).repartition(7)
    one, two = quality_classifier.learn_quality(docs, labels), quality_classifier.learn_quality(twice, labels)
    assert all(np.array_equal(one.w[k], two.w[k]) for k in one.w)


def brute_posterior(pages: list[tuple], languages: list[str], votes: dict[int, list[float]], strength: float) -> dict[int, list[float]]:
    """The fused posterior by loops over pages (page_id, host, declared)."""
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    own, n = {p: soft(votes[p]) for p, _, _ in pages}, len(languages)
    total = [sum(own[p][k] for p, _, _ in pages) for k in range(n)]
    prior = [(t + 1) / (sum(total) + n) for t in total]
    found = {}
    for p, host, said in pages:
        def of(match, parent, p=p):
            rest = [sum(own[q][k] for q, h, d in pages if match(h, d) and q != p) for k in range(n)]
            return rest, [(r + strength * a) / (sum(rest) + strength) for r, a in zip(rest, parent, strict=True)]
        _, suffix = of(lambda h, d, host=host: h.rsplit(".")[-1] == host.rsplit(".")[-1], prior)
        _, hosts = of(lambda h, d, host=host: h == host, suffix)
        score = [v + math.log(h) for v, h in zip(votes[p], hosts, strict=True)]
        if said in languages:
            others, _ = of(lambda h, d, said=said: d == said, prior)
            right = [0.8 if x == said else 0.2 / (n - 1) for x in languages]
            score = [s + math.log((o + strength * r) / (t + strength)) for s, o, r, t in zip(score, others, right, total, strict=True)]
        found[p] = soft(score)
    return found


def test_posterior_by_hand(spark):
    draw, languages = random.Random(8), ["de", "en", "fr"]
    pages = [(i, draw.choice(["a.de", "b.de", "c.com", "d.com", "d.com"]), draw.choice(["de", "en", "fr", "xx", None])) for i in range(40)]
    votes = {i: [draw.uniform(-4, 0) for _ in languages] for i, _, _ in pages}
    rows = [(i, f"http://{h}/x", d, votes[i]) for i, h, d in pages]
    got = language_id.fuse_evidence(spark.createDataFrame(rows, "page_id long, url string, declared string, votes array<double>"), languages)
    want = brute_posterior(pages, languages, votes, language_id.STRENGTH)
    for r in got.collect():
        assert r.probability == pytest.approx(max(want[r.page_id])) and r.lang == languages[int(np.argmax(want[r.page_id]))]


def test_languages_held_out(spark):
    """Learnt from four fifths of the documents, asked for the rest: by text alone, by nothing but the host, with a wrong declaration."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 60")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    page = docs.where(out).select(F.col("doc_id").alias("page_id"), "lang", "text")
    url = F.concat(F.lit("http://"), F.col("lang"), F.lit(".example/"), F.col("page_id"))
    plain, wrong = F.concat(F.lit("<p>"), F.col("text")), F.concat(F.lit("<html lang='"), F.when(F.col("lang") == "en", "fr").otherwise("en"), F.lit("'><p>"), F.col("text"))
    share = lambda html, at: (lambda got: sum(r.lang == lang[r.page_id] for r in got) / len(got))(
        language_id.identify_languages(page.select("page_id", at.alias("url"), html.alias("html")), docs.where(~out)).collect()
    )
    assert share(plain, F.lit("http://one.example/")) >= 0.97, "text alone"
    assert share(plain, url) >= 0.98, "text and host"
    assert share(wrong, url) >= 0.9, "text and host against a wrong declaration"
    blank = F.when(F.pmod("page_id", F.lit(4)) > 0, plain)
    assert share(blank, url) >= 0.95, "hosts stand in where texts are missing"


def test_more_than_two_hundred_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i % 260) * 3} word{i % 260}x", f"l{i % 260:03d}") for i in range(1040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pages = docs.where("doc_id >= 780").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h/"), "doc_id").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: r.text_lang for r in language_id.identify_languages(pages, docs.where("doc_id < 780")).collect()}
    assert got == {i: f"l{i % 260:03d}" for i in range(780, 1040)}


def test_text_outweighs_a_declaration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", "<html lang='de'><p>the and of that is to be with for on") for i in range(3)] + [(9, "http://h.example/9", None)], "page_id long, url string, html string")
    found = {r.page_id: r for r in language_id.identify_languages(pages, docs).collect()}
    assert all(found[i].lang == "en" for i in (0, 1, 2, 9)), "the text outweighs a wrong declaration, the host stands in for a missing text"


def test_link_graph(spark):
    link = lambda *to: "".join(f'<a href="http://{h}/">' for h in to)
    rows = [
        (1, "http://good.org/", link("fine.net")), (2, "http://fine.net/", link("good.org")), (3, "http://spam.net/", link("bad.com", "bad.com")), (4, "http://bad.com/de/x", ""),
        (5, "http://bad.com/other", link("//x.net/y")), (6, "HTTP://A.B.Org/en?q#f", ""), (7, "no scheme", None), (8, "http://far.net", link("spam.net")), (9, "http://example.org/en/12", ""),
        (10, "http://badexample.org/en/1", ""), (11, "http://org", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2][3] == "allow" and got[3][3] == "block" and got[8][3] == "block" and got[4] == ("bad.com", "/de/x", "com/de/", "block") and got[5][3] == "block"
    assert got[6] == ("a.b.org", "/en", "org/", "allow") and got[7] == ("", "", None, "allow") and got[9][2] == "example.org/en/1" and got[10][2] == "org/" and got[11] == ("org", "", None, "allow")


def masses(edges: list[tuple], seeds: dict, turns: int = 400) -> dict:
    names = sorted({x for s, t, _ in edges for x in (s, t)} | set(seeds))
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for s, t, n in edges:
        m[at[t], at[s]] += n
    m /= np.maximum(m.sum(axis=0), 1e-9)
    seed = 0.15 * np.array([seeds.get(x, 0.0) for x in names])
    p = seed
    for _ in range(turns):
        p = seed + 0.85 * m @ p
    return {x: v for x, v in zip(names, p, strict=True) if v}


def test_page_rank_by_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 3), ("c", "a", 1), ("d", "c", 5)]
    got = url_filters.propagate(spark.createDataFrame([("a", 0.6), ("d", 0.4)], "host string, seed double"), spark.createDataFrame(edges, "src string, dst string, n long"))
    assert {r.host: r.mass for r in got.collect()} == pytest.approx(masses(edges, {"a": 0.6, "d": 0.4}), rel=1e-3)


def page_verdicts(spark, rows: list[tuple]) -> dict[int, str]:
    return {r.page_id: r.verdict for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_random_host_graph(spark):
    draw = random.Random(21)
    hosts = [f"h{i}.net" for i in range(60)] + ["bad1.com", "bad2.com", "g1.org", "g2.org"]
    paths = {h: "/de/x" if h.startswith("bad") else "/x" for h in hosts}
    links = {h: draw.choices(hosts, k=draw.randint(0, 5)) for h in hosts}
    rows = [(i, f"http://{h}{paths[h]}", "".join(f"<a href='http://{t}/y'>" for t in links[h])) for i, h in enumerate(hosts)]
    count = Counter((h, t) for h in hosts for t in links[h] if h != t)
    trust = masses([(s, t, n) for (s, t), n in count.items()], {h: 1.0 for h in hosts if h.endswith(".org")})
    distrust = masses([(t, s, n) for (s, t), n in count.items()], {h: 1.0 for h in hosts if h.startswith("bad")})
    want = {h: "block" if distrust.get(h, 0) > (1 + 1e-9) * trust.get(h, 0) else "allow" for h in hosts}
    near = {h for h in hosts if abs(distrust.get(h, 0) - trust.get(h, 0)) < 1e-3 * max(distrust.get(h, 0), trust.get(h, 0))}
    got = page_verdicts(spark, rows)
    assert all(got[i] == want[h] for i, h in enumerate(hosts) if h.endswith(".net") and h not in near)
    assert {want[h] for h in hosts if h.endswith(".net")} == {"allow", "block"} and len(near) < 10


def test_far_hosts_and_small_seeds(spark):
    """Distrust reaches the end of a chain of 25 hosts, from one bad page among many, through a hub of many links."""
    chain = [(i, f"http://c{i}.net/", f"<a href='http://c{i - 1}.net/'>" if i else "<a href='http://bad.com/'>") for i in range(25)]
    hub = "".join(f"<a href='http://leaf{i}.net/'>" for i in range(3000))
    rest = [(100, "http://bad.com/de/1", ""), (101, "http://hub.net/", hub + "<a href='http://c24.net/'>")] + [(200 + i, f"http://x{i}.net/", "") for i in range(3000)]
    got = page_verdicts(spark, chain + rest)
    assert all(got[i] == "block" for i in [*range(25), 100, 101]) and got[200] == "allow"


def test_line_rules(spark):
    text = F.lit("Home | News | Shop | Cart\nAll rights reserved.\nBUY NOW OR NEVER AGAIN\nA plain line of words stays.\nwow!! so!! good!!\nA title\nthis long line has no end\nTous droits réservés.\nIt ends (in a bracket.)")
    assert spark.range(1).select(quality_rules.clean_lines(text)).first()[0] == "A plain line of words stays.\nA title\nIt ends (in a bracket.)"


def repeated_words(words: list[str]) -> int:
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})


@pytest.mark.parametrize("bits", [20, 17, 8])
def test_repeated_words_by_windows(spark, monkeypatch, bits):
    """Beyond 65,536 words; with too few bits for the places, windows are sorted by their words."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", bits)
    draw = random.Random(2)
    texts = [[draw.choice("abcdefghij") * draw.randint(1, 5) for _ in range(n)] for n in (3, 4, 300, 5000, 65_537)] + [[f"w{i}" for i in range(70_000)] + ["w1", "w2", "w3"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: (r.q.n_words, r.q.n_repeat_words) for r in df.select("i", quality_rules.quality(F.col("text")).alias("q")).collect()}
    assert got == {i: (len(t), repeated_words(t)) for i, t in enumerate(texts)}


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    """Twelve bits of hash beside 52 of place: windows clash, and are then told apart by their words."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 52)
    draw = random.Random(3)
    texts = [[f"w{draw.randint(0, 400)}" for _ in range(800)] for _ in range(6)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
    assert {r.i: r.q.n_repeat_words for r in df.select("i", quality_rules.quality(F.col("text")).alias("q")).collect()} == {i: repeated_words(t) for i, t in enumerate(texts)}


def test_cleaned_documents(spark):
    line = "plain{0} words{0} of{0} a{0} sentence{0} that{0} goes{0} on{0} for{0} a{0} long{0} while{0}."
    text = "\n".join([line.format(i) for i in range(6)] + ["Home | News | Shop | Cart | More", "Subscribe to our letter."])
    docs = spark.createDataFrame([(1, text, 999), (2, "too short.", 1)], "doc_id long, text string, n_chars long")
    (row,) = quality_rules.quality_stage(spark, docs, "").collect()
    assert row.text == "\n".join(line.format(i) for i in range(6)) and row.n_chars == len(row.text)


def test_pipeline_run(spark):
    """The stages on sf0.001 by brute force, each on what its predecessor kept."""
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in QUERIES["op6_quality_rules"](spark, SF).where("kept").collect()}
    clean = docs.select("*", quality_rules.clean_lines(F.col("text")).alias("clean"))
    texts = {r.doc_id: r.clean for r in clean.collect() if r.doc_id in kept}
    assert any(r.clean != r.text for r in clean.collect() if r.doc_id in kept)
    last: dict[str, int] = {}
    for i, t in texts.items():
        last[t] = max(last.get(t, i), i)
    texts = {i: t for t, i in last.items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near = {r.doc_id for r in jaccard_join.near_duplicate_components(frame).where("doc_id = component_id").collect()}
    cleaned = docs.drop("text").join(frame, "doc_id")
    mixed = mixing.mixing_stage(spark, cleaned.where(F.col("doc_id").isin(sorted(near))), SF)
    want = Counter(r.doc_id for r in mixed.collect())
    assert Counter(r.doc_id for r in out.collect()) == want and set(want) <= near


WIDE = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF"


def brute_spans(docs: list[tuple[int, str]], passage: int, marker: int) -> set[tuple[int, int, int]]:
    """Spans of repeated neighbouring units, by a dictionary of all of them."""
    seen, spans = set(), set()
    for doc, text in sorted(docs):
        words = [(m.start(), m.end(), m[0].translate({c: c + 32 for c in range(65, 91)})) for m in re.finditer(rf"[{WIDE}]|[^ \t-\r{WIDE}]+", text)]
        units = [[]]
        for k, (_, stop, word) in enumerate(words):
            units[-1].append(k)
            after = text[stop : words[k + 1][0]] if k + 1 < len(words) else ""
            if word[-1] in ".!?…。！？" or sum(map(ord, word)) % marker == 0 or "\n" in after:
                units.append([])
        units = [u for u in units if u]
        windows = [a + b for a, b in zip(units, units[1:], strict=False)] + [u for u in units if len(u) >= passage]
        found: list[list[int]] = []
        for w in sorted(windows, key=lambda w: (w[0], w[-1])):
            key = tuple(words[k][2] for k in w)
            if key in seen:
                if found and w[0] <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], w[-1] + 1)
                else:
                    found.append([w[0], w[-1] + 1])
            seen.add(key)
        spans |= {(doc, words[a][0], words[b - 1][1]) for a, b in found if b - a >= passage}
    return spans


def passages(seed: int) -> list[tuple[int, str]]:
    draw = random.Random(seed)
    words = lambda n: [draw.choice("abcdefgh") * draw.randint(1, 9) + str(draw.randint(0, 999)) + draw.choice(["", "", "", ".", ","]) for _ in range(n)]
    shared, chinese = words(54), "".join(chr(0x4E00 + draw.randint(0, 3000)) for _ in range(90)) + "\U00020001"
    docs = [(0, " ".join(words(30) + shared + words(40))), (1, " ".join(words(7)) + "\nÉté " + " ".join(shared).upper() + "\nend"), (2, " ".join(words(200)))]
    docs += [(4, "x" + chinese + "y"), (5, "Ж。" + chinese), (6, "tail " * 120), (7, ""), (8, " ".join(words(9) + shared[2:52]))]
    pool = [" ".join(words(draw.randint(1, 30))) for _ in range(12)]
    return docs + [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 9)))) for i in range(9, 60)]


@pytest.mark.parametrize("seed", [9, 10])
def test_repeated_spans_and_what_is_left(spark, seed):
    docs = passages(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    spans = substring_dedup.repeated_spans(frame)
    want = brute_spans(docs, substring_dedup.PASSAGE, substring_dedup.MARKER)
    got = spans.collect()
    assert {(r.doc_id, r.start, r.stop) for r in got} == want and len(got) == len(want)
    assert {1, 5, 8} <= {d for d, _, _ in want} and not {0, 2, 4} & {d for d, _, _ in want}
    left = {r.doc_id: (r.text, r.removed) for r in substring_dedup.remove_spans(frame.withColumn("removed", F.lit(1)), spans).collect()}
    for doc, text in docs:
        cuts = sorted((a, b) for d, a, b in want if d == doc)
        for a, b in reversed(cuts):
            text = text[:a] + text[b:]
        assert left[doc][0] == text and [tuple(c) for c in left[doc][1] or []] == cuts


@pytest.mark.parametrize("passage,hot", [(1, 20_000), (1, 3), (25, 2)])
def test_single_units_and_units_dealt_to_parts(spark, monkeypatch, passage, hot):
    """Every repeated unit with a passage of one word; units of many windows in parts."""
    monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", hot)
    docs = passages(12) + [(100 + k, "the same footer of all pages.\n" + f"own {k} text.") for k in range(40)]
    got = substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), passage).collect()
    want = brute_spans(docs, passage, substring_dedup.MARKER)
    assert {(r.doc_id, r.start, r.stop) for r in got} == want and len(got) == len(want)
    assert passage > 1 or {d for d, _, _ in want} >= set(range(101, 140))


def test_passages_are_found_and_clean_documents_left(spark):
    """Of documents that repeat a run of 51 words of an earlier one nine in ten are found; of those without a repeated run of 20, fewer than one in ten is touched."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: re.findall(r"[^ \t-\r]+", (r.text or "").lower()) for r in rows}
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    seen, repeats = set(), set()
    for i in sorted(texts):
        own = grams(texts[i], 51)
        if own & seen:
            repeats.add(i)
        seen |= own
    count = Counter(g for w in texts.values() for g in grams(w, 20))
    clean = {i for i, w in texts.items() if all(count[g] == 1 for g in grams(w, 20))}
    got = {r.doc_id for r in QUERIES["op9_substring_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got & repeats) >= 0.9 * len(repeats) > 50 and len(clean - got) >= 0.9 * len(clean) > 500


def test_a_block_read_by_several_tasks(spark):
    """Rows of a block in three partitions score as they do in blocks of their own partition."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17} ab" for k in range(1, 40))) for i in range(60)], "doc_id long, text string")
    docs = common.stored(docs.withColumn("train", F.col("doc_id") % 5 != 1).repartition(3))
    plain = {r.doc_id: r.score for r in lm_scoring.score_texts(docs).collect()}
    mixed = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, F.col("doc_id") % 2, F.col("doc_id")).collect()}
    assert plain.keys() == mixed.keys() and all(abs(plain[k] - mixed[k]) < 1e-6 for k in plain)
