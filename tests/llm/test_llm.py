"""The operators against plain versions, an exact round trip, or held-out accuracy, and odd inputs."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenlake.llm import bpe, fertility, mixing, quality_cnn, queries, sharding, simhash, vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, "one two", "en", "a", 7, "x"), (3, "same words here", "en", "b", 3, "x"), (3, "same words here", "en", "b", 3, "x"), (4, "w " * 3000 + "é🙂", None, "a", 1, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_equals_tiktoken(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_documents(documents, queries.RANKS, queries.PATTERN)
    decoded = out.withColumn("back", bpe.bpe_decoded(F.col("ids"), queries.RANKS, queries.PATTERN))
    for r in decoded.collect():
        ids = own.encode_ordinary(r.text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.back == r.text.encode()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_bpe_chunks_meet():
    r, ranks = random.Random(1), bpe.Ranks(queries.RANKS, queries.PATTERN)
    plain = bpe.RegexSplitter(queries.PATTERN)
    for _ in range(3000):
        x = "".join(r.choice("ab 's're'll\n\t  12é漢🙂.,!'") * r.choice([1, 1, 9]) for _ in range(r.randrange(40)))
        for splitter in (ranks.splitter, plain):
            assert bpe.pretokenise(splitter, x, r.randrange(4, 30), r.randrange(1, 9)) == plain.find.findall(x)


def test_bpe_odd(odd):
    out = bpe.encode_documents(odd, queries.RANKS, queries.PATTERN)
    assert out.count() == 6 and out.where("n_tokens = 0").count() == 2 and bpe.encode_documents(odd.limit(0), queries.RANKS, queries.PATTERN).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    import xxhash

    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_equals_all_pairs(documents):
    got = simhash.simhash_components(documents).orderBy("doc_id").collect()
    rows = documents.orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    assert [r.fp % 2**64 for r in got] == prints
    want = plain_components(len(rows), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    assert [r.component_id for r in got] == [rows[k].doc_id for k in want]


def test_vantage_tree_loses_no_pair():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(1, 6), replace=False)) for _ in range(900)], np.uint64)
    points = np.unique(np.concatenate([base, np.repeat(base, 3) ^ flips]))
    nodes = simhash.plant(points, 16)
    homes, visitors = {}, {}
    for leaf, own, home in simhash.route(nodes, points, 3):
        (homes if home else visitors).setdefault(leaf, []).append(points[own])
    assert sum(len(x) for v in homes.values() for x in v) == len(points)
    labels = {p: p for p in points.tolist()}
    edges = [(a, b) for k, v in homes.items() for a, b in zip(*[x.tolist() for x in simhash.shard_links(np.concatenate(v), np.concatenate(visitors.get(k, [points[:0]])), 3, True)])]
    for _ in range(30):
        for a, b in edges:
            labels[a] = labels[b] = min(labels[a], labels[b])
    want = plain_components(len(points), lambda i, j: bin(int(points[i]) ^ int(points[j])).count("1") <= 3)
    assert [labels[p] for p in points.tolist()] == [int(points[k]) for k in want]


def test_simhash_odd(odd):
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(odd).collect()}
    assert (1, 1) in got and (2, 1) in got and (3, 3) in got
    assert simhash.simhash_dedup(odd).count() == 5 and simhash.simhash_dedup(odd.limit(0)).count() == 0


def test_vectors_equal_all_pairs(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    v = np.concatenate([base, base[:40] + r.normal(size=(40, 16)) * 0.35, base[:10]]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16), (204, [])]
    got = {x.vec_id: x for x in vectors.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), most=16).collect()}
    u = v.astype(np.float64)
    cos = (u @ u.T) / np.outer(np.linalg.norm(u, axis=1), np.linalg.norm(u, axis=1))
    want = plain_components(len(v), lambda i, j: cos[i, j] >= 0.9)
    recall = sum(got[i].n_links for i in range(len(v))) / ((cos >= 0.9).sum() - len(v))
    assert 0.98 <= recall <= 1
    assert np.mean([got[i].component_id == want[i] for i in range(len(v))]) > 0.97
    assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 205))


def test_estimates_are_unbiased():
    r = np.random.default_rng(4)
    a = r.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a * 0.9 + np.sqrt(1 - 0.81) * np.linalg.qr(r.normal(size=(64, 64)))[0][0]
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    turned, _, _ = vectors.codes(b, 17)
    _, code, factor = vectors.codes(a, 17)
    error = (code * turned).sum(1) / factor - (a * b).sum(1)
    assert abs(error.mean()) < 0.02
    assert ((code * turned).sum(1) / factor >= vectors.lowest_estimate(factor, 64, float((a * b).sum(1).min()), 4.0)).all()


def test_sharding(odd, documents):
    a = sharding.shard_records(documents, 10).collect()
    assert all(r.grown_shard in (r.shard, 10) for r in a) and any(r.grown_shard == 10 for r in a)
    for s in range(10):
        slots = sorted(r.slot for r in a if r.shard == s)
        assert slots == list(range(len(slots)))
    heavy = sharding.shard_records(documents, 2, [9.0, 1.0]).where("shard = 0").count()
    assert 0.8 < heavy / len(a) < 0.97
    assert sharding.shard_records(odd).count() == 6 and sharding.shard_records(odd.limit(0)).count() == 0


def test_demand_is_inverted(spark):
    t = spark.range(11).select((F.col("id") / 10).alias("d")).select("d", mixing.time_of(F.col("d"), F.lit(0.5)).alias("t")).collect()
    assert all(abs(0.5 * r.t + 0.5 * r.t**2 - r.d) < 1e-9 for r in t)


def plain_repeated(w):
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
    return len(hit)


def test_fertility(documents, odd):
    got = {r.doc_id: r for r in fertility.fertility_rules(documents, queries.PIECES, queries.RANKS, queries.PATTERN).collect()}
    for r in documents.where("length(text) < 3000").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), plain_repeated(w))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g.base_failed and g.kept)
    assert fertility.fertility_rules(odd, queries.PIECES, queries.RANKS, queries.PATTERN).count() == 6 and fertility.fertility_rules(odd.limit(0), queries.PIECES, queries.RANKS, queries.PATTERN).count() == 0


def test_quality(spark, odd):
    out = queries.op1_quality_cnn(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg((F.col("quality") == 1).cast("int"))).first()
    assert r[0] > max(0.9, r[1])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_cnn.classify_quality(odd, labels).collect()
    assert len(got) == 6 and all(0 <= x.score <= 1 for x in got)


def near_copies(seed=3):
    """Texts, some with a few words changed, so that many copies of 0.8 or more are over three bits apart."""
    r = random.Random(seed)
    texts = []
    for k in range(30):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        texts += [" ".join(w)] * (1 + k % 2)
        for share in (0.01, 0.02, 0.05):
            v = list(w)
            for i in r.sample(range(len(w)), max(1, round(share * len(w)))):
                v[i] = "changed"
            texts.append(" ".join(v))
    return texts + ["", " ", "Two Words", "two words", "two words more"]


def plain_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies_equal_all_pairs(spark, odd):
    import corpus_pipeline

    texts = near_copies()
    sets = [plain_shingles(x) for x in texts]
    want = plain_components(len(texts), lambda i, j: plain_alike(sets[i], sets[j]))
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.component_id for r in simhash.near_copy_components(docs).collect()}
    found = [got[i] for i in range(len(texts))]
    exact = plain_components(len(texts), lambda i, j: found[i] == found[j] and plain_alike(sets[i], sets[j]))
    assert found == exact  # what is linked is linked by pairs of the least similarity
    assert sum(a != b for a, b in zip(found, want)) <= 0.02 * len(texts)  # the radius loses few
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near_copies(spark, docs, SF).collect()) == sorted(set(found))
    before = {r.doc_id for r in simhash.simhash_dedup(docs).select("doc_id").collect()}
    assert len(set(found)) < 0.8 * len(before)
    assert simhash.near_copy_dedup(odd).count() == 5 and simhash.near_copy_dedup(odd.limit(0)).count() == 0


def test_fertility_rejects_junk_by_a_band(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    named = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(quality_cnn.held_out(F.col("doc_id")))
    rows = fertility.fertility_rules(docs, queries.PIECES, queries.RANKS, queries.PATTERN).join(named, "doc_id").where("NOT base_failed").collect()
    lost = lambda q: [r.reason == "chars_per_token" for r in rows if r.quality == q]
    assert sum(lost(0)) >= 0.7 * len(lost(0)) > 0 and sum(lost(1)) <= 0.05 * len(lost(1))
