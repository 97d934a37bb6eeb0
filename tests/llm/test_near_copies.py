"""Near copies by the first shingles that texts share: no pair is lost, and rows grow with what is shared only."""

import random
import time
import tracemalloc

import numpy as np

from lumenlake.llm import simhash
from lumenlake.operators import tables


def test_pairs_by_tokens_equal_all_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(6)]
    nodes = [(i, r.choice(base) ^ sum(1 << r.randrange(60) for _ in range(r.randrange(12))), r.randrange(80, 130), r.choice([i, i, i, 1000, 1001])) for i in range(300)]
    has = {t: [x for x in nodes if t == 0 or r.random() < (0.5 if t < 3 else 0.02)] for t in range(40)}
    rows = [(t, i, n, fp, bytes(simhash.BINS), group) for t, own in has.items() for i, fp, n, group in own]
    df = spark.createDataFrame(rows, "token long, node long, n long, fp long, spread binary, group long")
    want = {(a[0], b[0]) for a in nodes for b in nodes if a[0] < b[0] and a[3] != b[3] and (a[1] ^ b[1]).bit_count() <= 16 and 5 * min(a[2], b[2]) >= 4 * max(a[2], b[2])}
    assert len(want) > 1000
    for per_task in (20, 100, 16384):  # many parts and chunks, some, none
        assert {(x.a, x.b) for x in simhash.near_pairs(df, 16, None, per_task).collect()} == want
        few = {(x.a, x.b) for x in simhash.near_pairs(df, 16, 2, per_task).collect()}
        assert few and few < want


def test_texts_that_share_nothing_are_dealt_nowhere(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(f"{i}w{r.randrange(10**9)}" for _ in range(120)) for i in range(300)]
    copy = texts[7].split()
    copy[60] = "other"
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(copy)])), "doc_id long, text string")
    dealt, near_pairs = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda tokens, *more: (dealt.append(tokens.select("node").distinct().count()), near_pairs(tokens, *more))[1])
    got = {x.doc_id: x.component_id for x in simhash.near_copy_components(docs).collect()}
    assert got == {i: i for i in range(300)} | {300: 7}
    assert dealt == [2, 2]  # before, every text was dealt to nearly every shard


def test_only_texts_in_pairs_write_their_shingles(spark, monkeypatch):
    r = random.Random(7)
    phrase = " ".join(f"p{k}" for k in range(12))  # shared by all, so that all have a neighbour by some shingle
    texts = [" ".join([phrase, *(f"{i}w{r.randrange(10**9)}" for _ in range(120))]) for i in range(200)]
    copy = texts[7].split()
    copy[60] = "other"
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(copy)])), "doc_id long, text string")
    written = []

    def materialise(df, name):
        out = tables.materialise(df, name)
        arrays = [x for x, kind in out.dtypes if kind == "array<bigint>"]
        written.extend(sum(len(x[0]) for x in out.select(c).collect()) for c in arrays)
        return out

    monkeypatch.setattr(simhash, "materialise", materialise)
    got = {x.doc_id: x.component_id for x in simhash.near_copy_components(docs).collect()}
    assert got == {i: i for i in range(200)} | {200: 7}
    assert sum(written) < 201 * 128  # before, all shingles of all texts (and the first ones twice)


def test_repeated_rows_and_null_keys_stay_together(spark):
    text = " ".join(f"w{k}" for k in range(100))
    near = text.replace("w50", "other")
    rows = [(None, text)] * 50 + [(1, near)] * 50 + [(2, text), (3, None), (3, ""), (4, "alone")]
    found = simhash.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.component_id) for x in found) == [(0, 1)] * 50 + [(1, 1)] * 50 + [(2, 1), (3, 3), (3, 3), (4, 4)]


def test_small_tokens_are_compared_in_bounded_memory():
    rows, each = 1 << 15, 64
    token, node = np.arange(rows) // each, np.arange(rows)
    same, none = np.full(rows, 100), np.zeros(rows, np.int64)
    told = np.full(rows, -1)
    tracemalloc.start()
    a, _ = simhash.token_pairs(token, node, same, none.view(np.uint64), node, none, np.zeros((0, simhash.BINS), np.uint8), told, 16, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) >= rows * 4 and peak < 64 << 20, (len(a), peak >> 20)


def test_what_a_written_table_shuffled_goes_at_once(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x.name() for x in map(store.getAllBlocks().apply, range(store.getAllBlocks().size())) if x.isShuffle()}
    before = held()
    assert tables.materialise(spark.range(1000).repartition(3, "id"), "gone").count() == 1000
    time.sleep(1)  # Spark removes them behind
    own = held() - before
    assert len({x.split("_")[1] for x in own}) <= 1, own  # of the count alone; before, of the write too
    assert spark.conf.get(tables.SHUFFLED_GOES) == "false"
