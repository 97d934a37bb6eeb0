"""Removal of repeated strings against a search for each of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lumenlake.llm import suffixes

DOCS = "doc_id long, text string, h1 long, spans string, lead string"


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i + 1] += 1
                gone[i + length + 1] -= 1
        gone = np.cumsum(gone)[1:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    license_, story = prose(60), prose(400)
    own = [None, "", "short", prose(30), story, story, story[:900] + "X" + story[900:], story[100:800], "a" * 1000, "ab" * 300, "日本語" * 100]
    own += [f"{prose(rng.randint(0, 80))} {license_} {prose(rng.randint(0, 80))}" for _ in range(150)]
    own += [license_, license_[:199], license_[3:], (prose(40) + license_) * 2, prose(5000), prose(20) + "a" * 201]
    return own


@pytest.mark.parametrize(("length", "token", "bucket"), [(200, 32, 1 << 15), (200, 32, 1 << 23), (64, 64, 1 << 15), (45, 8, 1 << 14)])
def test_against_all_strings(spark, monkeypatch, length, token, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    own = texts()
    rows = [(k if k % 9 else None, t, 7, "s", "l") for k, t in enumerate(own)]
    df = spark.createDataFrame(rows, DOCS)
    got = suffixes.dedup_substrings(df, length, token)
    assert got.columns == ["doc_id", "text", "h1", "lead", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
    want = Counter((t, *x) for t, x in zip(own, plain(own, length)))
    rows = got.collect()
    assert Counter((r.text, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256, bytes(r.kept)) for r in rows) == want
    for r in rows:
        assert all(r.h1 == 7 and r.lead == "l" and 0 <= x.begin < x.end <= r.n_bytes for x in r.spans)


def test_empty_tables(spark):
    assert suffixes.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
    got = suffixes.dedup_substrings(spark.createDataFrame([(1, None, 0, "", "")], DOCS)).collect()
    assert [(r.n_bytes, r.n_removed, r.spans, bytes(r.kept)) for r in got] == [(0, 0, [], b"")]


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    monkeypatch.setattr(suffixes.cut_texts, "__defaults__", (1000,))
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(3000))
    own = ["".join(rng.choice("abcdef ") for _ in range(5000)) + passage + "z", "y" + passage + passage[:1500]]
    cut = list(suffixes.cut_texts([((1, 2), own[0].encode())], 200, 1000))
    assert len(cut) == 8 and all(len(t) <= 1199 for _, group in cut for t in group)
    for length in (200,):
        groups = [suffixes.contexts_of(g, length, 32) for _, g in cut]
        assert sum((x[2] - x[1] + 1).sum() for x in groups) == len(own[0]) - length + 1


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 4000).astype(np.uint8)] * 2)
    starts = rng.permutation(len(data) - 30)
    places, group = suffixes.multikey_quicksort(data, starts, 21)
    string = lambda p: data[starts[p] : starts[p] + 21].tobytes()
    count = Counter(map(string, range(len(starts))))
    assert sorted(places) == [p for p in range(len(starts)) if count[string(p)] > 1]
    order = [string(p) for p in places]
    assert order == sorted(order) and all((a == b) == (x == y) for a, b, x, y in zip(order, order[1:], group, group[1:]))
