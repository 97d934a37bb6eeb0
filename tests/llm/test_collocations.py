"""Collocations against counting every phrase by itself."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lumenlake.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, n long, rank int"


def plain(own, longest, least, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in own:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = set()
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])}
    return out


def rows():
    rng = random.Random(3)
    words = ["a", "B", "the", "é", "日本", "of", "x\xa0y", "🙂", "c"]
    own = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for _ in range(rng.choice([0, 1, 5, 60])))
        own.append((k, text, rng.choice(["en", "de", None, ""])))
    own += [(None, None, "en"), (5, "", None), (7, "New York City " * 40, "en"), (7, "New York City " * 40, "en"), (8, "york city hall. " * 15, "en"), (9, "so " * 30_000, "fr"), (10, "w." * 30, "fr")]
    return [(*r, "p", 1, 2) for r in own]


def test_against_all_phrases(spark):
    own = rows()
    df = spark.createDataFrame(own, DOCS)
    for longest, least, percent, top in ((3, 10, 50, 2000), (4, 3, 80, 7), (2, 10, 50, 5)):
        got = collocations.collocations(df, longest, least, percent, top)
        assert {tuple(r) for r in got.collect()} == plain(own, longest, least, percent, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    own = rows()
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: np.full(8, 255, np.uint8))
    assert {tuple(r) for r in collocations.collocations(spark.createDataFrame(own, DOCS)).collect()} == plain(own, 3, 10, 50, 2000)


def test_blocks_cut_at_breaks_only():
    text = ("one two three. four five, six " * 400).encode() + b"x" * 900 + b". end"
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": [text.decode(), None, "last one"]})
    whole, cut = Counter(), Counter()
    for most, count in ((1 << 20, whole), (200, cut)):
        for lang, block in collocations.blocks([batch], most):
            words, ids, last = collocations.tokens(block)
            words = words.to_pylist()
            count.update((lang, words[i], None if z else words[j]) for i, j, z in zip(ids, [*ids[1:], 0], last))
    assert whole == cut and sum(whole.values()) == 2404


def test_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 10**12 - 1, 10**12, 10**12 + 7
    got = spark.range(1).select(collocations.exact_score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first().s
    assert got == 10**6 * a * a // (l * r)


def test_packing():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    counts = rng.integers(1, 256, len(values))
    got = collocations.unpacked(collocations.packed(values, counts), len(values))
    assert (got[0] == values).all() and (got[1] == counts).all()
