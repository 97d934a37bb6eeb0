"""Fertility measures and bands against a plain version."""

import base64
import re

import numpy as np
import sentencepiece
import tiktoken

from lumenlake.llm import fertility, queries

SF = "/root/testdata/sf0.001"


def byte_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_measures(model, encoding, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = model.encode(" ".join(words))
    if not ids:
        return None
    counts = np.array(list({i: ids.count(i) for i in set(ids)}.values()), float) / len(ids)
    fallback = sum(model.is_byte(i) or model.is_unknown(i) for i in ids) / len(ids)
    chars = sum(map(len, words))
    return chars / len(ids), fallback, float(-(counts * np.log2(counts)).sum()), len(ids), chars / sum(len(encoding.encode_ordinary(" " + w)) for w in words)


def test_measures_and_bands_equal_plain_ones(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000")
    got = {r.doc_id: r for r in fertility.fertility_rules(docs, queries.PIECES, queries.RANKS, queries.PATTERN).collect()}
    own, groups, encoding = {}, {}, byte_encoding()
    for r in docs.collect():
        g, own[r.doc_id] = got[r.doc_id], plain_measures(model, encoding, r.text)
        if own[r.doc_id] is None:
            assert g.chars_per_token is None and g.base_failed
            continue
        chars, fallback, entropy, n, by_byte = own[r.doc_id]
        assert abs(g.chars_per_byte_token - by_byte) < 1e-9
        assert abs(g.chars_per_token - chars) < 1e-9 and abs(g.fallback_share - fallback) < 1e-9 and abs(g.entropy - entropy) < 1e-6
        own[r.doc_id] = (chars, by_byte, fallback, entropy / np.log2(n + 1))
        if not g.base_failed:
            groups.setdefault(r.lang, []).append(own[r.doc_id])
    ends = {}
    for lang, rows in groups.items():
        low, mid, high = np.quantile(np.array(rows), [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
        wide = np.maximum((high - low) / 2 * 10.0, (0.6, 0.6, 0.02, 0.06))
        below = np.maximum((high - low) / 2 * (5.0, 6.0, 10.0, 3.8), (0.1, 0.12, 0.02, 0.06))
        ends[lang] = (mid - below, mid + wide)
    for r in docs.collect():
        g = got[r.doc_id]
        if not g.base_failed:
            low, high = ends[r.lang]
            inside = all(a - 1e-9 <= x <= b + 1e-9 for x, a, b in zip(own[r.doc_id], low, high))
            assert g.kept == inside and (g.reason is None) == inside


def test_null_languages_are_judged_by_script(spark):
    clean = ["the cat sat on the mat and looked at all of the other animals near the old house by the river " * 1 + f"number {k} of many tales about it " + "and so on they went home to sleep under the roof of straw that kept them warm in winter while snow fell outside all day and night until spring came back with sun" for k in range(30)]
    rows = [(k, t, None, "s", "b") for k, t in enumerate(clean)] + [(99, "ĦŁŊŦ ʭʬ ꙮꙮ " * 3 + " ".join(chr(0x1F300 + k) + chr(0x2A00 + k) for k in range(80)), None, "s", "b"), (100, None, None, "s", "b"), (101, "", None, "s", "b")]
    got = {r.doc_id: r for r in fertility.fertility_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, script string, band_group string"), queries.PIECES, queries.RANKS, queries.PATTERN).collect()}
    assert all(got[k].kept for k in range(30)) and got[100].base_failed and got[101].base_failed and not got[100].kept
    assert got[0].script == "Latin" and got[0].band_group == "script:Latin"


def test_each_measure_rejects(spark):
    """Texts that pass the base rules, each odd in one way."""
    import random

    rng = random.Random(8)
    common = "time people water world house night place story friend morning river garden winter summer letter market window mother father school".split()
    words = lambda n, own: " ".join(rng.choice(own) for _ in range(n))
    clean = [words(200, rng.sample(common, 16)) for _ in range(60)]
    odd = {"chars_per_token": words(200, ["xqzvk", "jjwq", "zxcvb", "qpwoei", "kjhgf", "vbnmz", "wqxzj", "hjkzx", "qqzz", "bvcxq", "zzkq", "pqwx"]), "entropy_rate": " ".join(["time"] * 30 + [f"{a} {b}" for a in common[:9] for b in ["time"] * 9]), "fallback_share": words(150, common) + " " + " ".join(chr(0x10300 + k) for k in range(16))}
    rows = [(k, t, "en") for k, t in enumerate(clean)] + [(100 + k, t, "en") for k, t in enumerate(odd.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    for k, name in enumerate(odd):
        got = {r.doc_id: r for r in fertility.fertility_rules(df, queries.PIECES, queries.RANKS, queries.PATTERN, most_repeated=101, ends={name: fertility.BANDS[name]}).collect()}
        assert all(got[k].kept for k in range(60)) and got[100 + k].reason == name
