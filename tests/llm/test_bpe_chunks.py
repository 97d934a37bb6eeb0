"""Long texts, whose chunks go to many tasks, against tiktoken."""

import base64
import hashlib
import random

import numpy as np
import tiktoken

from lumenlake.llm import bpe, queries


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hold(spark, texts, **options):
    own = plain()
    df = spark.createDataFrame([(i, t, "i", "x", "r") for i, t in enumerate(texts)], "doc_id long, text string, id string, _bpe string, row string")
    out = bpe.encode_documents(df, queries.RANKS, queries.PATTERN, **options)
    assert out.columns[:5] == df.columns
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(t) and r.n_tokens == len(r.ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and (r.id, r._bpe, r.row) == ("i", "x", "r")


def test_small_chunks_of_odd_texts(spark):
    r = random.Random(1)
    words = ["the", " of", "'s", "'re", "  ", "\n\n", "é漢字", "12", "🙂", "...", "x" * 40]
    texts = ["".join(r.choice(words) + " " * r.randrange(2) for _ in range(n)) for n in (0, 5, 50, 300, 2000, 5000)]
    texts += ["y" * 3000 + " z " * 2000, None, "w w " * 3000 + "q" * 700 + " ' 's" * 500, " " * 5000]
    hold(spark, texts + texts[5:6], chunk=1000, overlap=64)


def test_a_text_of_a_million_characters(spark):
    r = random.Random(2)
    words = ["the ", "of ", "and\n", "naïve ", "  ", "it's ", "4711 ", "§§ "]
    hold(spark, ["".join(r.choice(words) for _ in range(300_000)), "short"])
