"""The filter audit against applying each order of filters to the documents, one by one."""

import re
from itertools import permutations

import numpy as np

from lumenlake.llm import filteraudit

DOCS = "doc_id long, text string, source string, part string, n long, mask int, id string"
LABELS = "doc_id long, quality int, toxic int, part string"


def rows():
    words = [f"w{k}" for k in range(300)]
    long, again = " ".join(words), " ".join(["w"] * 250)
    texts = [long, long, long + " #", again, "", None, "ABC DEF", long + " X" * 300, again, "a\x0bb", long, None, "é" * 9]
    own = [(k, t, ("s1", "s2", None, "")[k % 4]) for k, t in enumerate(texts)]
    own += [(2, long, "s1"), (0, long, "s2"), (None, long, "s1"), (None, long, "s1"), (40, long, "s9"), (40, long, "s9"), (41, " ".join(words * 2000), "s9")]
    return [(*r, "p", 1, 2, "x") for r in own]


def plain(own, labels):
    word = re.compile("[^\x20\x09-\x0d]+")
    flags = []
    for i, t, s, *_ in own:
        t = t or ""
        w = word.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in own)
        flags.append((s or "", i, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}))
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, *_ in labels if t == 1 and i is not None}
    out = {}
    for part in {x[0] for x in flags}:
        docs, total = [x for x in flags if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone = [x for x in left if x[2][f]]
                fails = [x for x in docs if x[2][f]]
                left = [x for x in left if not x[2][f]]
                total[f] += len(gone)
                alone = sum(sum(x[2].values()) == 1 for x in fails)
                out[part, order, k + 1] = [len(left), len(gone), len(fails) - len(gone), alone, sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone), f]
        for key in out:
            if key[0] == part:
                out[key][-1] = total[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_against_every_order(spark):
    own = rows()
    labels = [(0, 1, 0, "z"), (1, 0, 1, "z"), (1, 1, 0, "z"), (3, 0, 1, "z"), (None, 1, 1, "z"), (40, 1, None, "z"), (40, None, 1, "z"), (99, 1, 1, "z")]
    got = filteraudit.audit_filters(spark.createDataFrame(own, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain(own, labels) and len(got) == 4 * 600
    reversed_rows = filteraudit.audit_filters(spark.createDataFrame(own[::-1], DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, reversed_rows)) == sorted(map(tuple, got))


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], LABELS)
    assert filteraudit.audit_filters(docs.limit(0), labels).count() == 0
    got = filteraudit.audit_filters(docs, labels).collect()
    assert len(got) == 2400 and all(r.good_lost == r.toxic_lost == 0 for r in got)


def test_other_filters(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = filteraudit.audit_filters(docs, spark.createDataFrame([], LABELS), {"x": filteraudit.has_symbols}, "y")
    assert {(r.filter_order, r.step) for r in got.collect()} == {("xy", 1), ("xy", 2), ("yx", 1), ("yx", 2)}


def test_contraction():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (3, 2, 2, 2))
    where, got = filteraudit.contract(counts, "ABC")
    k = where.index(("CAB", 2))
    assert got[0][k] == counts[0][0, :, 0].sum() and got[1][k] == counts[0][1, :, 0].sum() and got[2][k] == counts[0][1, :, 1].sum() and got[3][k] == counts[0][1, 0, 0]
