"""Many searches, suggestions and undone operations at once, against doing them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import many, rewrite, search

MEDIA = "path string, name string, tags array<string>, auto_tags array<string>"


def test_searches_equal_the_plain_filter(spark):
    rng = random.Random(4)
    words = ["good", "junk", "hidden", "iso:low", "year:2019", "ab", "x"]
    rows = []
    for k in range(150):
        name = "".join(rng.choice(["ab", "A", "é", "_1", ".JPG", "good", "日", "x"]) for _ in range(rng.randint(0, 5)))
        rows.append((f"/p/{k}", name if k % 17 else None, rng.sample(words, rng.randint(0, 3)) if k % 4 else [], rng.sample(words, rng.randint(0, 2)) if k % 5 else None))
    df = spark.createDataFrame(rows, MEDIA).repartition(3)
    texts = ["good", "ab x", "AB  untagged", "untagged", "hidden", "hidden junk", "é", "日 .jpg", "ab_1", "nothing", "", "  ", "a good good", "x untagged é", "iso:low year:2019", None]
    asked = [(f"{m}{k}", q, m) for k, q in enumerate(texts) for m in ("all", "any")]
    got = {}
    for r in many.search_many(df, spark.createDataFrame(asked, "query_id string, q string, match string")).collect():
        assert r.path not in got.setdefault(r.query_id, set())
        got[r.query_id].add(r.path)
    filled = df.withColumn("auto_tags", F.coalesce("auto_tags", F.array().cast("array<string>"))).withColumn("name", F.coalesce("name", F.lit("\0"))).cache()
    for key, q, m in asked:
        want = {r.path for r in search.match_tokens(search.exclude_hidden(filled), []).limit(0).collect()}
        if (q or "").strip():
            tokens = q.lower().split()
            own = filled if "hidden" in tokens else search.exclude_hidden(filled)
            own = search.filter_untagged(own) if "untagged" in tokens else own
            want = {r.path for r in search.match_tokens(own, [t for t in tokens if t != "untagged"], m).collect()}
        assert got.get(key, set()) == want, (key, q)
    assert many.search_many(df.limit(0), spark.createDataFrame(asked, "query_id string, q string, match string")).count() == 0


def test_suggestions_equal_one_at_a_time(spark):
    rng = random.Random(6)
    names = {"".join(rng.choice("abcé:-_ 1") for _ in range(rng.randint(1, 9))) for _ in range(120)} | {"Camera:Canon", "camera:canon", "zoo"}
    stats = spark.createDataFrame([(n, k, "system" if k % 11 == 0 else "user" if k % 3 else "auto") for k, n in enumerate(sorted(names))] + [("zoo", 99, "auto")], "name string, count long, kind string")
    asked = [(0, "a", []), (1, "A", ["zoo"]), (2, "", None), (3, "can", ["camera:canon"]), (4, "qqq", []), (5, "b c", None), (6, "éa", []), (7, "", sorted(names)[:4]), (8, None, []), (9, "aa", []), (10, "zo", []), (11, "zo", ["zoo"])]
    got = many.suggest_many(stats, spark.createDataFrame(asked, "query_id int, q string, chosen array<string>"), 5).collect()
    for key, q, chosen in asked:
        want = [(r.name, r["count"]) for r in search.suggest_tags(stats, q or "", chosen or [], 5).collect()]
        own = sorted((r for r in got if r.query_id == key), key=lambda r: r.rank)
        assert [(r.name, r["count"]) for r in own] == want and [r.rank for r in own] == list(range(1, len(want) + 1)), (key, q)


def undone(rows, ops, trash, k):
    """Each operation taken back by itself."""
    here, results = {p: h for p, h in rows}, {}
    for number in sorted({o[0] for o in ops}, reverse=True)[:k]:
        own = [o for o in ops if o[0] == number]
        lifted = {o[3]: here.pop(o[3]) for o in own if o[1] == "move" and o[3] in here}
        for _, kind, old, new in own:
            ok = False
            if kind == "move" and new in lifted:
                here[old], ok = lifted[new], True
            if kind == "delete" and (number, old) in trash:
                here[old], ok = trash[number, old], True
            results[number, old] = ok
    return set(here.items()), results


@pytest.mark.parametrize("seed", range(3))
def test_undo_of_many_operations(spark, seed):
    rng = random.Random(seed)
    here = {f"/{k}": f"h{k}" for k in range(40)}
    ops, trash = [], {}
    for number in range(1, 14):
        kind = rng.choice(["move", "move", "delete", "permanent-delete"])
        some = rng.sample(sorted(here), min(len(here), 12 if kind == "move" else 2))
        if kind != "move":
            for p in some:
                ops.append((number, kind, p, None))
                if kind == "delete":
                    trash[number, p] = here[p]
                del here[p]
        else:
            free = [f"/{k}" for k in range(48) if f"/{k}" not in here]
            for p, q in zip(some, rng.sample(free, min(len(free), len(some)))):
                ops.append((number, kind, p, q))
                here[q] = here.pop(p)
    lost = rng.choice(sorted(here))  # removed by something else
    del here[lost]
    df = spark.createDataFrame([(p, p[1:], h, ["t"]) for p, h in here.items()], "path string, name string, hash string, tags array<string>")
    undo = spark.createDataFrame(ops, "op_seq int, kind string, old_path string, new_path string")
    bin_ = spark.createDataFrame([(n, p, h) for (n, p), h in trash.items()], "op_seq int, original_path string, hash string")
    for k in (1, 2, 5, 13, 32):
        want, outcome = undone(here.items(), ops, trash, k)
        results, out = rewrite.plan_undo(df, undo, bin_, k)
        assert {(r.path, r.hash) for r in out.collect()} == want
        assert all(r.name == r.path[1:] for r in out.collect())
        assert {(r.op_seq, r.path): r.success for r in results.collect()} == outcome
    with pytest.raises(ValueError):
        rewrite.plan_undo(df, undo, bin_, rewrite.DEPTH + 1)


def test_undo_of_a_swap(spark):
    df = spark.createDataFrame([("/a", "b's", ), ("/b", "a's")], "path string, hash string").withColumn("name", F.col("path"))
    undo = spark.createDataFrame([(1, "move", "/a", "/t"), (2, "move", "/b", "/a"), (3, "move", "/t", "/b")], "op_seq long, kind string, old_path string, new_path string")
    none = spark.createDataFrame([], "original_path string, hash string")
    assert {(r.path, r.hash) for r in rewrite.plan_undo(df, undo, none, 3)[1].collect()} == {("/a", "a's"), ("/b", "b's")}
    assert {(r.path, r.hash) for r in rewrite.plan_undo(df, undo, none, 1)[1].collect()} == {("/a", "b's"), ("/t", "a's")}
