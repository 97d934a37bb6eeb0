"""Equal searches are answered once; neighbours are found block by block."""

import random

from pyspark.sql import functions as F

from lumenlake.operators import clusters, many


def test_equal_searches_are_answered_once(spark, monkeypatch):
    made = {}
    keep = many.materialise
    monkeypatch.setattr(many, "materialise", lambda df, name: made.setdefault(name, keep(df, name)))
    df = spark.createDataFrame([("/a", "ab", ["x"], ["y"]), ("/b", "b", [], ["y"])], "path string, name string, tags array<string>, auto_tags array<string>")
    q = spark.range(60).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "y b").otherwise("B  y").alias("q"), F.when(F.col("id") % 3 == 0, "all").otherwise("any").alias("match"))
    assert many.search_many(df, q).count() == 120
    assert made["asks"].count() == 2


def test_neighbours_of_blocks_equal_all(spark, monkeypatch):
    for name in ("VECTORS_SIDE", "QUERIES_SIDE"):
        monkeypatch.setattr(clusters, name, 7)
    r = random.Random(8)
    rows = [(k, [r.uniform(-1, 1) for _ in range(4)]) for k in range(60)]
    rows += [(60 + k, rows[0][1]) for k in range(9)] + [(80, None), (81, [0.0] * 4), (82, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = clusters.semantic_neighbours(df, df.where("vec_id % 5 = 0"), 3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()

    def score(a, b):
        if not a or not b or None in a + b or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)

    want = set()
    for q, a in rows:
        if q % 5 == 0:
            best = sorted([(-s if (s := score(a, b)) is not None else 9.0, v) for v, b in rows if v != q])[:3]
            want |= {(q, v, k + 1) for k, (_, v) in enumerate(best)}
    assert {tuple(x) for x in found.select("query", "vec_id", "rank").collect()} == want
