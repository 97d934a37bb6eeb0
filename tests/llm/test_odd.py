"""Odd columns, empty tables and ties, for the operators whose own tests do not hold them."""

from lumenlake.llm import quality_cnn, queries, sharding, simhash, vectors

KINDS = "doc_id long, text string, lang string, source string, n_chars long, _kept string, row string, key string, fp long, shard int, score string"
MORE = ("x", "r", "k", 5, 3, "s")
ROWS = [(k, t, None, "s", 0, *MORE) for k, t in ((1, None), (2, ""), (None, "one two"), (3, "same words here"), (3, "same words here"), (4, "w " * 600_000 + "é🙂"), (5, "same words here"))]


def test_simhash_keeps_columns(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    for dedup in (simhash.simhash_dedup, simhash.near_copy_dedup):
        got = dedup(df).collect()
        assert dedup(df).columns == df.columns and all((r._kept, r.row, r.key, r.fp) == ("x", "r", "k", 5) for r in got)
        assert sorted(str(r.doc_id) for r in got) == ["1", "3", "3", "4", "None"]
        assert dedup(df.limit(0)).count() == 0


def test_a_repeated_key_keeps_no_copy(spark):
    rows = [(3, "alpha beta gamma delta epsilon zeta"), (5, "alpha beta gamma delta epsilon zeta"), (5, "other words that stand quite alone here"), (None, "alpha beta gamma delta epsilon zeta"), (None, "one more text that nobody else has"), (None, "one more text that nobody else has")]
    for dedup in (simhash.simhash_dedup, simhash.near_copy_dedup):
        got = sorted(map(tuple, dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        assert got == [rows[0], rows[2], rows[4], rows[4]]


def test_classifier(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    labels = spark.createDataFrame([(3, 1), (4, 0), (2, 0), (1, 1), (3, 0)], "doc_id long, quality int")
    got = quality_cnn.classify_quality(df, labels)
    rows = got.collect()
    assert got.columns == [*df.columns, "predicted"] and len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.text in (None, "")}) == 1
    assert quality_cnn.classify_quality(df.limit(0), labels).count() == 0


def test_the_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, "t" * 1000 + str(k)) for k in range(500)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(7, None), (None, 1)], "doc_id long, quality int")
    texts, marks = quality_cnn.training_sample(docs, labels, 20)
    assert len(texts) == len(marks) == 20
    some, _ = quality_cnn.training_sample(docs, labels, 20, 3500)
    assert some == texts[:4] and quality_cnn.training_sample(docs, labels, 20)[0] == texts


def test_sharding(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    got = sharding.shard_records(df, 4, [1.0, 0.0, 2.0, 1.0])
    rows = got.collect()
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(rows) == 7
    assert all(r.shard != 1 and r.grown_shard in (r.shard, 4) for r in rows)
    more = sharding.shard_records(df, 5, [1.0, 0.0, 2.0, 1.0, 1.0]).collect()
    assert {(r.doc_id, r.grown_shard) for r in rows} == {(r.doc_id, r.shard) for r in more}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 5, "c"), (1, [1.0, 0.0], 5, "c"), (2, [2.0, 0.0], 5, "c"), (3, [1.0, 0.0, 0.0], 5, "c"), (None, [0.0, 1.0], 5, "c"), (4, None, 5, "c"), (5, [float("inf"), 1.0], 5, "c"), (6, [0.9, 0.4358898943540674], 5, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, copies int, cid string")
    got = {(r.vec_id, r.n_links, r.component_id) for r in vectors.embedding_dedup(df, recall=0.999999).collect()}
    assert (1, 3, 1) in got and (2, 3, 1) in got and (3, 0, 3) in got and (4, 0, 4) in got and (5, 0, 5) in got and (6, 3, 1) in got
    assert vectors.embedding_dedup(df.limit(0)).count() == 0


def test_recall_of_the_index_at_full_width(spark):
    """At 10,000 vectors and more bits a band, against all pairs."""
    import numpy as np

    r = np.random.default_rng(6)
    base = r.normal(size=(9000, 24))
    near = base[:3000] + r.normal(size=(3000, 24)) * 0.3
    v = np.concatenate([base, near])
    assert vectors.plan_bands(len(v), 0.9, 0.998)[0] >= 8 and vectors.plan_bands(1 << 30, 0.9, 0.998)[0] == 24
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in vectors.embedding_dedup(df).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.array([(u[i : i + 500] @ u.T >= 0.9).sum(1) - 1 for i in range(0, len(v), 500)]).ravel()
    found = np.array([got[i] for i in range(len(v))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() > 1000


def test_queries_are_registered():
    assert sorted(queries.QUERIES, key=len)[0] == "pipeline" and len(queries.QUERIES) == 14
