"""The pipeline as a whole against a plain version, and each stage's columns."""

import pytest

import corpus_pipeline
from lumenlake.llm import quality_cnn

from .test_bpe_chunks import plain
from .test_lines import plain_dedup
from .test_llm import plain_alike, plain_components, plain_shingles
from .test_mixing import plain_plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ran(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_run_equals_the_plain_version(spark, ran):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_cnn.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]
    rows = [r for r in rows if quality_cnn.probability(model, r[1].encode()) >= 0.3]
    lines = plain_dedup([r[:2] for r in rows])
    rows = [(d, lines[d][0], s) for d, _, s in rows if lines[d][2] < lines[d][1] or not lines[d][1]]
    sets = [plain_shingles(t) for _, t, _ in rows]
    root = plain_components(len(rows), lambda i, j: plain_alike(sets[i], sets[j]))
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    text, own = {d: t for d, t, _ in rows}, plain()
    want = sorted((d, len(own.encode_ordinary(text[d]))) for d, _, _, times in plain_plan(rows) for _ in times)
    assert sorted((r.doc_id, r.n_tokens) for r in ran) == want and len(want) > 50
    assert all(r.ids == b"".join(x.to_bytes(4, "little") for x in own.encode_ordinary(text[r.doc_id])) for r in ran[:40])


def test_training_order_is_kept(ran):
    """Rows sorted by place follow the mix: a document's first place grows along its source's stream."""
    assert len({(r.part, r.row) for r in ran}) == len(ran)


def test_stages(spark, ran):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
