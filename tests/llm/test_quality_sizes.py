"""The quality verdict of clean documents does not hang on how many trusted ones there are."""

import random

import pytest

from tillbook.llm import quality

COMMON = [f"w{i}" for i in range(3000)]
JUNK = [f"buy{i}" for i in range(3000)]
ODDS = [1 / (i + 1) for i in range(3000)]


@pytest.fixture(scope="module")
def docs(spark):
    """3,000 clean rows, 100 clean ones that are never trusted, 900 of other words."""
    random.seed(11)
    texts = [" ".join(random.choices(COMMON, ODDS, k=80)) for _ in range(3100)]
    texts += [" ".join(random.choices(JUNK, ODDS, k=80)) for _ in range(900)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


@pytest.mark.parametrize("trusted", [30, 300, 3000])
def test_held_out_clean_rows_are_kept(spark, docs, trusted):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(trusted)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels, quality.ANY_SIZE).collect()}
    assert sum(got[i] for i in range(3000, 3100)) == 100
    if trusted == 3000:
        assert not any(got[i] for i in range(3100, 4000))


def test_op1_and_the_pipeline_use_these_rules(spark):
    import corpus_pipeline
    from tillbook.llm import registry

    folder = "/root/testdata/sf0.001"
    docs, labels = (registry.table(spark, folder, t) for t in ("documents", "labels"))
    want = {r.doc_id for r in quality.quality_rules(docs, labels, quality.ANY_SIZE).collect() if r.kept}
    assert {r.doc_id for r in registry.op1(spark, folder).collect() if r.kept} == want
    assert {r.doc_id for r in corpus_pipeline.good(spark, docs, folder).collect()} == want
    # Of 105 unlabelled documents of 50 words or more, even smoothing rejects 95.
    known = {r.doc_id for r in labels.collect()}
    long = {r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 50} - known
    assert len(long - want) < 0.3 * len(long)
