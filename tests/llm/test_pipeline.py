"""The pipeline's stages: their columns, their decisions, and edge rows."""

import corpus_pipeline as p
from tierscope.llm.common import DOC_COLUMNS, load

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def test_stages_compose(spark):
    docs = load(spark, SF, "documents").cache()
    now, left = docs, []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == DOC_COLUMNS and out.dtypes == docs.dtypes, name
        now = spark.createDataFrame(out.collect(), out.schema)
        left.append(now.count())
        assert now.where("n_chars <> length(text)").count() <= docs.where("n_chars <> length(text)").count()
    assert 0.8 * docs.count() < left[-1] <= left[0] <= docs.count()
    kept = {r.doc_id: r.text for r in now.collect()}
    final = {r.doc_id: r for r in p.run(spark, SF).collect()}
    assert set(final) == set(kept)
    import hashlib
    assert all(final[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items())


def test_edge_rows(spark):
    rows = [(1, None, "en", "s", None, "x"), (2, "", "en", "s", 0, "x"), (3, "some words that stay here", "en", "s", 25, "x"),
            (3, "some words that stay here", "en", "s", 25, "x"), (None, "words without an id stay", None, None, 24, "x"),
            (4, "a word " * 20_000, "en", "s", 140_000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len(p.STAGES) == 5
    for data in (docs, docs.where("false")):
        for _, stage in p.STAGES:
            out = stage(spark, data, SF)
            assert out.count() <= data.count()
    kept = p.near_duplicates(spark, docs, SF).collect()
    assert sorted(repr(r.doc_id) for r in kept) == ["1", "2", "3", "4", "None"]


def test_no_labelled_row_keeps_texts(spark):
    rows = [(i, t, None, "s", 1, "x") for i, t in enumerate(["words stay", "слова", "12 34", "", None])]
    assert {r.doc_id for r in p.language(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()} == {0, 1}
