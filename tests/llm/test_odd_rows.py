"""The stages of the pipeline on rows that are null, empty, repeated or absent, and on columns of odd names."""

import corpus_pipeline
from gridloom.llm import op2_decontaminate, op10_language


def test_stages_keep_odd_columns_and_rows(spark):
    texts = ["der Hund läuft über die Straße und der Mann sieht ihn", "the dog runs over the street and the man sees it at once in the morning", None, "", "12 34", "the dog runs over the street and the man sees it at once in the morning"]
    rows = [(i, t, "en", "s", 3, "x", "y") for i, t in enumerate(texts)] + [(None, texts[1], None, None, None, None, None), (1, texts[1], "en", "s", 3, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c0` string")
    known = op10_language.fit(spark.createDataFrame([(i, t * 40, lang) for i, (t, lang) in enumerate(((texts[0] + " ", "de"), (texts[1] + " ", "en")))], "doc_id long, text string, lang string"))
    kept = op10_language.accepted(docs, known)
    assert kept.columns == docs.columns and sorted(str(r.text) for r in kept.collect()) == sorted([texts[0], *[texts[1]] * 4])
    items = spark.createDataFrame([(1, "over the street and the man sees it at once in"), (None, None)], "item_id long, text string")
    clean = op2_decontaminate.without_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.text) for r in clean.collect()) == sorted(map(str, [texts[0], None, "", "12 34"]))
    for name, stage in corpus_pipeline.STAGES[1:4:2]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and {r.text for r in out.collect()} == set(texts), name


def test_stages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name


def test_batches_are_bounded_unless_set(spark):
    from gridloom.llm.common import BATCH_BYTES, bounded_batches

    key, texts = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 64, 1, 1).selectExpr("repeat('x', 1 << 20) AS text")
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "1234567")
        bounded_batches(spark)
        assert spark.conf.get(key) == "1234567"
        spark.conf.unset(key)
        bounded_batches(spark)
        sizes = [r.n for r in texts.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert sum(sizes) >= 64 << 20 and max(sizes) <= BATCH_BYTES + (2 << 20)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
