"""Language ID: held-out accuracy and edge rows."""

from pyspark.sql import functions as F

from tierscope.llm import langid
from tierscope.llm.queries import op9_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op9_language_id(spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 150
    right = sum(r.lang_pred == r.lang for r in rows) / len(rows)
    assert right >= 0.97, right
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    schema = "score string, text string, lang string, doc_id bigint"
    texts = {"en": "the of and that with this from have", "de": "der die und das nicht ein ist mit",
             "fr": "le la les des est pas que dans", "ru": "это не что как все его так"}
    learn = [("s", f"{t} {t[k % 9:]}", lang, 1000 * n + k) for n, (lang, t) in enumerate(texts.items()) for k in range(30)]
    odd = [("s", None, "en", 9001), ("s", "", "en", 9002), ("s", "12 34 !?", "en", 9003), ("s", "the and of" * 9000, None, None),
           ("s", "der und die", None, 9005), ("s", "der und die", None, 9005)]
    docs = spark.createDataFrame(learn + odd, schema)
    model = langid.fit(docs)
    out = langid.predict(docs.where("doc_id > 9000 or doc_id is null"), model).collect()
    by = sorted((repr(r.doc_id), r.lang_pred) for r in out)
    assert by == [("9001", "und"), ("9002", "und"), ("9003", "und"), ("9005", "de"), ("9005", "de"), ("None", "en")]
    assert out[0].score == 0.0 and len(out[0]) == 5
    empty = langid.fit(docs.where("false"))
    assert langid.predict(docs.limit(1), empty).first().lang_pred == "und"
    one = langid.fit(docs.where("lang = 'en'"))
    assert langid.predict(docs.limit(1), one).first().lang_pred == "en"
    assert langid.predict(docs.where("false"), model).count() == 0


def test_never_learns_from_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    swapped = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(swapped)
    assert a.languages == b.languages and (a.family_w == b.family_w).all()


def test_every_language_is_learned_and_repeats_count_once(spark):
    words = ["".join(chr(97 + (7 * k + 3 * i * i + i) % 26) for i in range(9)) for k in range(40)]
    rows = [(1000 * k + i, f"{w} {w[::-1]} {w}", f"l{k}") for k, w in enumerate(words) for i in range(6)]
    rows += [(7, f"{words[0]} {words[0]}", "l0")] * 5000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, per_language=4, max_rows=100)
    assert sum(len(v) for v in model.languages.values()) == 40
    same = spark.createDataFrame([(4, "le la les des", "fr")] * 3000, "doc_id bigint, text string, lang string")
    assert langid.fit(same, 10, 10).languages


def test_few_rows_of_each_language_are_enough_to_learn_it(spark):
    docs = spark.createDataFrame([(i, "der die und das", "de") for i in range(9)] + [(i, "the of and that", "en") for i in range(100, 104)],
                                 "doc_id bigint, text string, lang string")
    assert sum(len(v) for v in langid.fit(docs).languages.values()) == 2
