"""What the pipeline's language stage keeps."""

import random

import corpus_pipeline
from citemill.llm import language_id
from tests.llm.conftest import SF


def test_keeps_lettered_documents_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123 ...", None), (3, None, None), (4, "ça va", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.by_language(spark, docs, SF).collect()) == [1, 4]


def test_rejects_documents_between_the_languages(spark):
    rng = random.Random(4)
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(i, say("abcde", 40) if i % 2 else say("vwxyz", 40), "x" if i % 2 else "y") for i in range(200)]
    rows += [(1000 + i, say("abcde", 200) + " " + say("vwxyz", 200), None) for i in range(5)] + [(2000, say("abcde", 200), None)]
    got = {r["doc_id"] for r in corpus_pipeline.by_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF).collect()}
    assert got == {*range(200), 2000}


def test_one_language_keeps_all(spark):
    docs = spark.createDataFrame([(i, f"words of {i}", "en") for i in range(30)], "doc_id long, text string, lang string")
    assert corpus_pipeline.by_language(spark, docs, SF).count() == 30


def test_the_rarest_languages_are_left_out_beyond_the_bound(spark):
    rows = [(i, f"{'die und der ' if i % 3 else 'the and of '}{i}", "de" if i % 3 else "en") for i in range(60)] + [(100, "el y los", "es"), (101, "el y los", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs, max_langs=2, steps=2).langs == ["de", "en"] and set(language_id.fit(docs, steps=2).langs) >= {"de", "en"}
