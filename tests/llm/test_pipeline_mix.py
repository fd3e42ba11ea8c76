"""The mix takes effect on what the pipeline returns."""

from pyspark.sql import functions as F

import corpus_pipeline
from citemill.llm import mixing, packing
from tests.llm.conftest import SF


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r["sequence_id"], []).append(r)
    assert sorted(out) == list(range(len(out)))
    for own in out.values():
        own.sort(key=lambda r: r["offset"])
        ends = [r["offset"] + r["length"] for r in own]
        assert ends[-1] <= packing.CAPACITY and [r["offset"] for r in own] == [0, *ends[:-1]]
    return [out[i] for i in range(len(out))]


def test_run_changes_without_the_mix(spark, monkeypatch):
    mixed = {(r["doc_id"], r["piece"]): r["sequence_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    monkeypatch.setattr(corpus_pipeline, "STAGES", [x for x in corpus_pipeline.STAGES if x[0] != "mix"])
    plain = {(r["doc_id"], r["piece"]): r["sequence_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert mixed.keys() == plain.keys() and mixed != plain


def test_packed_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_DOCS", 64, raising=False)
    counts = {"a": 1600, "b": 300, "c": 100}
    source = F.when(F.col("doc_id") < 1600, "a").when(F.col("doc_id") < 1900, "b").otherwise("c")
    text = F.expr("repeat('some words ', int(20 + doc_id * 7919 % 90 + if(doc_id >= 1900, 300, 0)))")  # a source of long documents
    docs = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("source", source).withColumn("text", text)
    corpus_pipeline.mixed(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    place = {r["doc_id"]: r["_position"] for r in mixing.mix(docs).collect()}
    order = sorted(place, key=place.get)
    of = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    got = sequences(corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).collect())
    seen, met = set(), 0
    for own in got:
        seen |= {r["doc_id"] for r in own}
        met += len(seen) % 64 == 0 and seen == set(order[: len(seen)])
    assert met >= 31  # after each whole window, exactly the documents of the mix up to there
    first = [of[i] for i in order[:512]]
    total = sum(n**0.5 for n in counts.values())
    assert abs(first.count("a") - 512 * 40 / total) < 64


def test_order_of_rows_that_are_not_from_files(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * 37 % 50)) for i in range(300)], "doc_id long, text string").repartition(5)
    order = [r["doc_id"] for r in docs.collect()]
    got = packing.with_places(docs).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["place"])] == order and {r["place"] for r in got} == set(range(300))
    rows = packing.pack_in_order(docs, window_docs=50).collect()
    assert len(rows) == 300
    first = [min(order.index(r["doc_id"]) for r in own) for own in sequences(rows)]
    assert first == sorted(first)
