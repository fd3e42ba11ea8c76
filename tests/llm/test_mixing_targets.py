"""The mix is held against the target weights themselves, not against rounded ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill.llm import mixing


@pytest.mark.parametrize(("hot", "small", "each"), [(9_000, 19, 950), (3_000, 1_500, 4)])
def test_a_source_stays_within_a_block_of_its_target(spark, hot, small, each):
    source = F.when(F.col("doc_id") < hot, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") - hot) % small))
    docs = spark.range(hot + small * each).withColumnRenamed("id", "doc_id").withColumn("source", source)
    got = mixing.mix(docs, block_docs=1).select("source", "_phase", "_slot").toPandas()
    assert sorted(got["_slot"]) == list(range(hot + small * each))
    first = got[got["_phase"] == 0]
    n = len(first)
    assert sorted(first["_slot"]) == list(range(n)) and n > 1000
    total = hot**0.5 + small * each**0.5
    for s, own in first.groupby("source")["_slot"]:
        have = np.zeros(n + 1)
        have[own.to_numpy() + 1] = 1
        target = (hot if s == "hot" else each) ** 0.5 / total
        assert np.abs(np.cumsum(have) - target * np.arange(n + 1)).max() < 1 + 1e-6


def test_larger_plans_are_joined(spark, monkeypatch):
    docs = spark.range(3_000).withColumnRenamed("id", "doc_id").withColumn("source", F.when(F.col("doc_id") % 10 > 0, "a"))
    want = {r["doc_id"]: (r["_phase"], r["_position"]) for r in mixing.mix(docs, {"a": 2.5}, block_docs=2).collect()}
    monkeypatch.setattr(mixing, "MAX_BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(mixing, "CHUNK", 7)
    assert {r["doc_id"]: (r["_phase"], r["_position"]) for r in mixing.mix(docs, {"a": 2.5}, block_docs=2).collect()} == want


def test_blocks_grow_so_that_the_plan_is_bounded(spark, monkeypatch):
    docs = spark.range(3_000).withColumnRenamed("id", "doc_id").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "a"))
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 10)
    got = mixing.mix(docs).select("source", "_block", "_slot", "_position").toPandas()
    assert got["_slot"].nunique() == 4 + 7 and len(got) == 3_000 and got["_position"].is_unique
    assert got.groupby("_slot").size().max() == 300
