import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SF


def test_stages(spark, docs, tmp_path):
    d, names = docs, docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, d, SF).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        assert d.columns == names
        seen.append(d.count())
    assert seen[0] >= seen[1] >= seen[2] > seen[3] == seen[4] > 0.5 * seen[0]
    left = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert len(set(brute.near_components(left).values())) == len(left)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in left}


def test_odd_and_empty(spark, odd_dir, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    corpus_pipeline.run(spark, odd_dir).count()
