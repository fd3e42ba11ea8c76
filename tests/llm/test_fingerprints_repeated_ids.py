"""Rows that share an id, a hot one and null among them, against a plain restatement."""

import hashlib
import random

import pytest

from citemill.llm import common, fingerprints


@pytest.mark.parametrize("group", [1000, 3])
def test_rows_that_repeat_an_id_have_the_same_next_document(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(common, "GROUP", group)
    rng = random.Random(3)
    ids = [None] * 20 + [7] * 40 + list(range(30)) + [29, 29]
    rows = [(i, rng.choice([None, "", "x"]) if k % 9 == 0 else " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 40)))) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    least = {}
    for i, t in rows:
        least[i] = min(least.get(i, t or ""), t or "")
    order = sorted(least, key=lambda i: -1 if i is None else i)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    want = []
    for i, t in rows:
        text, half = t or "", len(t or "") // 2
        edited = text[: len(text) - half] + least[after[i]][:half]
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprints.op4_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    same = {}
    assert all(same.setdefault(r["n_chars"] and r["fingerprint"], r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_next"] <= 1 for r in got)
