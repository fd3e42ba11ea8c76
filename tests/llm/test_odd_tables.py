"""Every query over a table of odd rows and over empty tables."""

import pytest

from citemill.llm import registry

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd_dir, odd, name):
    got = registry.queries()[name](spark, odd_dir).collect()
    if name in ("op1_toxicity", "op2_mixing", "op4_fingerprints", "op5_near_dedup", "op6_quality_rules", "op10_language_id"):
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    by_id = {r[0]: r for r in got}
    if name == "op1_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    if name == "op5_near_dedup":
        assert [by_id[i]["component_id"] for i in (1, 2, 3, 4, 5, 7, 8, 9)] == [1, 2, 3, 4, 4, 7, 7, 7]
        assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    if name == "op6_quality_rules":
        assert by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
        assert by_id[12]["n_dup_lines"] == 2 and by_id[6]["n_repeat_words"] == 30_000
    if name == "op7_chat_format":
        assert by_id[-1]["loss_chars"] == 34 and by_id[-1]["valid"] and by_id[1]["n_turns"] == 3 and not by_id[3]["valid"]
    if name == "op8_packing":
        ends = {}
        for r in got:
            assert 0 < r["length"] and r["offset"] + r["length"] <= 1024
            ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in ends.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
    if name == "op9_url_filters":
        assert (by_id[1]["host"], by_id[1]["path"], by_id[1]["verdict"]) == ("", "", "allow")
        assert by_id[7]["rule"] == "example.org/en/1" and by_id[8]["rule"] == "com/de/" and by_id[9]["rule"] == "org/" and by_id[10]["verdict"] == "block"
    if name == "op10_language_id":
        assert all(by_id[i]["lang_pred"] == "und" for i in (1, 2, 3)) and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty_dir, name):
    got = registry.queries()[name](spark, empty_dir).collect()
    assert len(got) == (1 if name == "op7_chat_format" else 0)
