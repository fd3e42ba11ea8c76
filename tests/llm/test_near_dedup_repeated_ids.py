"""Rows that repeat a doc_id with different texts are one document with the links of all its texts."""

from citemill.llm import near_dedup
from tests.llm import brute


def text(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


def test_links_of_the_larger_text(spark):
    rows = [
        (1, text("a")), (1, text("b")), (7, text("b") + " more"),  # 7 is near to the larger text of 1
        (2, text("c")), (2, text("d")), (2, text("e")), (5, text("c") + " x"), (6, text("e") + " y"), (9, text("e") + " y z"),
        (3, text("f")), (4, text("g")), (4, text("f") + " w"), (8, text("h")), (8, text("h")),
        (10, text("i")), (10, text("j")), (11, text("j")), (11, text("k")), (12, text("k") + " v"),
    ]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    want = brute.near_components(rows)
    assert want[7] == 1 and want[9] == want[5] == 2 and want[12] == 10
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((i, len(brute.shingles(t))) for i, t in rows)
