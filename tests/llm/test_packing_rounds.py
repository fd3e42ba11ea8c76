"""The sweep by levels against taking places one by one, and whole packings against row-by-row best fit."""

import random
from bisect import bisect_left, insort

from citemill.llm import packing


def best_fit(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        left = gaps.pop(at) if at < len(gaps) else capacity
        opened += left == capacity
        if left > n:
            insort(gaps, left - n)
    return opened


def test_sweep_takes_the_smallest_free_place_longest_first(spark):
    rng = random.Random(3)
    for n, m in ((40, 30), (30, 40), (5, 60), (60, 5), (1, 1)):
        lengths, sizes = [rng.randrange(1, 25) for _ in range(n)], [rng.randrange(1, 25) for _ in range(m)]
        count = lambda some: {x: some.count(x) for x in set(some)}
        some = packing.ranked(spark.createDataFrame(list(enumerate(lengths)), "pid long, length long"), "length", "pid", count(lengths))
        places = packing.ranked(spark.createDataFrame([(i, i, s) for i, s in enumerate(sizes)], "seq long, place long, size long"), "size", "place", count(sizes))
        got = packing.matched(some, places, count(lengths), count(sizes)).collect()
        free, want = sorted(sizes), []
        for x in sorted(lengths, reverse=True):
            at = bisect_left(free, x)
            if at < len(free):
                want.append((x, free.pop(at)))
        assert len({r["pid"] for r in got}) == len({r["seq"] for r in got}) == len(got)
        assert sorted((r["length"], sizes[r["seq"]]) for r in got) == sorted(want) and all(lengths[r["pid"]] == r["length"] for r in got)


def test_ranks_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = spark.range(200).selectExpr("id AS pid", "id % 3 AS length")
    got = packing.ranked(rows, "length", "pid", {0: 67, 1: 67, 2: 66}).collect()
    for k in range(3):
        assert sorted(r["rank"] for r in got if r["length"] == k) == list(range(67 if k < 2 else 66))


def test_as_few_sequences_as_row_by_row_best_fit(spark):
    rng = random.Random(9)
    for capacity, draw in ((64, lambda: rng.randrange(1, 65)), (1024, lambda: min(1024, int(rng.lognormvariate(5.5, 1)) + 1)), (50, lambda: 17), (8, lambda: 1), (1024, lambda: 1024)):
        lengths = [draw() for _ in range(700)]
        rows = packing.placed(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), capacity).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(700)) and all(lengths[r["doc_id"]] == r["length"] for r in rows)
        by_seq = {}
        for r in rows:
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in by_seq.values():
            own.sort()
            ends = [o + n for o, n in own]
            assert [o for o, _ in own] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert len(by_seq) <= best_fit(lengths, capacity) + 1
