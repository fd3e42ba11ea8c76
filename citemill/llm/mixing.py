"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hashed order, are cut into blocks. One block is placed in each slot. With integer weights a that sum to D,
block k of a source is released at slot floor(k D / a) and due by slot ceil((k + 1) D / a); taking the released block with
the earliest deadline meets every deadline, so after any number of slots a source is less than one block away from its
weight's share. The weights are the targets themselves, as fractions over a common denominator, so the share is the target's. Such a schedule
hardly ever repeats: the driver works out two numbers for each block (not document), and executors look up their blocks'.

Every document is placed once. When a source runs out, a new phase starts: the other sources go on, their weights scaled
up to sum to one again, and the bound holds within each phase.

Defined cases: a null source is a source of its own. Weights that are missing, null or not above zero count as 1 of ``RESOLUTION``, or as the
smallest given weight if that is less, so their documents are still placed. Where a ``resolution`` is given, weights are rounded to one part in so many, 1 at least. Repeated rows are placed each. Ties between
deadlines go to the larger weight, then to the smaller source name. An empty table gives no rows. In ``mixed_documents`` the input's
columns pass through, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.common import table

BLOCK_DOCS = 64
#: Blocks grow with the corpus so that the driver plans about this many, and one more for each source, whatever its size.
MAX_BLOCKS = 1_000_000
#: A source without a weight gets one part in this many.
RESOLUTION = 1000
#: Documents of a source are ranked in this many hash ranges, so a hot source is ranked by many tasks.
RANGES = 4096
#: A plan of up to this many numbers is broadcast; a larger one is joined by source and chunk of blocks.
MAX_BROADCAST_NUMBERS = 2_000_000
#: Blocks in a row of the plan.
CHUNK = 1024

PLAN = "_of string, _part long, _phases array<int>, _slots array<long>"


def exact_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Integer weights in exactly the proportions that are given."""
    told = {s: Fraction(w) for s, w in weights.items() if w and w > 0}
    least = min([sum(told.values()) / RESOLUTION, *told.values()]) if told else Fraction(1)
    told = {s: told.get(s, least) for s in weights}
    scale = math.lcm(*(w.denominator for w in told.values()))
    return {s: int(w * scale) for s, w in told.items()}


def whole_weights(weights: Mapping[str | None, float], resolution: int) -> dict[str | None, int]:
    """Integer weights of at least 1 that sum to about the resolution."""
    total = sum(w for w in weights.values() if w and w > 0) or 1.0
    return {s: max(1, round(resolution * (w if w and w > 0 else 0) / total)) for s, w in weights.items()}


def slots(weights: Mapping[str | None, int]) -> Iterator[str | None]:
    """The source of each slot, without end, by earliest deadline first among released blocks."""
    d = sum(weights.values())
    by_tie = sorted(weights, key=lambda s: (-weights[s], s is not None, s or ""))
    own = [weights[s] for s in by_tie]
    ready = [(-(-d // w), i, 0) for i, w in enumerate(own)]
    future: list[tuple[int, int, int]] = []
    heapq.heapify(ready)
    slot = 0
    while True:
        while future and future[0][0] <= slot:
            _, i, k = heapq.heappop(future)
            heapq.heappush(ready, (-(-(k + 1) * d // own[i]), i, k))
        _, i, k = heapq.heappop(ready)
        yield by_tie[i]
        heapq.heappush(future, ((k + 1) * d // own[i], i, k + 1))
        slot += 1


def period(weights: Mapping[str | None, int]) -> dict[str | None, list[int]]:
    """The slots of each source's blocks up to the sum of the weights, after which the schedule repeats."""
    places: dict[str | None, list[int]] = {s: [] for s in weights}
    for slot, s in enumerate(islice(slots(weights), sum(weights.values()))):
        places[s].append(slot)
    return places


def plan(weights: Mapping[str | None, int], blocks: Mapping[str | None, int]) -> list[tuple]:
    """Rows of PLAN: for each source, CHUNK blocks at a time, the phase and the slot of each block."""
    left = {s: n for s, n in blocks.items() if n > 0}
    phases: dict[str | None, list[int]] = {s: [] for s in left}
    places: dict[str | None, list[int]] = {s: [] for s in left}
    slot = phase = 0
    while left:
        for s in slots({s: weights[s] for s in left}):
            phases[s].append(phase)
            places[s].append(slot)
            slot += 1
            left[s] -= 1
            if not left[s]:
                del left[s]
                break
        phase += 1
    return [(s, i // CHUNK, phases[s][i : i + CHUNK], own[i : i + CHUNK]) for s, own in places.items() for i in range(0, len(own), CHUNK)]


def ranked(docs: DataFrame, order: Column, source_col: str = "source") -> DataFrame:
    """Adds _rank, the place of each row among its source's rows in hashed order, without bringing a source into one task."""
    d = docs.withColumn("_source", F.col(source_col).cast("string")).withColumn("_h", order).withColumn("_range", F.shiftrightunsigned("_h", 64 - (RANGES - 1).bit_length()))
    counts = d.groupBy("_source", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnsRenamed({"_source": "_s", "_range": "_r"})
    own = Window.partitionBy("_source", "_range").orderBy("_h", *[c for c in ("doc_id",) if c in docs.columns])
    d = d.withColumn("_i", F.row_number().over(own) - 1)
    return d.join(counts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).withColumn("_rank", F.col("_before") + F.col("_i")).drop("_s", "_r", "_n", "_before", "_i", "_h", "_range")


def tempered(counts: Mapping[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Target weights in proportion to a power of the sources' sizes."""
    return {s: n**power for s, n in counts.items()}


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source_col: str = "source", block_docs: int | None = None, resolution: int | None = None) -> DataFrame:
    """The rows with _source, _phase, _block, _slot and _position (the place in the mix: slot times block size plus place in the block). block_docs: documents in a block; unless given, BLOCK_DOCS, or more where that would make over MAX_BLOCKS blocks."""
    spark = docs.sparkSession
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n")).collect()}  # a row for each source
    block_docs = block_docs or max(BLOCK_DOCS, -(-sum(counts.values()) // MAX_BLOCKS))
    wanted = tempered(counts) if weights is None else {s: weights.get(s, 0) for s in counts}
    whole = exact_weights(wanted) if resolution is None else whole_weights(wanted, resolution)
    rows = plan(whole, {s: -(-n // block_docs) for s, n in counts.items()})
    d = ranked(docs, F.xxhash64("doc_id"), source_col).withColumn("_block", F.floor(F.col("_rank") / block_docs))
    told = spark.createDataFrame(rows, PLAN)
    if sum(2 * len(r[-1]) + 2 for r in rows) <= MAX_BROADCAST_NUMBERS:
        told = F.broadcast(told)
    d = d.join(told, F.col("_source").eqNullSafe(F.col("_of")) & (F.floor(F.col("_block") / CHUNK) == F.col("_part")))
    at = (F.col("_block") % CHUNK).cast("int")
    d = d.withColumn("_phase", F.get("_phases", at)).withColumn("_slot", F.get("_slots", at))
    return d.withColumn("_position", F.col("_slot") * block_docs + F.col("_rank") % block_docs).drop("_of", "_part", "_phases", "_slots", "_rank")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents in the order of the mix, with the columns that came in."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of the input clashes with a helper
    place = dict(zip(docs.columns, own, strict=True))
    d = docs.toDF(*own).withColumn("doc_id", F.col(place["doc_id"])).withColumn("source", F.col(place[how.pop("source_col", "source")]))
    return mix(d, **how).repartitionByRange("_position").sortWithinPartitions("_position").select(*own).toDF(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", F.col("_phase").alias("phase"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))
