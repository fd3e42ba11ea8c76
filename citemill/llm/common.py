"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import multiprocessing
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
SPACE_CHARS = " \t\n\u000b\f\r"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a group that one task takes; a larger group is dealt to several.
GROUP = 1000
#: Up to so many larger groups are broadcast by key and size.
MAX_HOT = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own on a local master; on a cluster that's an error, as every executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_citemill_shared", None) or tempfile.mkdtemp(prefix="citemill-shared-")
        spark._citemill_shared = found
    return found


def materialized(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: its lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/citemill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _apart(work: Callable[[], Any]) -> bytes:
    """The pickled result of work, done by a process of its own whose memory goes when it ends, as a worker that is used again would keep it."""
    fork = multiprocessing.get_context("fork")
    out, into = fork.Pipe(False)
    process = fork.Process(target=lambda: into.send_bytes(pickle.dumps(work())))
    process.start()
    into.close()
    try:
        return out.recv_bytes()
    except EOFError:
        raise RuntimeError("learning ended without a result; its error is in the executor's log") from None
    finally:
        process.join()


def learned(sample: DataFrame, learn: Callable[[list[tuple]], Any]) -> Any:
    """What learn makes of the rows of a bounded sample, in any order: worked out by one task of an executor, so that the driver holds neither rows nor what learning needs beside them."""
    def run(batches):
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([_apart(lambda: learn(rows))], pa.binary())], names=["learned"])

    found = sample.coalesce(1).mapInArrow(run, "learned binary").collect()
    return pickle.loads(found[0]["learned"]) if found else learn([])  # an empty plan may have no task


def dealt(rows: DataFrame, groups: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with groups (key, size, …) on the key, where a large group's rows are dealt to as many salts as they are GROUPs, and its one row is copied to each."""
    salted = groups.withColumn("_salts", F.ceil(F.col("size") / GROUP).cast("int"))
    n_hot = groups.where(F.col("size") > GROUP).count()
    if not n_hot:
        return rows.join(groups, key)
    hot = salted.where("_salts > 1").select(F.col(key).alias("_key"), "_salts")
    rows = rows.join(F.broadcast(hot) if n_hot <= MAX_HOT else hot, F.col(key) == F.col("_key"), "left")
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"), F.lit(0))).drop("_key", "_salts")
    copies = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return rows.join(copies, [key, "_salt"]).drop("_salt")


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
