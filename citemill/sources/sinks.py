"""Outputs: tables as CSV, documents as JSON, reports as text, folders as tar.gz."""

from __future__ import annotations

import json
import os
import tarfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; single: one file, for small summaries only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def json_document(df: DataFrame) -> str:
    """A one-row result as an indented document."""
    return json.dumps(json.loads(df.select(F.to_json(F.struct("*"))).first()[0]), indent=2, ensure_ascii=False)


def status_report(summary: DataFrame, by_status: DataFrame) -> str:
    """What a status run has to say; a line for each status."""
    s = summary.first()
    lines = [f"Repositories: {s['total_repos']:,}", f"Success rate: {s['success_rate']:.1f}%", f"Scripts found: {s['total_scripts']:,}", f"Scripts per success: {s['avg_scripts']:.1f}", "By status:"]
    for r in by_status.orderBy(F.col("count").desc(), "status").limit(100).collect():
        lines.append(f"  {r['status']}: {r['count']:,} ({100 * r['count'] / max(1, s['total_repos']):.1f}%)")
    return "\n".join(lines)


def journal_report(rollup: DataFrame, count: str, n: int = 15) -> str:
    rows = rollup.orderBy(F.col(count).desc(), "journal").limit(n).collect()
    return "\n".join(f"{i:2}. {r['journal']}: {r[count]:,}" for i, r in enumerate(rows, 1))


def pack_folder(folder: str, target: str) -> None:
    with tarfile.open(target, "w:gz") as t:
        t.add(folder, arcname=os.path.basename(folder.rstrip("/")))


def unpack_folder(archive: str, target: str) -> None:
    with tarfile.open(archive, "r:gz") as t:
        t.extractall(target, filter="data")
