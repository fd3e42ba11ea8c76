"""Collection status: summaries, retries, and which repositories are still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

# Which statuses are worth another try, and which come with error details.
RETRYABLE = ("forbidden", "error", "not_found")
DETAILED = (*RETRYABLE, "connection_error")


def summary(statuses: DataFrame, scripts: str = "script_count") -> DataFrame:
    """One row: total_repos, successes, success_rate in percent, total_scripts and avg_scripts over successes; zeros for no rows."""
    ok = F.col("status") == "success"
    out = statuses.agg(F.count("*").alias("total_repos"), F.count_if(ok).alias("successes"), F.coalesce(F.sum(F.when(ok, F.col(scripts))), F.lit(0)).alias("total_scripts"))
    return out.select("total_repos", "successes", F.coalesce(F.try_divide(F.col("successes") * 100, F.col("total_repos")), F.lit(0.0)).alias("success_rate"), "total_scripts", F.coalesce(F.try_divide("total_scripts", "successes"), F.lit(0.0)).alias("avg_scripts"))


def by_status(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("count"))


def retryable(statuses: DataFrame, some: tuple[str, ...] = RETRYABLE) -> DataFrame:
    return statuses.where(F.col("status").isin(*some))


def error_details(statuses: DataFrame, compat: bool = False) -> DataFrame:
    """(status, repo_id, doi, error, timestamp) of rows with errors; details is a map. compat: the doi key alone, and connection errors left out."""
    d = F.col("details")
    doi = F.try_element_at(d, F.lit("doi")) if compat else F.coalesce(F.try_element_at(d, F.lit("doi")), F.try_element_at(d, F.lit("identifier")))
    return statuses.where(F.col("status").isin(*(RETRYABLE if compat else DETAILED))).select("status", "repo_id", doi.alias("doi"), F.coalesce(F.try_element_at(d, F.lit("error")), F.col("status")).alias("error"), "timestamp")


def latest(statuses: DataFrame, key: str = "repo_id", order: str = "seq") -> DataFrame:
    """The last status of each repository."""
    return statuses.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def remaining(repos: DataFrame, done: DataFrame, key: str = "repo_id", force: bool = False) -> DataFrame:
    """Repositories that have no status yet; all of them if forced."""
    return repos if force else repos.join(done.select(key), key, "left_anti")


def final_status(status, script_count):
    """A success without scripts is told apart."""
    return F.when((status == "success") & (F.coalesce(script_count, F.lit(0)) == 0), "no_scripts").otherwise(status)


def download_status(http_code, content_type, size):
    """What a reply to a download request means: refused, missing, not an archive, too small, or fine."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(http_code == 403, "forbidden").when(http_code == 404, "not_found").when(http_code != 200, "error")
        .when(~(F.contains(kind, F.lit("zip")) | F.contains(kind, F.lit("octet-stream"))), "error").when(F.coalesce(size, F.lit(0)) < 1000, "download_error").otherwise("success")
    )


def run_counters(results: DataFrame) -> DataFrame:
    """One row over results (box_id, downloaded, extracted, file_count, script_count): requested, downloads, extractions, files, scripts."""
    return results.agg(
        F.count("*").alias("requested"), F.count_if("downloaded").alias("downloads"), F.count_if("extracted").alias("extractions"),
        F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"), F.coalesce(F.sum("script_count"), F.lit(0)).alias("scripts"),
    )


def run_errors(results: DataFrame, key: str = "box_id", error: str = "error") -> DataFrame:
    """(key, error) of results that failed with an error; how many there are is the run's error count."""
    return results.where(F.col(error).isNotNull()).select(key, F.col(error).alias("error"))


def progress(results: DataFrame, total: int | None = None) -> DataFrame:
    """One row over archive results (error, scripts, size): processed, successful, failed, total_scripts, total_bytes, and percent of the total, which is null where that isn't known."""
    share = F.count("*") * 100 / F.lit(total) if total else F.lit(None).cast("double")
    return results.agg(*_progress(), share.cast("double").alias("percent"))


def _progress() -> list:
    ok = F.col("error").isNull()
    return [
        F.count("*").alias("processed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("scripts").cast("long"))), F.lit(0)).alias("total_scripts"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)).alias("total_bytes"),
    ]


def observed(results: DataFrame, name: str = "archives") -> tuple[DataFrame, Observation]:
    """The same rows, and their progress counters as a side result of whatever writes them, without a second pass."""
    seen = Observation(name)
    return results.observe(seen, *_progress()), seen


def progress_line(operation: str, row: dict) -> str:
    """What a run has to say at its end."""
    parts = [f"Completed {operation}", f"{row['successful']}/{row['processed']} successful"]
    parts += [f"{row['failed']} failed"] * (row["failed"] > 0) + [f"{row['total_scripts']} scripts"] * (row["total_scripts"] > 0) + [f"{row['total_bytes'] / 2**20:.1f} MB"] * (row["total_bytes"] > 0)
    return " - ".join(parts)


def is_stale(modified, hours: int = 24):
    """Whether the oldest of some files is older than that; an aggregate."""
    return F.min(modified) < F.current_timestamp() - F.make_dt_interval(hours=F.lit(hours))


def needs_rebuild(source_modified, target_modified):
    """A target that is missing or older than its source."""
    return target_modified.isNull() | (source_modified > target_modified)
