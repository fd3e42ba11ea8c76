"""Files: listings, scripts, tables, status markers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.functions import keys

SEEDS = "id INT, name STRING, datavese_link STRING, dataverse_id STRING"
JOURNALS = "note STRING, dataverse_id STRING, datavese_link STRING, repo STRING, rank INT, publication STRING, impact_factor DOUBLE, total_citations BIGINT"
STATUS = "status STRING, timestamp STRING, details MAP<STRING, STRING>"


def decoded(content):
    """UTF-8, or Latin-1 for a file that isn't; line ends as \\n."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def binary_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """All files below a folder; none where there is no such folder."""
    if not exists(spark, folder):
        return spark.createDataFrame([], FILES)
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, **options).load(folder)


def free_bytes(spark: SparkSession, folder: str) -> int:
    """Room that is left where a folder is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return int(place.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus(place).getRemaining())


def has_room(spark: SparkSession, folder: str, least_gb: float = 5) -> bool:
    return free_bytes(spark, folder) >= least_gb * 1024**3


def file_list(spark: SparkSession, folder: str, kind: str | None = "analysis", case_sensitive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of all files below a folder, sorted by path; contents aren't read."""
    rows = binary_files(spark, folder).select("path", "modificationTime", "length")
    return (rows if kind is None else rows.where(keys.has_suffix(F.col("path"), kind, case_sensitive))).orderBy("path")


def scripts(spark: SparkSession, folder: str, kind: str = "analysis", case_sensitive: bool = True) -> DataFrame:
    """(path, text) of all scripts below a folder."""
    rows = binary_files(spark, folder)
    return rows.where(keys.has_suffix(F.col("path"), kind, case_sensitive)).select("path", decoded(F.col("content")).alias("text"))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all ZIP archives below a folder."""
    return binary_files(spark, folder, pathGlobFilter="*.zip").select("path", "content")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Distinct dataverse ids of a seed list; without that column it is an error."""
    rows = spark.read.option("header", True).csv(path)
    if "dataverse_id" not in rows.columns:
        raise ValueError("the seed list has no column dataverse_id")
    return rows.select("dataverse_id").where(F.col("dataverse_id").isNotNull()).distinct()


def journal_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNALS).option("header", True).option("enforceSchema", True).csv(path)


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def status_files(spark: SparkSession, folder: str) -> DataFrame:
    """(repo_id, status, timestamp, details) of the .status markers of all repositories in a folder; a marker that can't be read is left out.

    Spark's readers pass over names that start with a dot, so the markers' names are listed on the driver and their contents are read by tasks.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{{*,*/*}}/.status")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    paths = spark.createDataFrame([(str(f.getPath()),) for f in found], "path string")

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            texts = []
            for path in batch.column(0).to_pylist():
                try:
                    system, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                    with system.open_input_file(name) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    rows = paths.mapInArrow(read, "path string, text string")
    parsed = rows.select(F.regexp_extract("path", r"([^/]+)/\.status$", 1).alias("repo_id"), F.from_json("text", STATUS).alias("s"))
    return parsed.where("s.status IS NOT NULL").select("repo_id", "s.*")
