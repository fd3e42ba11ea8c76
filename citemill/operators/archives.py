"""Script members of ZIP archives, as a function from bytes to rows."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.keys import EXTENSIONS

SCHEMA = "archive string, member string, content binary, depth int, error string"


def members(data: bytes, extensions: tuple[str, ...], case_sensitive: bool, max_depth: int, depth: int = 0, within: str = ""):
    """(member, content, depth) of all scripts, ZIPs inside being opened down to max_depth. Raises BadZipFile for what is no archive."""
    wanted = extensions if case_sensitive else tuple(e.lower() for e in extensions)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            name = info.filename if case_sensitive else info.filename.lower()
            if name.endswith(wanted):
                yield within + info.filename, z.read(info), depth
            elif info.filename.lower().endswith(".zip") and depth < max_depth:
                try:
                    yield from list(members(z.read(info), extensions, case_sensitive, max_depth, depth + 1, f"{within}{info.filename}!/"))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
                    continue


def extract(archives: DataFrame, extensions: tuple[str, ...] = EXTENSIONS["archives"], case_sensitive: bool = False, max_depth: int = 3) -> DataFrame:
    """Rows of SCHEMA from (path, content): one for each script, or one with an error for an archive that can't be read, or with no_scripts for one without."""
    names, kinds = ["archive", "member", "content", "depth", "error"], [pa.string(), pa.string(), pa.binary(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [(path, m, c, d, None) for m, c, d in members(data.as_py() or b"", extensions, case_sensitive, max_depth)] or [(path, None, None, None, "no_scripts")]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as error:
                    rows = [(path, None, None, None, f"extraction_failed: {error}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return archives.select("path", "content").mapInArrow(run, SCHEMA)


OUTCOME = "archive string, files int, scripts int, tries int, error string"


def outcomes(archives: DataFrame, extensions: tuple[str, ...] = EXTENSIONS["archives"], case_sensitive: bool = False, max_depth: int = 3, retries: int = 2) -> DataFrame:
    """Rows of OUTCOME from (path, content): how many members and scripts each archive has, and after how many tries; the last error of one that can't be read in retries + 1."""
    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body, error, found = data.as_py() or b"", None, (0, 0)
                for tries in range(1, retries + 2):
                    try:
                        with zipfile.ZipFile(io.BytesIO(body)) as z:
                            n = sum(not i.is_dir() for i in z.infolist())
                        found, error = (n, sum(1 for _ in members(body, extensions, case_sensitive, max_depth))), None
                        break
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError) as problem:
                        error = str(problem)
                rows.append((path, *found, tries, error))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["archive", "files", "scripts", "tries", "error"])

    return archives.select("path", "content").mapInArrow(run, OUTCOME)


def next_step(found: DataFrame, keep: bool = False, safe: bool = True, preserve: bool = True) -> DataFrame:
    """Adds status and step to OUTCOME rows. An archive that was read is deleted, unless archives are kept or, with safe deletion, nothing came out of it; one that wasn't goes to quarantine or, without preserving, is deleted."""
    read = F.col("error").isNull()
    step = F.when(~read, "quarantine" if preserve else "delete").when(F.lit(safe) & (F.col("files") == 0), "keep").otherwise("keep" if keep else "delete")
    status = F.when(~read, "extraction_failed").when(F.col("scripts") == 0, "no_scripts").otherwise("success")
    return found.withColumn("status", status).withColumn("step", step)


def recovered(quarantine: DataFrame, **how) -> DataFrame:
    """Archives (path, content) in quarantine that can be read now, as OUTCOME rows."""
    return outcomes(quarantine, retries=0, **how).where("error IS NULL")


def script_inventory(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS["archives"], case_sensitive: bool = False, max_depth: int = 3) -> DataFrame:
    """(path, script) over the files (path, content) of folders: scripts that lie there (script null), and those in ZIPs."""
    name = F.col("path") if case_sensitive else F.lower("path")
    wanted = F.exists(F.array(*(F.lit(e if case_sensitive else e.lower()) for e in extensions)), lambda e: F.endswith(name, e))
    inside = extract(files.where(F.endswith(F.lower("path"), F.lit(".zip"))), extensions, case_sensitive, max_depth).where("member IS NOT NULL")
    return files.where(wanted).select("path", F.lit(None).cast("string").alias("script")).union(inside.select("archive", "member"))


def flattened(found: DataFrame) -> DataFrame:
    """SCHEMA rows of scripts with name, the member's last part, one row for each archive and name: the first member by depth, then by path."""
    own = found.where("member IS NOT NULL").withColumn("name", F.substring_index(F.substring_index("member", "/", -1), "\\", -1))
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("archive", "name").orderBy("depth", "member"))).where("_r = 1").drop("_r")


def is_zip(content):
    """By its first two bytes."""
    return F.substring(content, 1, 2) == F.lit(b"PK")


def quarantined(extracted: DataFrame) -> DataFrame:
    """Archives to try again later."""
    return extracted.where(F.col("error").startswith("extraction_failed")).select("archive", "error")


def content_hash(content, algorithm: str = "md5"):
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    return F.sha2(content, int(algorithm.removeprefix("sha")))
