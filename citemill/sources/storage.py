"""Files that tasks write one by one: downloads, status markers, copies. Targets may lie on any file system that pyarrow knows; a file appears under its name only when it is whole, so a task that is lost and run again leaves no halves."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.sources import http

#: Called in the task; gives a function that puts a URL's body at a path and returns its size, or None where there is none.
Copier = Callable[[], Callable[[str, str], int | None]]
CHUNK = 1 << 20


def over_http(login: tuple[str, dict[str, str]] | None = None, **how) -> Copier:
    """Bodies over HTTP, in chunks; login: (address, form) of a session that is opened once a task, without which nothing is fetched."""
    def open_copier():
        opener = http.logged_in(*login, **how) if login else None
        if login and opener is None:
            return lambda url, path: None

        def copy(url: str, path: str) -> int | None:
            def keep(reply):
                def write(out):
                    size = pour(reply, out)
                    if reply.length:  # it broke off
                        raise OSError(f"{reply.length} bytes of {url} are missing")
                    return size
                return write_whole(path, write)
            return http.http_copy(url, keep, opener=opener, **how)
        return copy
    return open_copier


def from_recordings(recordings: dict[str, str]) -> Copier:
    """Bodies from recordings, url -> text."""
    return lambda: lambda url, path: write_whole(path, lambda out: out.write(recordings[url].encode())) if isinstance(recordings.get(url), str) else None


def pour(source, target) -> int:
    """Copies what is left of one open file to another; how much that was."""
    size = 0
    while chunk := source.read(CHUNK):
        size += target.write(chunk)
    return size


def opened(path: str):
    """(file system, path on it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_whole(path: str, write) -> int | None:
    """Lets write(file) fill a file that then gets its name; nothing is left of one for which it gives None or raises."""
    system, name = opened(path)
    folder, _, last = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{last}.{uuid.uuid4().hex}.part"
    done = None
    try:
        with system.open_output_stream(part) as f:
            done = write(f)
        if done is not None:
            system.move(part, name)
    finally:
        if done is None and _exists(system, part):
            system.delete_file(part)
    return done


def _exists(system, name: str) -> bool:
    from pyarrow import fs

    return system.get_file_info(name).type != fs.FileType.NotFound


def inside(name: str | None) -> bool:
    """Whether a relative name stays below the folder that it is put in."""
    return bool(name) and not name.startswith("/") and not {"", ".", ".."} & set(name.split("/"))


def _each(df: DataFrame, schema: str, one) -> DataFrame:
    """One row of the schema for each row, by one(*values)."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(batches):
        act = one()
        for batch in batches:
            rows = [act(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if n == "size" else pa.string()) for i, n in enumerate(names)], names=names)

    return df.mapInArrow(run, schema)


def downloaded(files: DataFrame, folder: str, copier: Copier, force: bool = False) -> DataFrame:
    """(repo_id, name, url, status, size) over files (repo_id, name, url), each put into folder/repo_id/name: success, exists (it is there already and wasn't asked for again, unless forced), or failed (no reply, no address, or a name that leads out of the folder).

    The result is lazy and each use downloads anew what failed: write it once, as run() of a command does.
    """
    folder = folder.rstrip("/")

    def open_task():
        copy = copier()

        def one(repo_id, name, url):
            if not url or not inside(repo_id) or not inside(name):
                return repo_id, name, url, "failed", None
            path = f"{folder}/{repo_id}/{name}"
            system, at = opened(path)
            if not force and _exists(system, at):
                return repo_id, name, url, "exists", system.get_file_info(at).size
            try:
                size = copy(url, path)
            except OSError:
                size = None
            return repo_id, name, url, "failed" if size is None else "success", size
        return one

    wanted = files.select(*(F.col(c).cast("string") for c in ("repo_id", "name", "url"))).dropDuplicates(["repo_id", "name"])
    return _each(wanted, "repo_id string, name string, url string, status string, size long", open_task)


def write_markers(rows: DataFrame, folder: str) -> DataFrame:
    """(repo_id, path) of the .status markers that it writes for rows (repo_id, status, timestamp, details): one JSON document in each repository's folder, as files.status_files reads them. Lazy, as downloads are."""
    folder = folder.rstrip("/")

    def open_task():
        def one(repo_id, status, timestamp, details):
            if not inside(repo_id):
                return repo_id, None
            path = f"{folder}/{repo_id}/.status"
            body = json.dumps({"status": status, "timestamp": timestamp, "details": json.loads(details or "{}")}, indent=2).encode()
            write_whole(path, lambda f: f.write(body))
            return repo_id, path
        return one

    return _each(rows.select(F.col("repo_id").cast("string"), "status", F.col("timestamp").cast("string"), F.to_json("details")), "repo_id string, path string", open_task)


def copied(paths: DataFrame, source: str, target: str) -> DataFrame:
    """(path, to) of files below a source folder (column path), copied to the same place below the target; to is null for one that can't be copied."""
    source, target = source.rstrip("/"), target.rstrip("/")

    def open_task():
        def one(path):
            below = path.removeprefix(f"{source}/") if path else None
            if below == path or not inside(below):
                return path, None

            system, at = opened(path)
            try:
                with system.open_input_stream(at) as f:
                    write_whole(f"{target}/{below}", lambda out: pour(f, out))
            except OSError:
                return path, None
            return path, f"{target}/{below}"
        return one

    return _each(paths.select("path"), "path string, to string", open_task)


def removed(path: str) -> bool:
    """Deletes a file or a folder with what is in it; whether that worked."""
    from pyarrow import fs

    system, name = opened(path)
    try:
        (system.delete_dir if system.get_file_info(name).type == fs.FileType.Directory else system.delete_file)(name)
    except OSError:
        return False
    return True


def made(path: str) -> str:
    """A folder that is there from now on, with those above it."""
    system, name = opened(path)
    system.create_dir(name, recursive=True)
    return path
