"""python -m citemill COMMAND: the runs of the engine from a shell."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import functions as F

from citemill.functions import classify, keys
from citemill.operators import archives, imports, statuses
from citemill.session import session
from citemill.sources import files, listings, services, sinks, storage


def tally(spark, a) -> None:
    """Import rows and package counts of a folder of scripts, as CSV."""
    scripts = files.scripts(spark, a.scripts)
    if a.languages:
        scripts = scripts.where(keys.language(F.col("path")).isin(*a.languages))
    rows = imports.import_rows(scripts, a.compat)
    sinks.write_csv(rows, f"{a.output}/file_imports")
    written = files.table(spark, f"{a.output}/file_imports")  # the summary reads the rows that were written, not the scripts again
    sinks.write_csv(imports.ranked(imports.tally(written)), f"{a.output}/imports_per_package", single=True)
    for r in imports.ranked(imports.tally(written), a.top).collect():
        print(f"{r['count']:8,}  {r['package']}")
    print(imports.totals(written).first().asDict())


def status(spark, a) -> None:
    """What a folder's status markers say; or the repositories worth another try."""
    rows = files.status_files(spark, a.folder)
    if a.retryable:
        for r in statuses.retryable(rows).orderBy("status", "repo_id").limit(a.top).collect():
            print(r["status"], r["repo_id"])
        return
    counted = rows.withColumn("script_count", F.try_element_at("details", F.lit("script_count")).cast("long"))
    print(sinks.status_report(statuses.summary(counted), statuses.by_status(counted)))


def extract(spark, a) -> None:
    """Script members of all archives below a folder, as Parquet; those that fail go to a table of their own."""
    found = archives.extract(files.archives(spark, a.folder), keys.EXTENSIONS[a.kind])
    found.write.mode("overwrite").parquet(f"{a.output}/members")
    members = spark.read.parquet(f"{a.output}/members")
    archives.quarantined(members).write.mode("overwrite").parquet(f"{a.output}/quarantine")
    print(members.groupBy(F.coalesce("error", F.lit("extracted")).alias("result")).count().collect())


def classes(spark, a) -> None:
    """Classes of package names."""
    df = spark.createDataFrame([(n,) for n in a.names], "package string")
    for r in df.select("package", classify.package_class(F.lit(a.language), F.col("package")).alias("c")).collect():
        print(r["package"], r["c"])


def collect(spark, a) -> None:
    """Items of a repository service for some seeds, as Parquet of (seed, item): datasets of dataverses, records of communities, nodes, boxes. What is there is kept, unless forced."""
    if files.exists(spark, a.output) and not a.force:
        print("exists", a.output)
        return
    spark.dataSource.register(services.Service)
    options = {"kind": a.kind, "seeds": ",".join(a.seeds), "pause": str(a.pause)}
    options |= {k: v for k, v in (("recordings", a.recordings), ("token", a.token), ("maxPages", a.max_pages), ("filter", a.filter)) if v}
    spark.read.format("repository_service").options(**options).load().write.mode("overwrite").parquet(a.output)
    print(spark.read.parquet(a.output).groupBy("seed").count().orderBy("seed").limit(a.top).collect())


def download(spark, a) -> None:
    """Scripts of the datasets that collect dataset wrote: a manifest of their files, then the files, each in the folder of its dataset; what is there is skipped, unless forced."""
    if not files.has_room(spark, a.output, a.least_gb):
        raise SystemExit(f"less than {a.least_gb} GB are left in {a.output}")
    found = spark.read.parquet(a.items).select(F.col("seed").alias("url"), F.col("item").alias("reply"))
    manifest = listings.manifest(found, "url", "reply").where(keys.ends_with_any(F.col("fn"), keys.EXTENSIONS["collection"]))
    sinks.write_csv(manifest, f"{a.output}/manifest")
    wanted = listings.file_requests(files.table(spark, f"{a.output}/manifest", "doi string, fid long, fn string"))
    if a.recordings:
        with open(a.recordings, encoding="utf-8") as f:
            copier = storage.from_recordings(json.load(f))
    else:
        copier = storage.over_http(token=a.token)
    rows = storage.downloaded(wanted.repartition(a.workers), f"{a.output}/files", copier, a.force)
    rows, seen = statuses.observed(rows.withColumn("error", F.when(F.col("status") == "failed", F.col("url"))).withColumn("scripts", (F.col("status") != "failed").cast("int")))
    rows.write.mode("overwrite").parquet(f"{a.output}/downloads")
    print(statuses.progress_line("downloads", seen.get))


def recover(spark, a) -> None:
    """Script members of the archives of a folder that failed before and can be read now, as Parquet."""
    failed = spark.read.parquet(f"{a.output}/quarantine").select(F.col("archive").alias("path"))
    again = files.archives(spark, a.folder).join(failed, "path", "left_semi")
    archives.extract(again, keys.EXTENSIONS[a.kind]).where("error IS NULL").write.mode("overwrite").parquet(f"{a.output}/recovered")
    print("recovered", spark.read.parquet(f"{a.output}/recovered").select("archive").distinct().count())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="citemill", description=__doc__)
    p.add_argument("--master")
    p.add_argument("--log-level", default="WARNING")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("tally", help=tally.__doc__)
    t.add_argument("scripts")
    t.add_argument("output")
    t.add_argument("--languages", nargs="*", choices=["R", "Python", "Stata"])
    t.add_argument("--compat", action="store_true")
    t.add_argument("--top", type=int, default=10)
    s = sub.add_parser("status", help=status.__doc__)
    s.add_argument("folder")
    s.add_argument("--retryable", action="store_true")
    s.add_argument("--top", type=int, default=10)
    e = sub.add_parser("extract", help=extract.__doc__)
    e.add_argument("folder")
    e.add_argument("output")
    e.add_argument("--kind", default="archives", choices=list(keys.EXTENSIONS))
    g = sub.add_parser("collect", help=collect.__doc__)
    g.add_argument("kind", choices=[*services.ENDPOINTS, "box"])
    g.add_argument("output")
    g.add_argument("seeds", nargs="+")
    g.add_argument("--token")
    g.add_argument("--filter")
    g.add_argument("--max-pages")
    g.add_argument("--pause", type=float, default=0.0)
    g.add_argument("--top", type=int, default=100)
    d = sub.add_parser("download", help=download.__doc__)
    d.add_argument("items")
    d.add_argument("output")
    d.add_argument("--token")
    d.add_argument("--workers", type=int, default=4)
    d.add_argument("--least-gb", type=float, default=5)
    for one in (g, d):
        one.add_argument("--recordings")
        one.add_argument("--force", action="store_true")
    r = sub.add_parser("recover", help=recover.__doc__)
    r.add_argument("folder")
    r.add_argument("output")
    r.add_argument("--kind", default="archives", choices=list(keys.EXTENSIONS))
    c = sub.add_parser("classes", help=classes.__doc__)
    c.add_argument("language", choices=["R", "Python", "Stata"])
    c.add_argument("names", nargs="+")
    a = p.parse_args(argv)
    logging.basicConfig(level=a.log_level.upper())
    spark = session(a.master)
    spark.sparkContext.setLogLevel("ERROR")
    {"tally": tally, "status": status, "extract": extract, "collect": collect, "download": download, "recover": recover, "classes": classes}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
