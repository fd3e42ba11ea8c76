"""Replies of repository services, as recorded JSON or HTML, turned into tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions import keys, text

DATASET_REPLY = "data STRUCT<latestVersion STRUCT<files ARRAY<STRUCT<dataFile STRUCT<id BIGINT, filename STRING>>>>>"
SEARCH_DOCS = "ARRAY<STRUCT<ID STRING, TITLE STRING, SUMMARY STRING, AUTHOR STRING>>"
#: Where a study is shown; its id follows.
STUDY_URL = "https://www.openicpsr.org/openicpsr/project/"
#: Where a file of a dataset is; its number follows.
FILE_URL = "https://dataverse.harvard.edu/api/access/datafile/"
NODE = "id STRING, type STRING, attributes STRUCT<title STRING, description STRING, public BOOLEAN, kind STRING, name STRING>, links STRUCT<next STRING, download STRING>"


def datasets(rows: DataFrame, url: str = "persistentUrl") -> DataFrame:
    """Dataset rows that have an address."""
    return rows.na.drop(subset=[url])


def manifest(replies: DataFrame, url: str, reply: str) -> DataFrame:
    """(doi, fid, fn): the files of each dataset's latest version; a missing name is empty."""
    parsed = datasets(replies, url).select(keys.normal_doi(F.col(url)).alias("doi"), F.from_json(reply, DATASET_REPLY).alias("r"))
    files = parsed.select("doi", F.explode("r.data.latestVersion.files").alias("f"))
    return files.select("doi", F.col("f.dataFile.id").alias("fid"), F.coalesce("f.dataFile.filename", F.lit("")).alias("fn"))


def file_requests(manifest_rows: DataFrame) -> DataFrame:
    """(repo_id, name, url) of a manifest's files: each goes to the folder named by the end of its DOI."""
    return manifest_rows.select(keys.doi_tail(F.col("doi")).alias("repo_id"), F.col("fn").alias("name"), F.concat(F.lit(FILE_URL), F.col("fid").cast("string")).alias("url"))


def node_requests(node_files: DataFrame, node: str, attributes: str = "attributes", links: str = "links") -> DataFrame:
    """(repo_id, name, url) of a node's files; folders, and files without an address, are left out."""
    found = node_files.where((F.col(attributes)["kind"] == "file") & F.col(links)["download"].isNotNull())
    return found.select(F.col(node).alias("repo_id"), F.concat(F.lit("files/"), F.coalesce(F.col(attributes)["name"], F.lit("unknown"))).alias("name"), F.col(links)["download"].alias("url"))


def with_id(rows: DataFrame, column: str = "id") -> DataFrame:
    """Rows that have an id."""
    return rows.where(F.col(column).isNotNull())


def union_all(by_name: dict[str, DataFrame], column: str = "community") -> DataFrame:
    """All rows with where they come from; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn(column, F.lit(name)) for name, df in by_name.items()))


def sliced_search(pages: DataFrame, page: str) -> DataFrame:
    """(study_id, title, summary, author, url) from search pages whose results are JSON inside a script."""
    after = F.substring_index(F.element_at(F.split(F.col(page), "searchResults : "), -1), ',"numFound"', 1)
    docs = F.concat(F.lit("["), F.regexp_extract(after, r'(?s)"docs":\[(.*)$', 1))
    rows = pages.where(F.contains(F.col(page), F.lit("searchResults : "))).select(F.explode(F.from_json(docs, SEARCH_DOCS)).alias("d"))
    return rows.select(
        F.col("d.ID").alias("study_id"), F.col("d.TITLE").alias("title"), text.unlisted(text.html_text(F.col("d.SUMMARY"))).alias("summary"), text.unlisted(F.col("d.AUTHOR")).alias("author"),
        F.concat(F.lit(STUDY_URL), F.col("d.ID")).alias("url"),
    )


def project_rows(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Rows (title, url, …) with the study id that the address names; the first row of each id, without those that lack title or id."""
    found = rows.withColumn("study_id", F.regexp_extract("url", r"/project/([^/]+)", 1)).where("title <> '' AND study_id <> ''")
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("study_id").orderBy(order))).where("_r = 1").drop("_r")


def nodes(replies: DataFrame, reply: str) -> DataFrame:
    """Nodes, files or collections of JSON:API pages, one row each."""
    return replies.select(F.explode(F.from_json(reply, f"data ARRAY<STRUCT<{NODE.replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN').replace(' STRUCT', ': STRUCT')}>>")["data"]).alias("n")).select("n.*")


def crossref(replies: DataFrame, doi: str, reply: str) -> DataFrame:
    """(doi, journal, publisher, issn, publication_year, title, authors, type) of DOI replies."""
    shape = """message STRUCT<`container-title`: ARRAY<STRING>, publisher: STRING, ISSN: ARRAY<STRING>, title: ARRAY<STRING>, type: STRING, author: ARRAY<STRUCT<given: STRING, family: STRING>>,
      `published-print`: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, `published-online`: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>>"""
    m = replies.select(keys.bare_doi(F.col(doi)).alias("doi"), F.from_json(reply, shape)["message"].alias("m")).where("m IS NOT NULL")
    year = lambda part: F.get(F.get(F.col(f"m.{part}.date-parts") if "-" not in part else F.col("m")[part]["date-parts"], F.lit(0)), F.lit(0))
    return m.select(
        "doi", F.coalesce(F.get(F.col("m")["container-title"], F.lit(0)), F.lit("Unknown")).alias("journal"), F.coalesce(F.col("m.publisher"), F.lit("Unknown")).alias("publisher"),
        F.coalesce(F.col("m.ISSN"), F.array().cast("array<string>")).alias("issn"), F.coalesce(year("published-print"), year("published-online")).alias("publication_year"), F.coalesce(F.get(F.col("m.title"), F.lit(0)), F.lit("")).alias("title"),
        F.transform(F.coalesce(F.col("m.author"), F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))).alias("authors"), F.col("m.type").alias("type"),
    )
