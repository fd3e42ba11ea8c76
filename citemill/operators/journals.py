"""Journals that projects name, by DOI, by mention and by collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions import keys, text


def projects_with_dois(projects: DataFrame) -> DataFrame:
    """Adds dois to projects (project_id, title, description, …) that have any."""
    return projects.withColumn("dois", text.dois(F.col("description"), F.col("title"))).where(F.size("dois") > 0)


def doi_rows(projects: DataFrame) -> DataFrame:
    return projects.select("project_id", "seq", F.posexplode("dois").alias("place", "doi"))


def resolved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """DOI rows with journal and publisher; null where the lookup has none. known is joined by its size: Spark broadcasts it only below its threshold."""
    return rows.withColumn("_doi", keys.bare_doi(F.col("doi"))).join(known.withColumnRenamed("doi", "_doi"), "_doi", "left").drop("_doi")


def journal_rollup(found: DataFrame) -> DataFrame:
    """(journal, project_count, doi_count, publisher): publisher of the first sighting."""
    return found.where(F.col("journal").isNotNull()).groupBy("journal").agg(
        F.count_distinct("project_id").alias("project_count"), F.count("doi").alias("doi_count"), F.min_by("publisher", F.struct("seq", "place")).alias("publisher"),
    )


def journal_details(found: DataFrame, issn: str | None = None) -> DataFrame:
    """The rollup with each journal's projects, in order of sighting and once each, its DOIs, in order and with repeats, and the ISSNs of its first sighting (empty where the lookup has none)."""
    seen = F.struct("seq", "place", "project_id", "doi", "publisher", (F.col(issn) if issn else F.array().cast("array<string>")).alias("issn"))
    rows = found.where(F.col("journal").isNotNull()).groupBy("journal").agg(F.sort_array(F.collect_list(seen)).alias("s"))
    projects = F.array_distinct(F.transform("s", lambda x: x["project_id"]))
    return rows.select(
        "journal", F.get("s", F.lit(0))["publisher"].alias("publisher"), F.coalesce(F.get("s", F.lit(0))["issn"], F.array().cast("array<string>")).alias("issn"),
        projects.alias("projects"), F.size(projects).cast("long").alias("project_count"), F.transform("s", lambda x: x["doi"]).alias("dois"),
    )


def sampled(rows: DataFrame, key: str, order: str, n: int | None = None) -> DataFrame:
    """The first n over all search terms, after each key's first row alone has stayed; all of them without n."""
    once = first_of_each(rows, key, order).orderBy(order)
    return once if n is None else once.limit(n)


def doi_summary(found: DataFrame) -> DataFrame:
    """One row: journals, projects mapped, DOIs resolved and failed, success rate in percent."""
    hit = F.col("journal").isNotNull()
    out = found.agg(
        F.count_distinct("journal").alias("journals"), F.count_distinct(F.when(hit, F.col("project_id"))).alias("projects"), F.count_if(hit).alias("resolved"), F.count_if(~hit).alias("failed"),
    )
    return out.withColumn("success_rate", F.coalesce(F.try_divide(F.col("resolved") * 100, F.col("resolved") + F.col("failed")), F.lit(0.0)))


def failed_dois(found: DataFrame, n: int = 50) -> DataFrame:
    return found.where(F.col("journal").isNull()).orderBy("seq", "place").select("doi").limit(n)


def mention_rollup(projects: DataFrame) -> DataFrame:
    """(journal, mention_count): in how many projects' texts each journal name occurs."""
    return projects.select("project_id", F.explode(text.journal_names(F.col("text"))).alias("journal")).groupBy("journal").agg(F.count("*").alias("mention_count"))


def mention_projects(projects: DataFrame) -> DataFrame:
    return projects.select("project_id", F.explode(text.journal_names(F.col("text"))).alias("journal")).groupBy("journal").agg(F.sort_array(F.collect_list("project_id")).alias("projects"))


def collection_summary(collections: DataFrame) -> DataFrame:
    """One row over collections (title, description, projects): collections, journal collections, their projects."""
    own = text.is_journal_collection(F.col("title"), F.col("description"))
    return collections.agg(F.count("*").alias("collections"), F.count_if(own).alias("journal_collections"), F.coalesce(F.sum(F.when(own, F.size("projects"))), F.lit(0)).alias("projects"))


def journal_collections(collections: DataFrame, shown: int = 10) -> DataFrame:
    own = text.is_journal_collection(F.col("title"), F.col("description"))
    return collections.where(own).select("title", F.size("projects").alias("project_count"), F.slice("projects", 1, shown).alias("first_projects"))


def cross_summary(*journals_and_projects: DataFrame) -> DataFrame:
    """One row: distinct journal names and distinct projects over several analyses of (journal, project_id)."""
    rows = journals_and_projects[0].select("journal", F.col("project_id").cast("string"))
    for other in journals_and_projects[1:]:
        rows = rows.union(other.select("journal", F.col("project_id").cast("string")))
    return rows.agg(F.count_distinct(F.when(F.col("journal") != "", F.col("journal"))).alias("journals"), F.count_distinct("project_id").alias("projects"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def quota(rows: DataFrame, term: str, order: str, whole: int, n_terms: int) -> DataFrame:
    """An equal part of the whole for each search term."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(term).orderBy(order))).where(F.col("_r") <= whole // n_terms).drop("_r")
