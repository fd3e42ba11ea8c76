"""From scripts to import rows, and from import rows to citation counts.

Rows without names are dropped after explode_outer: for explode Spark adds a filter on the array, which works out all names a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions import classify, keys
from citemill.functions.python_imports import notebook_imports, python_imports
from citemill.functions.r_imports import with_r_imports
from citemill.functions.stata_imports import with_stata_imports


def import_rows(scripts: DataFrame, compat: bool = False) -> DataFrame:
    """(package, language, file_path, classification, dataverse, repo_id) of scripts (path, text), one row for each name in a file.

    Each language is a branch of its own, so that a parser only sees its own scripts. Files of other kinds and files without imports give no rows.
    """
    s = scripts.select("path", "text", keys.language(F.col("path")).alias("language"))
    notebook = F.lower(keys.suffix(F.col("path"))) == ".ipynb"
    text = F.col("text")
    branches = [
        with_r_imports(s.where("language = 'R'")).select("path", "language", "found"),
        with_stata_imports(s.where("language = 'Stata'")).select("path", "language", "found"),
        s.where((F.col("language") == "Python") & ~notebook).select("path", "language", python_imports(text).alias("found")),
        s.where((F.col("language") == "Python") & notebook).select("path", "language", notebook_imports(text).alias("found")),
    ]
    rows = branches[0]
    for b in branches[1:]:
        rows = rows.unionByName(b)
    named = with_keys(rows, compat).select(F.explode_outer("found").alias("package"), "language", F.col("path").alias("file_path"), "dataverse", "repo_id").where("package IS NOT NULL")
    return named.withColumn(
        "classification", classify.package_class(F.col("language"), F.col("package"), compat)
    ).select("package", "language", "file_path", "classification", "dataverse", "repo_id")


def with_keys(rows: DataFrame, compat: bool = False, path: str = "path") -> DataFrame:
    return rows.withColumn("dataverse", keys.source(F.col(path), compat)).withColumn("repo_id", keys.repo_id(F.col(path), compat))


def extracted(scripts: DataFrame, compat: bool = False) -> DataFrame:
    """(package, dataverse, repo_id) of scripts (path, found) of one language."""
    return with_keys(scripts, compat).select(F.explode_outer("found").alias("package"), "dataverse", "repo_id").where("package IS NOT NULL")


def tally(imports: DataFrame) -> DataFrame:
    """(package, count): in how many repositories each package is imported. Rows without a key don't count.

    Distinct, then count: both aggregate before they shuffle, so a package or a repository that is everywhere moves once a task. Keys are tested after that: a filter on
    them would be pushed below the extraction, where they would be worked out a second time.
    """
    once = imports.select("dataverse", "repo_id", "package").distinct()
    keyed = F.count_if(F.col("dataverse").isNotNull() & F.col("repo_id").isNotNull())
    return once.groupBy("package").agg(keyed.alias("count")).where("count > 0")


def ranked(tallied: DataFrame, n: int | None = None) -> DataFrame:
    """By count, then name; the first n, if asked for."""
    out = tallied.orderBy(F.col("count").desc(), "package")
    return out if n is None else out.limit(n)


def with_citation_rank(tallied: DataFrame) -> DataFrame:
    """Adds citation_rank; equal counts share one. As many rows as there are different counts are ranked."""
    by_count = tallied.groupBy("count").agg(F.count("*").alias("_n"))
    over = Window.orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_count.select("count", (F.coalesce(F.sum("_n").over(over), F.lit(0)) + 1).alias("citation_rank"))
    return tallied.join(ranks, "count").select("package", "count", "citation_rank")


def repo_sets(imports: DataFrame) -> DataFrame:
    """(dataverse, repo_id, packages): each repository's packages, sorted. Rows without a key have no package to collect, so that keys are worked out once, as in tally."""
    keyed = F.when(F.col("dataverse").isNotNull() & F.col("repo_id").isNotNull(), F.col("package"))
    return imports.groupBy("dataverse", "repo_id").agg(F.sort_array(F.collect_set(keyed)).alias("packages")).where(F.size("packages") > 0)


def totals(imports: DataFrame) -> DataFrame:
    """One row: rows, packages, repositories as pairs, and repositories as the sum of two distinct counts."""
    return imports.agg(
        F.count("*").alias("n_rows"), F.count_distinct("package").alias("n_packages"), F.count_distinct("dataverse", "repo_id").alias("n_repositories"),
        (F.count_distinct("dataverse") + F.count_distinct("repo_id")).alias("n_keys"),
    )


def language_counts(imports: DataFrame) -> DataFrame:
    return imports.groupBy("language").agg(F.count("*").alias("count"))


def class_counts(imports: DataFrame) -> DataFrame:
    return imports.groupBy("language", "classification").agg(F.count("*").alias("count"))


def listed_frequencies(rows: DataFrame, column: str, separator: str = ", ") -> DataFrame:
    """(package, count) over a column of joined names."""
    return rows.select(F.explode(F.split(F.col(column), separator)).alias("package")).groupBy("package").agg(F.count("*").alias("count"))


def package_lists(imports: DataFrame) -> DataFrame:
    """(repo_id, packages): distinct packages of each repository as one string."""
    return imports.where(F.col("repo_id").isNotNull()).groupBy("repo_id").agg(F.array_join(F.sort_array(F.collect_set("package")), ", ").alias("packages"))


def shared_packages(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.select("package").intersect(other.select("package"))
