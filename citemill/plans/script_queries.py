"""Queries over script corpora: extraction, keys, classes, tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import classify, keys
from citemill.functions.python_imports import python_imports
from citemill.functions.r_imports import r_library_calls, with_r_imports, without_comments
from citemill.functions.stata_imports import with_stata_imports, without_comments as stata_code
from citemill.operators import imports as ops
from citemill.plans import corpora as c

_R = c.sql(c.R_SCRIPTS)
_STATA = c.sql(c.STATA_SCRIPTS)
_PY = c.sql(c.PYTHON_SCRIPTS)
_PATHS = c.sql(c.PATHS)

# --- SQL pieces for DuckDB. Its regular expressions have no possessive quantifiers; the corpora hold no backslashes and no open quotes, where this form is equal.
_R_CODE = r"""array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^((?:[^"''#]|"[^"]*"|''[^'']*'')*)#.*$', '\1')), ' ')"""
_CALL = r"""\(\s*(?:["'']([^"'']+)["'']|([^,\)\s]+))\s*[,\)]"""
_R_FOUND = rf"""list_distinct(list_filter(list_transform(list_concat(
    regexp_extract_all(code, '(?i)\b(?:library|require)\s*{_CALL}', 1), regexp_extract_all(code, '(?i)\b(?:library|require)\s*{_CALL}', 2),
    list_filter(list_transform(flatten(list_transform(regexp_extract_all(code, '(?i)\bp_load\s*\(\s*([^\)]+)\)', 1), lambda x: string_split(x, ','))), lambda x: regexp_replace(x, '["\s]', '', 'g')), lambda x: NOT starts_with(x, 'char')),
    list_filter(regexp_extract_all(code, '\b([a-zA-Z][a-zA-Z0-9._]*)\s*::', 1), lambda x: x NOT IN ('base', 'utils', 'stats', 'graphics', 'datasets')),
    regexp_extract_all(code, '(?i)\b(?:loadNamespace|requireNamespace)\s*\(\s*["'']([^"'']+)["'']\s*\)', 1),
    regexp_extract_all(code, '(?i)\binstall_github\s*\(\s*["'']([^/"'']+)/([^"'']+)["'']', 2)),
  lambda x: trim(regexp_replace(regexp_replace(x, '\s*[>=<].*', ''), '\s*\(.*\)', ''))), lambda x: regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9._]+$')))"""
_LIST_KEYS = r"""nullif(regexp_extract(path, '/([^/]+)_datasets_files/', 1), '') AS dataverse, nullif(regexp_extract(path, '_datasets_files/([^/]+)/', 1), '') AS repo_id"""
_R_ROWS = f"SELECT path, unnest({_R_FOUND}) AS package, {_LIST_KEYS} FROM (SELECT path, {_R_CODE} AS code FROM ({_R}))"

_S_CODE = r"""array_to_string(list_transform(string_split(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), chr(10)), lambda x: string_split(x, '//')[1]), ' ')"""
_COMMANDS = "est|outreg|outreg2|estout|esttab|coefplot|binscatter|rd|rdrobust|ivreg2|xtivreg2|xtabond2|did|diff|matching|psmatch2|ttest|ranksum|signrank"
_S_FOUND = rf"""list_distinct(list_filter(list_concat(
    regexp_extract_all(code, '(?i)\bssc\s+install\s+([a-zA-Z][a-zA-Z0-9_]*)', 1), regexp_extract_all(code, '(?i)\bnet\s+install\s+([a-zA-Z][a-zA-Z0-9_]*)', 1),
    list_transform(list_filter(list_transform(regexp_extract_all(code, '(?i)\badopath\s+\+\s+([^\s;]+)', 1), lambda x: trim(x, '"''')), lambda x: contains(x, '/')), lambda x: regexp_extract(x, '([^/]*)$', 1)),
    list_filter(regexp_extract_all(code, '(?i)\bwhich\s+([a-zA-Z][a-zA-Z0-9_]*)', 1), lambda x: lower(x) NOT IN ('summarize','regress','logit','probit','tabulate','describe','generate','replace','drop','keep','merge','append','sort','list','display','use','save','clear','set','quietly','capture','foreach','forvalues','if','else','while')),
    list_transform(regexp_extract_all(code, '(?i)\b((?:{_COMMANDS})2?)\b', 1), lambda x: CASE lower(x) WHEN 'esttab' THEN 'estout' WHEN 'xtivreg2' THEN 'ivreg2' WHEN 'outreg2' THEN 'outreg2' ELSE x END),
    regexp_extract_all(code, '(?i)\bfindit\s+([a-zA-Z][a-zA-Z0-9_]*)', 1)), lambda x: regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9_]+$')))"""
_S_ROWS = f"SELECT path, unnest({_S_FOUND}) AS package, {_LIST_KEYS} FROM (SELECT path, {_S_CODE} AS code FROM ({_STATA}))"

_TALLY = "SELECT package, count(*) AS count FROM (SELECT DISTINCT dataverse, repo_id, package FROM ({rows}) WHERE dataverse IS NOT NULL AND repo_id IS NOT NULL) GROUP BY package"


def _r(spark, sf):
    return ops.extracted(with_r_imports(c.frame(spark, sf, c.R_SCRIPTS)))


def _stata(spark, sf):
    return ops.extracted(with_stata_imports(c.frame(spark, sf, c.STATA_SCRIPTS)))


def _py_rows(spark, sf):
    return ops.extracted(c.frame(spark, sf, c.PYTHON_SCRIPTS).withColumn("found", python_imports(F.col("text"))))


_PY_ROWS = r"""SELECT path, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(text, 'import ([a-z0-9_]+\.sub\d)', 1), regexp_extract_all(text, 'import ([a-z0-9_]+)\.sub', 1)),
   list_concat(regexp_extract_all(text, 'from ([a-z0-9_]+)\.core', 1), list_concat(regexp_extract_all(text, 'from ([a-z0-9_]+\.core)', 1), ['os', 'json']))))) AS package,
   'dataverse' AS dataverse, regexp_extract(path, '/dataverse/([^/]+)/', 1) AS repo_id FROM (""" + _PY + ") WHERE text NOT LIKE 'this is%'"

_SOURCE = r"""CASE WHEN contains(path, 'icpsr') THEN 'icpsr' WHEN contains(path, 'zenodo') THEN 'zenodo'
  WHEN regexp_matches(path, '/[^/]+_datasets_files/') THEN regexp_extract(path, '/([^/]+)_datasets_files/', 1) WHEN regexp_matches(path, '/ResearchBox_\d+/') THEN 'researchbox'
  WHEN regexp_matches(path, '/osf/[^/]+/') THEN 'osf' WHEN regexp_matches(path, '/dataverse/[^/]+/') THEN 'dataverse' END"""
_REPO = r"""nullif(CASE WHEN contains(path, 'icpsr') THEN regexp_extract(path, 'icpsr/([^/]+)/', 1) WHEN contains(path, 'zenodo') THEN regexp_extract(path, 'zenodo/([^/]+)/', 1)
  WHEN regexp_matches(path, '_datasets_files/[^/]+/') THEN regexp_extract(path, '_datasets_files/([^/]+)/', 1) WHEN regexp_matches(path, '/ResearchBox_\d+/') THEN regexp_extract(path, '/ResearchBox_(\d+)/', 1)
  WHEN regexp_matches(path, '/osf/[^/]+/') THEN regexp_extract(path, '/osf/([^/]+)/', 1) ELSE regexp_extract(path, '/dataverse/([^/]+)/', 1) END, '')"""
_LANGUAGE = r"CASE lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) WHEN '.r' THEN 'R' WHEN '.rscript' THEN 'R' WHEN '.py' THEN 'Python' WHEN '.ipynb' THEN 'Python' WHEN '.do' THEN 'Stata' END"
_CLASS = """CASE WHEN lower(package) IN ('base','compiler','datasets','graphics','grdevices','grid','methods','parallel','splines','stats','stats4','tcltk','tools','translations','utils') THEN 'base'
  WHEN lower(package) IN ('boot','class','cluster','codetools','foreign','kernsmooth','lattice','mass','matrix','mgcv','nlme','nnet','rpart','spatial','survival') THEN 'recommended' ELSE 'third-party' END"""


def _paths(spark, sf):
    return c.frame(spark, sf, c.PATHS)


def _named(spark):
    names = [*classify.R_BASE, *classify.R_RECOMMENDED, "MASS", "ggplot2", "dplyr"]
    return spark.createDataFrame([(n,) for n in names], "package string")


_NAMED = "(VALUES " + ", ".join(f"('{n}')" for n in (*classify.R_BASE, *classify.R_RECOMMENDED, "MASS", "ggplot2", "dplyr")) + ") v(package)"

QUERIES = {
    "a01_package_tally": (lambda s, d: ops.tally(_r(s, d)), _TALLY.format(rows=_R_ROWS)),
    "a01_stata_tally": (lambda s, d: ops.tally(_stata(s, d)), _TALLY.format(rows=_S_ROWS)),
    "a01_python_tally": (lambda s, d: ops.tally(_py_rows(s, d)), _TALLY.format(rows=_PY_ROWS)),
    "t01_r_imports": (lambda s, d: _r(s, d).groupBy("package").agg(F.count("*").alias("files")), f"SELECT package, count(*) AS files FROM ({_R_ROWS}) GROUP BY package"),
    "t02_r_comments": (
        lambda s, d: c.frame(s, d, c.R_SCRIPTS).select(F.length(without_comments(F.col("text"))).alias("n")).groupBy("n").agg(F.count("*").alias("files")),
        f"SELECT length({_R_CODE}) AS n, count(*) AS files FROM ({_R}) GROUP BY 1",
    ),
    "t04_python_imports": (lambda s, d: _py_rows(s, d).groupBy("package").agg(F.count("*").alias("files")), f"SELECT package, count(*) AS files FROM ({_PY_ROWS}) GROUP BY package"),
    "t07_stata_imports": (lambda s, d: _stata(s, d).groupBy("package").agg(F.count("*").alias("files")), f"SELECT package, count(*) AS files FROM ({_S_ROWS}) GROUP BY package"),
    "t07_stata_comments": (
        lambda s, d: c.frame(s, d, c.STATA_SCRIPTS).select(F.length(stata_code(F.col("text"))).alias("n")).groupBy("n").agg(F.count("*").alias("files")),
        f"SELECT length({_S_CODE}) AS n, count(*) AS files FROM ({_STATA}) GROUP BY 1",
    ),
    "t09_language_dispatch": (
        lambda s, d: _paths(s, d).select(keys.language(F.col("path")).alias("language")).groupBy("language").agg(F.count("*").alias("files")),
        f"SELECT {_LANGUAGE} AS language, count(*) AS files FROM ({_PATHS}) GROUP BY 1",
    ),
    "t09_import_rows": (
        lambda s, d: ops.import_rows(c.frame(s, d, c.R_SCRIPTS).unionByName(c.frame(s, d, c.STATA_SCRIPTS))).groupBy("language", "package", "classification").agg(F.count("*").alias("n")),
        f"SELECT 'R' AS language, package, {_CLASS} AS classification, count(*) AS n FROM ({_R_ROWS}) GROUP BY package UNION ALL SELECT 'Stata', package, 'third-party', count(*) FROM ({_S_ROWS}) GROUP BY package",
    ),
    "t10_r_classes": (lambda s, d: _named(s).select("package", classify.r_class(F.col("package")).alias("classification")), f"SELECT package, {_CLASS} AS classification FROM {_NAMED}"),
    "t10_r_classes_compat": (
        lambda s, d: _named(s).select("package", classify.r_class(F.col("package"), compat=True).alias("classification")),
        f"SELECT package, CASE WHEN lower(package) IN ('grdevices', 'kernsmooth', 'matrix') THEN 'third-party' ELSE {_CLASS} END AS classification FROM {_NAMED}",
    ),
    "t11_python_classes": (
        lambda s, d: _py_rows(s, d).select("package", classify.python_class(F.col("package")).alias("classification")).groupBy("classification").agg(F.count_distinct("package").alias("packages")),
        f"SELECT CASE WHEN package IN ('os', 'json') THEN 'standard' ELSE 'third-party' END AS classification, count(DISTINCT package) AS packages FROM ({_PY_ROWS}) GROUP BY 1",
    ),
    "t15_repository_keys": (
        lambda s, d: ops.with_keys(_paths(s, d)).groupBy("dataverse").agg(F.count("*").alias("files"), F.count_distinct("repo_id").alias("repositories")),
        f"SELECT {_SOURCE} AS dataverse, count(*) AS files, count(DISTINCT {_REPO}) AS repositories FROM ({_PATHS}) GROUP BY 1",
    ),
    "t15_repository_keys_compat": (
        lambda s, d: ops.with_keys(_paths(s, d), compat=True).groupBy("dataverse").agg(F.count("*").alias("files"), F.count_distinct("repo_id").alias("repositories")),
        rf"""SELECT CASE WHEN contains(path, 'icpsr') THEN 'icpsr' WHEN contains(path, 'zenodo') THEN 'zenodo' ELSE nullif(regexp_extract(path, '/([^/]+)_datasets_files/', 1), '') END AS dataverse, count(*) AS files,
          count(DISTINCT CASE WHEN contains(path, 'icpsr') OR contains(path, 'zenodo') THEN NULL ELSE nullif(regexp_extract(path, '_datasets_files/([^/]+)/', 1), '') END) AS repositories FROM ({_PATHS}) GROUP BY 1""",
    ),
    "t27_padded_ids": (
        lambda s, d: _paths(s, d).select(keys.padded_id(F.col("k") * 7).alias("id")).groupBy("id").agg(F.count("*").alias("n")),
        f"SELECT CASE WHEN length(CAST(k * 7 AS VARCHAR)) < 5 THEN lpad(CAST(k * 7 AS VARCHAR), 5, '0') ELSE CAST(k * 7 AS VARCHAR) END AS id, count(*) AS n FROM ({_PATHS}) GROUP BY 1",
    ),
    "t33_library_calls": (
        lambda s, d: c.frame(s, d, c.R_SCRIPTS).select(F.explode(r_library_calls(F.col("text"))).alias("package")).groupBy("package").agg(F.count("*").alias("files")),
        rf"""SELECT package, count(*) AS files FROM (SELECT unnest(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?i)\b(?:library|require)\s*{_CALL}', 1), regexp_extract_all(text, '(?i)\b(?:library|require)\s*{_CALL}', 2)), lambda x: trim(x)), lambda x: x <> ''))) AS package FROM ({_R})) GROUP BY 1""",
    ),
    "f01_extension_filter": (
        lambda s, d: _paths(s, d).where(keys.has_suffix(F.col("path"))).groupBy(F.col("path").alias("path")).agg(F.count("*").alias("n")),
        rf"""SELECT path, count(*) AS n FROM ({_PATHS}) WHERE regexp_extract(path, '[^/](\.[^./]+)$', 1) IN ('.R', '.r', '.Rscript', '.py', '.ipynb', '.do') GROUP BY 1""",
    ),
    "f01_extension_filter_any_case": (
        lambda s, d: _paths(s, d).where(keys.has_suffix(F.col("path"), case_sensitive=False)).groupBy("n").agg(F.count("*").alias("files")),
        rf"""SELECT n, count(*) AS files FROM ({_PATHS}) WHERE lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) IN ('.r', '.rscript', '.py', '.ipynb', '.do') GROUP BY 1""",
    ),
    "s01_sorted_listing": (
        lambda s, d: _paths(s, d).where(keys.has_suffix(F.col("path"), "collection")).select("path").distinct().orderBy("path").limit(500),
        rf"""SELECT DISTINCT path FROM ({_PATHS}) WHERE regexp_extract(path, '[^/](\.[^./]+)$', 1) IN ('.R', '.py', '.do', '.Rscript', '.ipynb') ORDER BY path LIMIT 500""",
    ),
    "a02_repository_sets": (
        lambda s, d: ops.repo_sets(_r(s, d)).select("dataverse", "repo_id", F.array_join("packages", ",").alias("packages")),
        f"SELECT dataverse, repo_id, array_to_string(list_sort(list(DISTINCT package)), ',') AS packages FROM ({_R_ROWS}) WHERE dataverse IS NOT NULL AND repo_id IS NOT NULL GROUP BY 1, 2",
    ),
    "a03_totals": (
        lambda s, d: ops.totals(_r(s, d)),
        f"SELECT count(*) AS n_rows, count(DISTINCT package) AS n_packages, count(DISTINCT (dataverse, repo_id)) AS n_repositories, count(DISTINCT dataverse) + count(DISTINCT repo_id) AS n_keys FROM ({_R_ROWS})",
    ),
    "a04_language_frequency": (
        lambda s, d: ops.language_counts(ops.import_rows(c.frame(s, d, c.R_SCRIPTS).unionByName(c.frame(s, d, c.STATA_SCRIPTS)).unionByName(c.frame(s, d, c.PYTHON_SCRIPTS)))),
        f"SELECT 'R' AS language, count(*) AS count FROM ({_R_ROWS}) UNION ALL SELECT 'Stata', count(*) FROM ({_S_ROWS}) UNION ALL SELECT 'Python', count(*) FROM ({_PY_ROWS})",
    ),
    "a15_listed_frequencies": (
        lambda s, d: ops.listed_frequencies(ops.package_lists(_r(s, d)), "packages"),
        f"SELECT package, count(*) AS count FROM (SELECT DISTINCT repo_id, package FROM ({_R_ROWS}) WHERE repo_id IS NOT NULL) GROUP BY 1",
    ),
    "o02_top_packages": (
        lambda s, d: ops.ranked(ops.tally(_r(s, d)), 30),
        f"SELECT * FROM ({_TALLY.format(rows=_R_ROWS)}) ORDER BY count DESC, package LIMIT 30",
    ),
    "x_citation_rank": (lambda s, d: ops.with_citation_rank(ops.tally(_r(s, d))), f"SELECT package, count, rank() OVER (ORDER BY count DESC) AS citation_rank FROM ({_TALLY.format(rows=_R_ROWS)})"),
    "x_shared_packages": (
        lambda s, d: ops.shared_packages(_r(s, d).where("repo_id < 'R3'"), _r(s, d).where("repo_id >= 'R3'")),
        f"SELECT package FROM ({_R_ROWS}) WHERE repo_id < 'R3' INTERSECT SELECT package FROM ({_R_ROWS}) WHERE repo_id >= 'R3'",
    ),
}
