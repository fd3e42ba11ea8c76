"""Script corpora derived from the driver's tables, by SQL that Spark and DuckDB both read.

The tables hold no source code, so text is put together from their columns. Tables are named in braces; `frame` binds them to Parquet
files and `sql` to plain names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

R_SCRIPTS = """
SELECT '/scripts/' || n_name || '_datasets_files/R' || CAST(l_orderkey % 500 AS STRING) || '/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '.R' AS path,
  'library(' || replace(p_name, ' ', '.') || ')' || chr(10)
  || 'require("' || p_brand || '") # library(hidden' || CAST(p_size AS STRING) || ')' || chr(10)
  || 'if (!require(' || lower(p_type) || CAST(p_size % 3 AS STRING) || ', quietly = TRUE)) x <- "#"; y <- ' || lower(p_type) || '.pkg::run(x)' || chr(10)
  || 'p_load(tidy' || CAST(p_size % 7 AS STRING) || ', "q' || CAST(p_size % 5 AS STRING) || 'z", char_' || CAST(p_size AS STRING) || ')' || chr(10)
  || 'install_github("user/gh' || CAST(l_linenumber AS STRING) || '"); requireNamespace("ns' || CAST(l_linenumber % 4 AS STRING) || '"); base::f(1)' AS text
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
"""

STATA_SCRIPTS = """
SELECT '/scripts/' || n_name || '_datasets_files/S' || CAST(l_orderkey % 500 AS STRING) || '/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '.do' AS path,
  'ssc install pk' || CAST(p_size AS STRING) || ', replace // ssc install gone' || CAST(p_size AS STRING) || chr(10)
  || 'net install nt' || CAST(l_linenumber AS STRING) || ', from(https://x.org)' || chr(10)
  || '/* findit hidden' || chr(10) || 'which hidden */ findit fi' || CAST(p_size % 9 AS STRING) || chr(10)
  || 'which ' || CASE WHEN p_size % 2 = 0 THEN 'regress' ELSE 'cmd' || CAST(p_size AS STRING) END || chr(10)
  || 'quietly ' || CASE p_size % 5 WHEN 0 THEN 'esttab' WHEN 1 THEN 'xtivreg2' WHEN 2 THEN 'RD' WHEN 3 THEN 'outreg2' ELSE 'ttest' END || ' y x' || chr(10)
  || 'adopath + "lib/' || lower(p_type) || '"' AS text
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
"""

PYTHON_SCRIPTS = """
SELECT '/scripts/dataverse/P' || CAST(l_orderkey % 500 AS STRING) || '/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '.py' AS path,
  CASE WHEN p_size % 10 = 0 THEN 'this is (not python' || chr(10) ELSE '' END
  || 'import ' || lower(p_type) || '.sub' || CAST(p_size % 6 AS STRING) || chr(10)
  || 'from ' || replace(p_name, ' ', '_') || '.core import x' || chr(10)
  || 'def f():' || chr(10) || '    import os, json' || chr(10)
  || 'from . import sibling' AS text
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

PATHS = """
SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 8
    WHEN 0 THEN '/scripts/jop_datasets_files/D' || CAST(l_orderkey AS STRING) || '/a.R'
    WHEN 1 THEN '/outputs/scripts/dataverse/V' || CAST(l_orderkey AS STRING) || '/b.py'
    WHEN 2 THEN '/outputs/scripts/zenodo/' || CAST(l_orderkey AS STRING) || '/c.do'
    WHEN 3 THEN '/outputs/scripts/icpsr/' || CAST(l_orderkey AS STRING) || '/metadata/d.csv'
    WHEN 4 THEN '/out/osf/n' || CAST(l_orderkey AS STRING) || '/files/e.Rscript'
    WHEN 5 THEN '/out/ResearchBox_' || CAST(l_orderkey AS STRING) || '/extracted/f.ipynb'
    WHEN 6 THEN '/elsewhere/g.PY' ELSE '/no/suffix' END AS path
FROM {lineitem}
"""

STATUSES = """
SELECT event_id, 'repo' || CAST(user_id AS STRING) AS repo_id, CASE event_type WHEN 'click' THEN 'success' WHEN 'view' THEN 'success' WHEN 'purchase' THEN 'no_scripts' WHEN 'error' THEN 'error' ELSE 'forbidden' END AS status,
  CASE event_id % 4 WHEN 0 THEN 'HTTP 403' WHEN 1 THEN 'Page Not Found' WHEN 2 THEN 'read timeout' ELSE 'odd: ' || event_type END AS message, props
FROM {events}
"""

PROJECTS = """
SELECT 'p' || CAST(o_orderkey AS STRING) AS project_id, o_orderkey AS seq, 'Study ' || CAST(o_orderkey AS STRING) || ' of ' || c_name AS title,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'data, see https://doi.org/10.1234/j' || CAST(o_custkey % 40 AS STRING) || ' and text'
    WHEN 2 THEN 'two: 10.1234/j' || CAST(o_custkey % 40 AS STRING) || ' 10.55555/k' || CAST(o_orderkey % 30 AS STRING) || ' 10.1234/j' || CAST(o_custkey % 40 AS STRING)
    ELSE 'none 10.12/short' END AS description
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

#: Resolved DOIs, with gaps; (doi, journal, publisher).
DOI_JOURNALS = """
SELECT DISTINCT '10.1234/j' || CAST(o_custkey % 40 AS STRING) AS doi, 'Journal ' || CAST((o_custkey % 40) % 7 AS STRING) AS journal, 'Publisher ' || CAST((o_custkey % 40) % 3 AS STRING) AS publisher
FROM {orders} WHERE o_custkey % 40 < 35
"""

MENTIONS = """
SELECT c_custkey AS project_id, CASE c_custkey % 5
    WHEN 0 THEN 'Published in Journal of ' || c_mktsegment || ' Research, 2020'
    WHEN 1 THEN 'A note; econometrica, ' || n_name || ' and American Economic Review'
    WHEN 2 THEN 'proceedings of the ' || lower(c_mktsegment) || ' & society. PLOS one'
    WHEN 3 THEN 'nothing here' ELSE 'published in nejm; published in women''s studies quarterly.' END AS text
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

TREE = """SELECT p_partkey AS node_id, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent_id FROM {part}"""

LISTING = """
SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'https://doi.org/10.7910/DVN/K' || CAST(o_orderkey AS STRING) END AS url,
  '{{"data": {{"latestVersion": {{"files": [{{"dataFile": {{"id": ' || CAST(o_orderkey * 10 AS STRING) || ', "filename": "a' || CAST(o_orderkey % 20 AS STRING) || '.R"}}}}, {{"dataFile": {{"id": '
  || CAST(o_orderkey * 10 + 1 AS STRING) || ', "filename": "data.csv"}}}}, {{"dataFile": {{"id": ' || CAST(o_orderkey * 10 + 2 AS STRING) || '}}}}]}}}}}}' AS reply
FROM {orders}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def sql(template: str) -> str:
    """For DuckDB, whose views have the tables' names."""
    return template.format(**{t: t for t in TABLES})


#: What the corpora take from their largest table.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the one that scripts are made from is dealt out to all cores by four numbers a row, as a file may be a single row group, which one task reads."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*LINE).repartition(2 * spark.sparkContext.defaultParallelism) if name == "lineitem" else df


def frame(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """For Spark: tables are read from sf_dir."""
    used = sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", template)))
    text = template.replace("p_partkey // 2", "p_partkey div 2")
    return spark.sql(text, **{t: _table(spark, sf_dir, t) for t in used})
