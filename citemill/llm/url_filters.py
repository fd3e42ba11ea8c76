"""URL filters: path and host rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is split into blocks of 256 bits, eight words of 32 bits; an entry sets one bit in each word of one block, so a
probe touches a single row of the block table. URLs that the filter lets through are possible hits and go on to an
exact hash join with the list, which takes out its false positives; the rest never reach that join.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule, and gets ``default_verdict``
unless its canonical form is listed (null never is). Repeated rows stay repeated; ties between rules can't occur, as rules of equal length that fit one URL are equal. An empty list blocks nothing. Very long URLs are judged whole. An empty table gives no rows.
Extra columns pass through; columns of the result replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import materialized, table

#: (verdict, host, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: One odd multiplier for each word of a block; they pick the bit.
SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
BITS_PER_ENTRY = 16
#: A block row takes about 64 bytes in a broadcast; a filter up to this many blocks is broadcast, a larger one is joined by block number.
MAX_BROADCAST_BLOCKS = 250_000
#: Up to so many listed URLs that occur are broadcast, so that no page moves; with more, a URL that many pages have is left to the skew join.
MAX_BROADCAST_HITS = 250_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www., path without index page, .html or closing slash; scheme, query and fragment dropped. Null without "://"."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*\z", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null without one. A rule fits its host and all subdomains."""
    fitting = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    if not fitting:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return F.greatest(*fitting, F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))


def _bit(hashed: Column, salt: int) -> Column:
    """Five bits of 31 bits of the hash times a salt; the product stays below 2 ** 62, so it can't overflow."""
    low = hashed.bitwiseAND(F.lit(0x7FFFFFFF))
    return F.shiftrightunsigned((low * F.lit(salt)).bitwiseAND(F.lit(0x7FFFFFFF)), 26).cast("int")


def _words(hashed: Column) -> list[Column]:
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(hashed, s)).alias(f"w{i}") for i, s in enumerate(SALTS)]


def blocks_for(n_entries: int) -> int:
    return max(1, -(-n_entries * BITS_PER_ENTRY // 256))


def bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter of a list: (block, w0..w7), one row for each block in use. Merged map-side, so a hot block moves once a task."""
    h = F.xxhash64(F.col(key))
    return (
        listed.where(F.col(key).isNotNull())
        .select(F.pmod(F.shiftright(h, 32), F.lit(n_blocks)).alias("block"), *_words(h))
        .groupBy("block")
        .agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(SALTS))))
    )


def possible_hits(rows: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows whose key may be in the list: all that are, and a few that aren't."""
    h = F.xxhash64(F.col(key))
    probe = rows.where(F.col(key).isNotNull()).withColumn("_block", F.pmod(F.shiftright(h, 32), F.lit(n_blocks)))
    side = F.broadcast(blocks) if n_blocks <= MAX_BROADCAST_BLOCKS else blocks
    test = F.lit(True)
    for i, w in enumerate(_words(h)):
        test = test & (F.col(f"w{i}").bitwiseAND(w) != 0)
    return probe.join(side, (probe["_block"] == side["block"]) & test, "left_semi").drop("_block")


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", default_verdict: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every page. listed: one string column of canonical URLs."""
    key = listed.columns[0]
    listing = listed.select(F.col(key).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    n_blocks = blocks_for(listing.count())
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    # a URL is judged once however many pages repeat it, which takes the heat out of a hot key
    forms = urls.select(canonical(F.col("url")).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    hits = materialized(possible_hits(forms, "_url", bloom(listing, "_url", n_blocks), n_blocks).join(listing, "_url", "left_semi"))
    few = hits.count() <= MAX_BROADCAST_HITS
    urls = urls.withColumn("_url", canonical(F.col("url")))
    known = urls.where(F.col("_url").isNotNull()).join((F.broadcast(hits) if few else hits).withColumn("_hit", F.lit(True)), "_url", "left")
    judged = known.select("page_id", "url", "_hit").union(urls.where(F.col("_url").isNull()).select("page_id", "url", F.lit(None).cast("boolean")))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = judged.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("_hit", F.lit(False)).alias("listed"))
    out = out.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    return out.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit(default_verdict))).alias("verdict"), "listed",
    )


def recrawled(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The list of the query: canonical URLs that more than one page row has, under whatever spelling."""
    return pages.select(canonical(F.col(url_col)).alias("listed_url")).where(F.col("listed_url").isNotNull()).groupBy("listed_url").count().where("count > 1").select("listed_url")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, recrawled(pages))


SQL = r"""
WITH p AS (
  SELECT page_id, url, strpos(coalesce(url, ''), '://') > 0 AS ok,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (SELECT page_id, ok, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (SELECT *, CASE WHEN ok THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/index)?(\.html?)?/*$', '') END AS form FROM q),
l AS (SELECT form FROM c WHERE form IS NOT NULL GROUP BY form HAVING count(*) > 1),
r(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT c.page_id, c.host, c.path, l.form IS NOT NULL AS listed,
             CASE WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS r1,
             CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/' END AS r2,
             CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1' END AS r3,
             CASE WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/' END AS r4,
             CASE WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' END AS r5
      FROM c LEFT JOIN l ON c.form = l.form),
g AS (SELECT page_id, host, path, listed, coalesce(r3, r2, r4, r5, r1) AS rule FROM f)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT r.verdict FROM r WHERE r.h || r.pre = rule) WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM g
"""
