"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0) on a text. Documents with the same votes form one pattern, and the
counts of the patterns (at most 3 to the number of rules, whatever the corpus) are all that expectation-maximisation
needs: it estimates how often each rule votes each way on good and on bad documents and how common good ones are, and
gives every pattern a posterior probability of good. That replaces the conjunction of all filters: one bad vote of a
rule that is often wrong doesn't lose a document. Patterns are counted over all documents.

Defined cases: null text has no words, as the empty text; all its counts are 0, base_failed is true (below 50 words).
Repeated rows stay repeated, ties don't occur (a pattern has one posterior). An empty table gives no rows. Columns of
the input other than the id and the text aren't read, so clashing names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import SPACE_CHARS, materialized, table, words

SYMBOLS = "#*$%&|<>"
#: ASCII characters of words that are no letters.
NO_LETTERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MIN_WORDS = 50
ROUNDS = 50
#: What the estimation starts from: the share of good documents, and how often a rule votes good, abstains or votes bad on good documents and on bad ones. A bad vote is rare on a good document; a good vote says little, as most rules find nothing wrong with most junk.
START_GOOD = 0.7
START_VOTES = {True: {1: 0.78, 0: 0.20, -1: 0.02}, False: {1: 0.65, 0: 0.05, -1: 0.30}}


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_stopped, n_lines, n_symbol_words, n_letters)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != ""))
    # three-word windows as (hash, place); equal windows come together in sorted order
    windows = F.when(
        F.size("w") >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.withColumn("g", windows)
    d = d.withColumn("g", F.transform(
        F.filter("g", lambda x, k: (F.get("g", k - 1)["h"] == x["h"]) | F.coalesce(F.get("g", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"],
    ))
    d = d.withColumn("g", F.sort_array("g"))
    covered = F.aggregate(F.transform("g", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("g", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    n = lambda c: c.cast("long")
    return d.select(
        "doc_id", n(F.size("w")).alias("n_words"), n(F.length(F.translate("text", SPACE_CHARS, ""))).alias("word_chars"),
        n(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), n(covered).alias("n_repeat_words"),
        n(F.size(F.array_distinct("w"))).alias("n_distinct"), n(F.size(F.filter("w", lambda x: x.rlike(r"[.!?]$")))).alias("n_stopped"), n(F.size("lines")).alias("n_lines"),
        n(F.size(F.filter("w", lambda x: F.translate(x, SYMBOLS, "") != x))).alias("n_symbol_words"), n(F.length(F.translate("text", SPACE_CHARS + NO_LETTERS, ""))).alias("n_letters"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    """Bad wins; between the two bounds the rule abstains."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules over base_counts()."""
    c = F.col
    return {
        "length": _vote(c("n_words") < MIN_WORDS, c("n_words") >= 100),
        "word_size": _vote((c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")), (10 * c("word_chars")).between(35 * c("n_words"), 90 * c("n_words"))),
        "symbols": _vote(10 * c("n_symbols") > c("n_words"), 100 * c("n_symbols") <= c("n_words")),
        "symbol_words": _vote(10 * c("n_symbol_words") > c("n_words"), 100 * c("n_symbol_words") <= c("n_words")),
        "letters": _vote(100 * c("n_letters") < 88 * c("word_chars"), 100 * c("n_letters") >= 93 * c("word_chars")),
        "dup_lines": _vote(10 * c("n_dup_lines") > 3 * c("n_lines"), c("n_dup_lines") == 0),
        "repeats": _vote(100 * c("n_repeat_words") > 30 * c("n_words"), 100 * c("n_repeat_words") <= 10 * c("n_words")),
        "variety": _vote((c("n_words") >= 20) & (100 * c("n_distinct") < 20 * c("n_words")), 100 * c("n_distinct") >= 35 * c("n_words")),
        "sentences": _vote((c("n_words") >= 60) & (c("n_stopped") == 0), 60 * c("n_stopped") >= c("n_words")),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict], list[float]]:
    """Expectation-maximisation over the counted patterns: the share of good documents, for each rule the probability of each vote given good (True) and bad (False), and the posterior of each pattern.

    Votes are taken as independent given the class, abstaining included. One pseudo-count keeps every probability above 0.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    flat = {v: 1 / 3 for v in (-1, 0, 1)}
    good = START_GOOD
    told = [{cls: dict(by_vote) for cls, by_vote in START_VOTES.items()} for _ in range(n_rules)]
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for votes_, _n in patterns:
            odds = math.log(good) - math.log1p(-good) + sum(math.log(t[True][v]) - math.log(t[False][v]) for t, v in zip(told, votes_, strict=True))
            posterior.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
        total = sum(n for _, n in patterns)
        mass = sum(p * n for p, (_, n) in zip(posterior, patterns, strict=True))
        good = (mass + 1) / (total + 2)
        for j, t in enumerate(told):
            for cls, whole in ((True, mass), (False, total - mass)):
                for v in flat:
                    own = sum((p if cls else 1 - p) * n for p, (votes_, n) in zip(posterior, patterns, strict=True) if votes_[j] == v)
                    t[cls][v] = (own + flat[v]) / (whole + 1)
    return good, told, posterior


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, votes, quality, base_failed, kept)."""
    rules = votes()
    counted = materialized(
        base_counts(docs, id_col, text_col).withColumn("votes", F.array(*(v.cast("int") for v in rules.values())))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes")
    )
    patterns = [(tuple(r["votes"]), r["count"]) for r in counted.groupBy("votes").count().orderBy("votes").collect()]  # 3 ** len(rules) rows at most
    _, _, posterior = estimate(patterns, rounds)
    told = docs.sparkSession.createDataFrame([(list(v), p) for (v, _), p in zip(patterns, posterior, strict=True)], "votes array<int>, quality double")
    return counted.join(F.broadcast(told), "votes", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"),
    )
