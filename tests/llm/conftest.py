import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ["text_", "_rank", "node", "part", "w", "score", "key", "length", "_h", "component_id", "votes", "host"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns whose names clash with helpers."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "lone", "de", "b"), (5, "lone", "de", "b"), (5, "lone", "de", "b"),
        (6, "word " * 30_000, "en", None), (7, base, "en", "a"), (8, base + " thirteen", "en", "a"), (9, base.upper(), "en", "b"),
        (10, "日本語 テキスト 123 !!! ### $$$", None, "b"), (11, "x" * 200_000, "en", "a"), (12, "a\n\na\na\n", "fr", "a"), (None, base, None, None), (13, "<|im_end|><|endoftext|> \\ <\\| end", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """The odd table as a folder of tables, for the registered queries."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 14)] + [(4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    chats = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, None, "x"), (None, None, "user", ""), (3, 0, "assistant", "a<|im_end|>\n<\\|im"), (3, 1, "us\ner<n", "<" * 5)]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).write.parquet(f"{d}/conversations.parquet")
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.ORG"), (6, "http://a.org/x?y://z"), (6, "http://a.org/x"), (7, "http://sub.EXAMPLE.org/en/12#f"), (8, "https://example.com/de/" + "p" * 5000), (9, "http://xexample.org/es/"), (None, "http://www.b.net/q.html"), (10, "https://b.net/q")]
    spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("html", F.lit("")).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "conversations", "pages"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
