"""Operators on small tables."""

import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from citemill.functions import keys, text
from citemill.operators import archives, imports, journals, statuses, tree
from citemill.plans import archive_queries
from citemill.sources import files, http, listings, services, sinks
from citemill.sources.settings import Settings
from citemill.streaming import incremental


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("path, source, repo, compat", [
    ("/s/jop_datasets_files/D1/a.R", "jop", "D1", ("jop", "D1")), ("/outputs/scripts/dataverse/V1/b.py", "dataverse", "V1", (None, None)), ("/outputs/zenodo/9/c.do", "zenodo", "9", ("zenodo", None)),
    ("/o/icpsr/7/d.R", "icpsr", "7", ("icpsr", None)), ("/o/osf/n1/files/e.R", "osf", "n1", (None, None)), ("/o/ResearchBox_12/extracted/f.R", "researchbox", "12", (None, None)), ("/x.R", None, None, (None, None)),
])
def test_repository_keys(spark, path, source, repo, compat):
    df = spark.createDataFrame([(path,)], "p string")
    p = F.col("p")
    assert (one(df, keys.source(p)), one(df, keys.repo_id(p))) == (source, repo)
    assert (one(df, keys.source(p, True)), one(df, keys.repo_id(p, True))) == compat


def test_languages_and_ids(spark):
    df = spark.createDataFrame([("/a/b.R",), ("x.RSCRIPT",), ("a.ipynb",), ("a.do",), ("a.csv",), (".R",), ("/a.b/c",)], "p string")
    assert [r[0] for r in df.select(keys.language(F.col("p"))).collect()] == ["R", "R", "Python", "Stata", None, None, None]
    assert one(df, keys.doi_tail(keys.normal_doi(F.lit("https://doi.org/10.7910/DVN/AB")))) == "AB"
    assert [one(df, keys.padded_id(F.lit(x))) for x in (7, 123456)] == ["00007", "123456"]


def test_tally_counts_a_package_once_per_repository(spark):
    rows = [("/s/a_datasets_files/R1/x.R", "library(dplyr)\nlibrary(MASS)"), ("/s/a_datasets_files/R1/y.R", "library(dplyr)"), ("/s/a_datasets_files/R2/z.r", "dplyr::f()"), ("/none/z.R", "library(lost)"), ("/s/a_datasets_files/R2/n.py", "import os"), ("/s/a_datasets_files/R2/t.txt", "library(no)")]
    found = imports.import_rows(spark.createDataFrame(rows, "path string, text string"))
    assert {r["package"]: r["count"] for r in imports.tally(found).collect()} == {"dplyr": 2, "MASS": 1, "os": 1}
    assert {(r["package"], r["classification"]) for r in found.collect()} >= {("MASS", "recommended"), ("os", "standard"), ("dplyr", "third-party")}
    assert imports.tally(found.union(found)).collect() == imports.tally(found).collect() or imports.tally(found.union(found)).count() == 3
    assert [(r["package"], r["citation_rank"]) for r in imports.with_citation_rank(imports.tally(found)).orderBy("citation_rank", "package").collect()] == [("dplyr", 1), ("MASS", 2), ("os", 2)]


def test_status_summary(spark):
    rows = [("a", "success", 4), ("b", "success", 0), ("c", "forbidden", None), ("d", "error", None), ("e", "connection_error", None)]
    df = spark.createDataFrame(rows, "repo_id string, status string, script_count long")
    s = statuses.summary(df).first()
    assert (s["total_repos"], s["successes"], s["success_rate"], s["total_scripts"], s["avg_scripts"]) == (5, 2, 40.0, 4, 2.0)
    assert statuses.summary(df.limit(0)).first()["success_rate"] == 0
    assert {r["repo_id"] for r in statuses.retryable(df).collect()} == {"c", "d"}
    assert "Success rate: 40.0%" in sinks.status_report(statuses.summary(df), statuses.by_status(df))
    details = df.withColumn("details", F.create_map(F.lit("identifier"), F.lit("doi:1"))).withColumn("timestamp", F.lit("t"))
    assert {r["doi"] for r in statuses.error_details(details).collect()} == {"doi:1"} and {r["doi"] for r in statuses.error_details(details, compat=True).collect()} == {None}
    assert {r["status"] for r in df.select(statuses.final_status(F.col("status"), F.col("script_count")).alias("status")).collect()} >= {"no_scripts"}


def test_error_status_and_text(spark):
    df = spark.range(1)
    assert [one(df, text.error_status(F.lit(m))) for m in ("HTTP 403", "Not Found", "Connection reset", "x", None)] == ["forbidden", "not_found", "connection_error", "error", "error"]
    assert one(df, text.dois(F.lit("see 10.1234/ab 10.1234/ab 10.12/no"), F.lit(None).cast("string"))) == ["10.1234/ab"]
    assert set(one(df, text.journal_names(F.lit("Published in Women's R&D Review, and nejm; neuroscience now")))) == {"Women'S R&D Review", "Science Now"}
    assert one(df, text.html_text(F.lit("<p>a &amp; <b>b</b></p>"))) == "a & b" and one(df, text.unlisted(F.lit("['a', 'b']"))) == "a', 'b"
    links = F.array(F.lit("/download/a.R"), F.lit("/x.rds"), F.lit("/b.py?x=1"))
    assert one(df, F.size(text.script_links(links))) == 2 and one(df, F.size(text.script_links(links, compat=True))) == 3 and one(df, text.download_count(links)) == 1
    assert one(df, text.page_author(F.lit("<p>Authors: A, B</p>"))) == "A, B"


def test_references_without_semicolon(spark):
    html = '<title>a &amp</title><script>"&amp"</script>&amp;&amp b&copy;&#39;&x; &lt'
    df = spark.createDataFrame([(html,), (None,)], "html string")
    assert [r[0] for r in df.select(text.html_text(F.col("html"))).collect()] == ['a &"&amp"&& b©\'&x; <', None]
    assert [r[0] for r in df.select(text.html_text(F.col("html"), strict=True)).collect()] == ['a &amp"&amp"&&amp b©\'&x; &lt', None]


def test_page_text_counts_as_its_sql(spark, tmp_path):
    query, sql = archive_queries.QUERIES["t13_page_text"]
    pages = [(1, "<title>R&amp</title><style>p{}</style><p>a &amp;&amp b</p><!-- &amp -->"), (2, '<script>var t="&lt";</script>&copy; x &lt'), (3, "plain")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(c.execute(sql).fetchall())


def test_journals(spark):
    known = spark.createDataFrame([("10.1234/a", "J1", "P1")], "doi string, journal string, publisher string")
    projects = spark.createDataFrame([("p1", 1, "t", "10.1234/a 10.9999/z"), ("p2", 2, "10.1234/a", None), ("p3", 3, "t", None)], "project_id string, seq long, title string, description string")
    found = journals.resolved(journals.doi_rows(journals.projects_with_dois(projects)), known)
    assert [tuple(r) for r in journals.journal_rollup(found).collect()] == [("J1", 2, 2, "P1")]
    s = journals.doi_summary(found).first()
    assert (s["journals"], s["projects"], s["resolved"], s["failed"]) == (1, 2, 2, 1) and [r[0] for r in journals.failed_dois(found).collect()] == ["10.9999/z"]
    c = spark.createDataFrame([("Review", None, [1, 2]), ("x", "the Press", [3]), ("y", None, [4])], "title string, description string, projects array<int>")
    assert tuple(journals.collection_summary(c).first()) == (3, 2, 3) and journals.journal_collections(c, 1).count() == 2


def test_tree(spark):
    edges = spark.createDataFrame([("r", None), ("c1", "r"), ("c2", "r"), ("g1", "c1"), ("other", None)], "node_id string, parent_id string")
    assert tree.node_count(edges, "r").first()["nodes"] == 4
    assert {r["node_id"] for r in tree.descendants(edges, "r").collect()} == {"c1", "c2", "g1"}
    assert tree.node_count(edges, "none").first()["nodes"] == 0 and tree.node_count(edges, "g1").first()["nodes"] == 1


def test_deep_trees_cycles_and_several_parents(spark):
    chain = [(i, i - 1) for i in range(1, 5001)] + [(0, 0), (9001, 9002), (9002, 9003), (9003, 9001), (9004, 9001), (9005, 777_777), (9006, None), (None, 0)]
    got = tree.closure(spark.createDataFrame(chain, "node_id long, parent_id long"), 0).collect()
    assert sorted((r["node_id"], r["depth"]) for r in got) == [(i, i) for i in range(5001)]
    graph = [("r", "z"), ("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("a", "d"), ("r", "d"), ("x", "y")]
    got = tree.closure(spark.createDataFrame(graph, "node_id string, parent_id string"), "r").collect()
    assert sorted((r["node_id"], r["depth"]) for r in got) == [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("r", 0)]


def _zip(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return b.getvalue()


def test_archives(spark):
    deep = _zip({"deep.R": "4"})
    for i in range(3, 0, -1):
        deep = _zip({f"l{i}.zip": deep, f"s{i}.py": str(i)})
    rows = [("good", _zip({"a/x.R": "1", "y.CSV": "2", "Z.DO": "3", "in.zip": deep, "bad.zip": b"PKno"})), ("none", _zip({"y.csv": "2"})), ("broken", b"PK\x03\x04oops"), ("null", None)]
    got = archives.extract(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r["member"] for r in got if r["archive"] == "good"} == {"a/x.R", "Z.DO", "in.zip!/s1.py", "in.zip!/l1.zip!/s2.py", "in.zip!/l1.zip!/l2.zip!/s3.py"}
    assert {r["archive"]: r["error"] for r in got if r["error"]}["none"] == "no_scripts"
    assert {r["archive"] for r in got if (r["error"] or "").startswith("extraction_failed")} == {"broken", "null"}


def test_connectors(spark, tmp_path):
    base = "https://zenodo.org/api/records?communities=c1"
    replies = {http.with_query(base, page=1, size=100): {"hits": {"hits": [{"id": 1}, {"id": 2}]}}, http.with_query(base, page=2, size=100): {"hits": {"hits": [{"id": 3}]}}}
    children = services.ENDPOINTS["children"]
    replies |= {children.format("r"): {"data": [{"id": "a"}], "links": {"next": "n2"}}, "n2": {"data": [{"id": "b"}], "links": {"next": None}}, children.format("a"): {"data": [{"id": "c"}]}}
    replies |= {services.ENDPOINTS["files"].format("r"): {"data": [{"relationships": {"files": {"links": {"related": {"href": "f"}}}}}]}, "f": {"data": [{"id": "x"}, {"id": "y"}]}}
    fetch = http.recorded_fetch(replies)
    assert [i["id"] for i in services.items(fetch, "community", "c1")] == [1, 2, 3] and [i["id"] for i in services.items(fetch, "community", "c1", 1)] == [1, 2]
    assert [i["id"] for i in services.descendants(fetch, "r")] == ["a", "b", "c"] and [i["id"] for i in services.items(fetch, "files", "r")] == ["x", "y"]
    (tmp_path / "rec.json").write_text(json.dumps(replies))
    spark.dataSource.register(services.Service)
    rows = spark.read.format("repository_service").options(kind="community", seeds="c1,none", recordings=str(tmp_path / "rec.json")).load().collect()
    assert [(r["seed"], json.loads(r["item"])["id"]) for r in rows] == [("c1", 1), ("c1", 2), ("c1", 3)]
    reply = json.dumps({"message": {"container-title": ["J"], "author": [{"given": "A", "family": "B"}], "published-online": {"date-parts": [[2020, 1]]}}})
    r = listings.crossref(spark.createDataFrame([("https://doi.org/10.1/x", reply)], "d string, r string"), "d", "r").first()
    assert (r["doi"], r["journal"], r["publisher"], r["publication_year"], r["authors"]) == ("10.1/x", "J", "Unknown", 2020, ["A B"])
    nodes = json.dumps({"data": [{"id": "1", "attributes": {"title": "t", "kind": "file"}}]})
    assert listings.nodes(spark.createDataFrame([(nodes,)], "r string"), "r").first()["attributes"]["kind"] == "file"


def test_files_and_sinks(spark, tmp_path):
    d = tmp_path / "s" / "zenodo" / "5"
    d.mkdir(parents=True)
    (d / "a.R").write_bytes("library(été)\r\nx".encode("latin-1"))
    (d / "b.PY").write_text("import os")
    (d / ".status").write_text(json.dumps({"status": "success", "timestamp": "t", "details": {"script_count": "2"}}))
    got = files.scripts(spark, str(tmp_path / "s")).collect()
    assert [r["text"] for r in got] == ["library(été)\nx"] and files.file_list(spark, str(tmp_path / "s"), case_sensitive=False).count() == 2
    assert files.status_files(spark, str(tmp_path / "s")).first()["repo_id"] == "5"
    sinks.write_csv(spark.range(3), str(tmp_path / "out"), single=True)
    assert files.table(spark, str(tmp_path / "out")).count() == 3
    assert json.loads(sinks.json_document(spark.range(1)))["id"] == 0
    (tmp_path / "seeds.csv").write_text("id,name,dataverse_id\n1,a,x\n2,b,x\n3,c,\n")
    assert [r[0] for r in files.seeds(spark, str(tmp_path / "seeds.csv")).collect()] == ["x"]
    (tmp_path / "bad.csv").write_text("id\n1\n")
    with pytest.raises(ValueError):
        files.seeds(spark, str(tmp_path / "bad.csv"))
    sinks.pack_folder(str(d), str(tmp_path / "a.tar.gz"))
    sinks.unpack_folder(str(tmp_path / "a.tar.gz"), str(tmp_path / "un"))
    assert (tmp_path / "un" / "5" / "a.R").exists()


def test_settings():
    s = Settings({"osf": {"delay": 2}})
    assert s.get("osf.delay") == 2 and s.get("osf.page_size") == 100 and s.get("no.such", 5) == 5
    s.set("a.b", 1)
    assert s.get("a.b") == 1


def test_incremental_tally_equals_the_batch(spark, tmp_path):
    rows = [(f"/s/a_datasets_files/R{i % 4}/{i}.R", f"library(p{i % 3}1)\nlibrary(q{i})") for i in range(20)]
    schema = "path string, text string"
    places = [str(tmp_path / x) for x in ("landing", "state", "checkpoint")]
    for part in (rows[:8], rows[5:15], rows[15:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(places[0])
        got = incremental.incremental_tally(spark, *places)
    want = imports.tally(imports.import_rows(spark.createDataFrame(rows, schema)))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    query = incremental.streaming_tally(spark.readStream.schema(schema).parquet(places[0])).writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("t").collect()} == {tuple(r) for r in want.collect()}


def test_resume_skips_what_is_done(spark, tmp_path):
    todo, seen = spark.createDataFrame([("a",), ("b",)], "repo_id string"), []

    def work(left):
        seen.append(sorted(r[0] for r in left.collect()))
        return left.withColumn("status", F.lit("success"))

    for _ in range(2):
        incremental.resume(spark, todo, str(tmp_path / "done"), work)
    assert seen == [["a", "b"], []]


def test_commands(spark, tmp_path, capsys):
    from citemill.__main__ import main

    d = tmp_path / "in" / "zenodo" / "5"
    d.mkdir(parents=True)
    (d / "a.R").write_text("library(dplyr)\nlibrary(readr)")
    (d / "b.zip").write_bytes(_zip({"x.R": "1"}))
    (d / ".status").write_text(json.dumps({"status": "error", "timestamp": "t", "details": {}}))
    assert main(["tally", str(tmp_path / "in"), str(tmp_path / "out"), "--languages", "R"]) == 0
    assert "1  dplyr" in capsys.readouterr().out
    main(["status", str(tmp_path / "in")])
    main(["status", str(tmp_path / "in"), "--retryable"])
    assert "error 5" in capsys.readouterr().out
    main(["extract", str(tmp_path / "in"), str(tmp_path / "ex")])
    main(["classes", "R", "MASS", "dplyr"])
    out = capsys.readouterr().out
    assert "extracted" in out and "MASS recommended" in out


def test_requests_that_cannot_be_made_give_nothing():
    assert http.http_reply("https://example.org/a b", retries=0) is None and http.http_reply("no address", retries=0) is None and http.http_reply("http://127.0.0.1:9/", retries=0, timeout=1) is None
    assert services.address("search", "a b&c") == "https://api.osf.io/v2/search/?q=a%20b%26c"
    assert services.address("dataset", "doi:10.7910/DVN/X") == "https://dataverse.harvard.edu/api/datasets/:persistentId/?persistentId=doi:10.7910/DVN/X"
    assert services.address("institution", "cos", {"public": "true"}) == "https://api.osf.io/v2/institutions/cos/nodes/?filter%5Bpublic%5D=true"


def test_boxes(spark, tmp_path):
    page = "<title>Box</title> Authors: A <a href='/download/a.R'>x</a>"
    recordings = {f"HEAD {services.BOX_ARCHIVE.format(i)}": {"Content-Length": "1000000", "Last-Modified": "Mon"} for i in (1, 15, 17)} | {services.BOX_PAGE.format(1): page}
    (tmp_path / "rec.json").write_text(json.dumps(recordings))
    spark.dataSource.register(services.Service)
    rows = spark.read.format("repository_service").options(kind="box", seeds=services.box_ids(1, 20), recordings=str(tmp_path / "rec.json")).load().collect()
    found = {r["seed"]: json.loads(r["item"]) for r in rows}
    assert sorted(found, key=int) == ["1", "15", "17"] and found["1"]["zip_size"] == 1_000_000 and found["1"]["last_modified"] == "Mon"
    assert found["15"]["html"] is None and one(spark.createDataFrame([(found["1"]["html"],)], "h string"), text.page_title(F.col("h"))) == "Box"


def test_archive_runs(spark):
    rows = [("good", _zip({"a.R": "1", "b.csv": "2"})), ("data", _zip({"b.csv": "2"})), ("void", _zip({})), ("broken", b"PKno"), ("null", None)]
    found = archives.outcomes(spark.createDataFrame(rows, "path string, content binary"))
    steps = {r["archive"]: (r["status"], r["step"], r["tries"]) for r in archives.next_step(found).collect()}
    assert steps["good"] == ("success", "delete", 1) and steps["data"] == ("no_scripts", "delete", 1) and steps["void"] == ("no_scripts", "keep", 1)
    assert steps["broken"] == steps["null"] == ("extraction_failed", "quarantine", 3)
    assert {r["step"] for r in archives.next_step(found, keep=True, preserve=False).where("status = 'extraction_failed'").collect()} == {"delete"}
    assert {r["step"] for r in archives.next_step(found, safe=False).where("archive = 'void'").collect()} == {"delete"}
    assert [r["archive"] for r in archives.recovered(spark.createDataFrame([rows[0], rows[3]], "path string, content binary")).collect()] == ["good"]


def test_missing_folder_room_and_local_modules(spark, tmp_path):
    from citemill.functions import classify
    from citemill.functions.python_imports import dotted_names

    assert files.file_list(spark, str(tmp_path / "none")).count() == files.scripts(spark, str(tmp_path / "none")).count() == files.archives(spark, str(tmp_path / "none")).count() == 0
    assert files.free_bytes(spark, str(tmp_path)) > 0 and not files.has_room(spark, str(tmp_path), 1e9)
    df = spark.createDataFrame([("helpers.plots", ["helpers"]), ("os.path", ["os"]), ("numpy", None)], "m string, own array<string>")
    assert [r[0] for r in df.select(classify.python_class(F.col("m"), F.col("own"))).collect()] == ["local", "standard", "third-party"]
    assert [one(spark.createDataFrame([(p,)], "p string"), classify.module_name(F.col("p"))) for p in ("/a/helpers.py", "/a/pkg/__init__.py", "/a/x.R")] == ["helpers", "pkg", None]
    assert dotted_names("import a.b, c\nfrom d.e import f\nfrom . import g") == ["a.b", "c", "d.e", None] and dotted_names("no (python") == []


def test_journal_details_and_samples(spark):
    found = spark.createDataFrame([("p1", 1, 0, "d1", "J", "P1", ["1"]), ("p1", 1, 1, "d1", "J", "P2", None), ("p2", 2, 0, "d2", "J", "P3", ["2"]), ("p3", 3, 0, "d9", None, None, None)], "project_id string, seq long, place int, doi string, journal string, publisher string, issn array<string>")
    r = journals.journal_details(found, "issn").first()
    assert (r["journal"], r["publisher"], r["issn"], r["projects"], r["project_count"], r["dois"]) == ("J", "P1", ["1"], ["p1", "p2"], 2, ["d1", "d1", "d2"])
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "key string, seq long")
    assert [x["key"] for x in journals.sampled(rows, "key", "seq", 2).collect()] == ["a", "b"] and journals.sampled(rows, "key", "seq").count() == 3


def test_windowed_statuses(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 03:00:00", "b")]
    spark.createDataFrame(rows, "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = incremental.windowed_statuses(stream).writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["n"]) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]
