"""Files that tasks write, sessions over HTTP, run counters, tree documents, and the commands that use them."""

import http.server
import json
import threading
import urllib.parse

import pytest

from citemill.operators import archives, statuses, tree
from citemill.sources import files, http as asking, listings, storage

ROWS = "repo_id string, name string, url string"


@pytest.fixture
def site():
    """A server on this machine: a form, a file for those who are logged in, one that breaks off at the first try."""
    tries = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            ok = form.get("password") == ["p"]
            self.send_response(200 if ok else 403)
            if ok:
                self.send_header("Set-Cookie", "who=me")
            self.end_headers()
            self.wfile.write(json.dumps(form).encode())

        def do_GET(self):
            tries[self.path] = tries.get(self.path, 0) + 1
            if self.path == "/mine" and "who=me" not in self.headers.get("Cookie", ""):
                self.send_response(403)
                self.end_headers()
                return
            body = b"x" * 3000
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body[:1000] if self.path == "/weak" and tries[self.path] == 1 else body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_downloads_skip_what_is_there(spark, tmp_path):
    wanted = [("R1", "a.R", "u1"), ("R1", "a.R", "u1"), ("R1", "d/b.R", "u2"), ("R2", "c.R", "gone"), ("R2", "../c.R", "u1"), ("R3", None, "u1"), ("R3", "x.R", None)]
    copier = storage.from_recordings({"u1": "one", "u2": "zwei ü"})

    def run(**how):
        rows = storage.downloaded(spark.createDataFrame(wanted, ROWS), str(tmp_path), copier, **how).collect()
        return {(r["repo_id"], r["name"]): (r["status"], r["size"]) for r in rows}

    first = run()
    assert first == {("R1", "a.R"): ("success", 3), ("R1", "d/b.R"): ("success", 7), ("R2", "c.R"): ("failed", None), ("R2", "../c.R"): ("failed", None), ("R3", None): ("failed", None), ("R3", "x.R"): ("failed", None)}
    (tmp_path / "R1" / "a.R").write_text("mine")
    assert run()[("R1", "a.R")] == ("exists", 4) and (tmp_path / "R1" / "a.R").read_text() == "mine"
    assert run(force=True)[("R1", "a.R")] == ("success", 3) and (tmp_path / "R1" / "a.R").read_text() == "one"
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["R1/a.R", "R1/d/b.R"]
    assert storage.downloaded(spark.createDataFrame([], ROWS), str(tmp_path), copier).count() == 0


def test_sessions_and_replies_that_break_off(spark, site, tmp_path):
    wanted = spark.createDataFrame([("R", "mine", f"{site}/mine"), ("R", "weak", f"{site}/weak")], ROWS).coalesce(1)

    def run(folder, **how):
        return {r["name"]: (r["status"], r["size"]) for r in storage.downloaded(wanted, f"{tmp_path}/{folder}", storage.over_http(delay=0, **how)).collect()}

    assert run("a") == {"mine": ("failed", None), "weak": ("success", 3000)}
    assert run("b", login=(f"{site}/login", {"password": "p"})) == {"mine": ("success", 3000), "weak": ("success", 3000)}
    assert run("c", login=(f"{site}/login", {"password": "no"})) == {"mine": ("failed", None), "weak": ("failed", None)}
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["mine", "weak", "weak"]
    assert asking.http_post(f"{site}/form", {"password": "p"}) == {"password": ["p"]} and asking.http_post(f"{site}/form", {"password": "q"}) is None


def test_markers_are_read_back(spark, tmp_path):
    rows = [("5", "success", "t1", {"script_count": "3"}), ("z/6", "error", "t2", None), ("../7", "error", "t3", None)]
    written = storage.write_markers(spark.createDataFrame(rows, "repo_id string, status string, timestamp string, details map<string,string>"), str(tmp_path / "s")).collect()
    assert {r["repo_id"]: r["path"] is not None for r in written} == {"5": True, "z/6": True, "../7": False}
    assert {(r["repo_id"], r["status"], (r["details"] or {}).get("script_count")) for r in files.status_files(spark, str(tmp_path / "s")).collect()} == {("5", "success", "3"), ("6", "error", None)}


def test_copies_and_removals(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "x.R").write_text("1")
    paths = [(f"{tmp_path}/in/d/x.R",), (f"{tmp_path}/in/none.R",), ("/elsewhere/x.R",), (None,)]
    got = {r["path"]: r["to"] for r in storage.copied(spark.createDataFrame(paths, "path string"), f"{tmp_path}/in/", f"{tmp_path}/out").collect()}
    assert got == {paths[0][0]: f"{tmp_path}/out/d/x.R", paths[1][0]: None, paths[2][0]: None, None: None} and (tmp_path / "out" / "d" / "x.R").read_text() == "1"
    assert storage.removed(f"{tmp_path}/out") and not (tmp_path / "out").exists() and not storage.removed(f"{tmp_path}/out")
    assert storage.made(f"{tmp_path}/e/f") and (tmp_path / "e" / "f").is_dir()


def test_progress(spark, tmp_path):
    rows = spark.createDataFrame([(None, 2, 2**20), (None, 0, 2**20), ("bad", 9, None)], "error string, scripts int, size long")
    want = {"processed": 3, "successful": 2, "failed": 1, "total_scripts": 2, "total_bytes": 2**21}
    assert statuses.progress(rows, 4).first().asDict() == want | {"percent": 75.0} and statuses.progress(rows.limit(0)).first()["percent"] is None
    same, seen = statuses.observed(rows)
    same.write.parquet(f"{tmp_path}/o")
    assert seen.get == want and statuses.progress_line("archives", seen.get) == "Completed archives - 2/3 successful - 1 failed - 2 scripts - 2.0 MB"
    errors = spark.createDataFrame([(1, None), (2, "e")], "box_id int, error string")
    assert [tuple(r) for r in statuses.run_errors(errors).collect()] == [(2, "e")]


def test_flat_members(spark):
    rows = [("z", "a/x.R", 0), ("z", "b/x.R", 0), ("z", "in.zip!/x.R", 1), ("z", "c\\y.R", 0), ("w", "x.R", 0), ("v", None, None)]
    found = archives.flattened(spark.createDataFrame(rows, "archive string, member string, depth int")).collect()
    assert {(r["archive"], r["name"], r["member"]) for r in found} == {("z", "x.R", "a/x.R"), ("z", "y.R", "c\\y.R"), ("w", "x.R", "x.R")}


def test_tree_documents(spark):
    edges = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("c", "b"), ("lost", "x")], "node_id string, parent_id string")
    nodes = spark.createDataFrame([("r", "nodes", '{"title": "t\\""}'), ("a", "nodes", None)], "node_id string, type string, attributes string")
    held = spark.createDataFrame([("c", '{"name": "2"}', 2), ("c", '{"name": "1"}', 1)], "node_id string, file string, order int")
    row = tree.documents(nodes, edges, "r", held).first()
    c = {"id": "c", "type": None, "attributes": {}, "children": [], "files": [{"name": "1"}, {"name": "2"}]}
    a, b = {"id": "a", "type": "nodes", "attributes": {}, "children": [c], "files": []}, {"id": "b", "type": None, "attributes": {}, "children": [], "files": []}
    assert (row["root"], json.loads(row["document"])) == ("r", {"id": "r", "type": "nodes", "attributes": {"title": 't"'}, "children": [a, b], "files": []})
    assert tree.documents(nodes, edges, "none").count() == 0


def test_requests_of_nodes(spark):
    shape = "node string, attributes struct<kind:string,name:string>, links struct<download:string>"
    rows = [("n", ("file", "a.R"), ("u",)), ("n", ("file", None), ("v",)), ("n", ("folder", "d"), ("w",)), ("n", ("file", "x"), (None,))]
    assert [tuple(r) for r in listings.node_requests(spark.createDataFrame(rows, shape), "node").collect()] == [("n", "files/a.R", "u"), ("n", "files/unknown", "v")]


def test_collect_download_recover(spark, tmp_path, capsys):
    from citemill.__main__ import main
    from citemill.sources import services

    seed = "doi:10.7910/DVN/X"
    reply = {"data": {"latestVersion": {"files": [{"dataFile": {"id": 7, "filename": "a.R"}}, {"dataFile": {"id": 8, "filename": "d.csv"}}]}}}
    (tmp_path / "rec.json").write_text(json.dumps({services.address("dataset", seed): reply, f"{listings.FILE_URL}7": "library(dplyr)"}))
    given = ["--recordings", str(tmp_path / "rec.json")]
    main(["collect", "dataset", str(tmp_path / "items"), seed, *given])
    main(["collect", "dataset", str(tmp_path / "items"), seed, *given])
    assert "exists" in capsys.readouterr().out
    main(["download", str(tmp_path / "items"), str(tmp_path / "got"), "--least-gb", "0", *given])
    assert "1/1 successful" in capsys.readouterr().out
    assert [p.read_text() for p in (tmp_path / "got" / "files").rglob("a.R")] == ["library(dplyr)"]
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "b.zip").write_bytes(b"PK no")
    main(["extract", str(tmp_path / "zips"), str(tmp_path / "ex")])
    import zipfile

    with zipfile.ZipFile(tmp_path / "zips" / "b.zip", "w") as z:
        z.writestr("x.R", "1")
    main(["recover", str(tmp_path / "zips"), str(tmp_path / "ex")])
    assert "recovered 1" in capsys.readouterr().out
