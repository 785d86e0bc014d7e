"""The data source of repositories against a host on this machine."""

import json
import threading
import urllib.error
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.segments import SegmentStore
from corpusloom.sources import repository
from corpusloom.sources.repository_source import FilesReader, RepositorySource, _Where, register
from corpusloom.streaming.ingest import index_stream
from test_segments import same

ADDRESS = "https://github.com/acme/tool"


class Host:
    """A host with commits of files; ``fails`` holds the codes that a path's next requests get."""

    def __init__(self):
        self.commits, self.head, self.asked, self.fails, own = {}, "", Counter(), {}, self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                code, body, path = own.answer(unquote(self.path.partition("?")[0]))
                self.send_response(code)
                if code == 429:
                    self.send_header("Retry-After", "0")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.root = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def commit(self, name, files):
        self.commits[name], self.head = files, name

    def answer(self, path):
        kind, *parts = path.strip("/").split("/")
        if kind == "repos":
            what, ref = (parts[2:] + [""])[0], parts[-1]
            if what == "commits":
                return 200, json.dumps({"sha": self.head}).encode(), path
            if what == "git":
                files = self.commits[self.head if ref == "main" else ref]
                return 200, json.dumps({"tree": [{"path": p, "type": "blob", "size": len(c.encode()), "sha": str(hash(c))} for p, c in files.items()]}).encode(), path
            return 200, json.dumps({"default_branch": "main"}).encode(), path
        ref, name = parts[2], "/".join(parts[3:])
        self.asked[name] += 1
        if self.fails.get(name):
            return self.fails[name].pop(0), b"", path
        text = self.commits[self.head if ref == "main" else ref].get(name)
        return (404, b"", path) if text is None else (200, text.encode(), path)


@pytest.fixture()
def host():
    made = Host()
    yield made
    made.server.shutdown()


def options(host, **more):
    return {"api": host.root, "raw": f"{host.root}/raw", "pause": "0.01", **more}


FILES = {f"src/m{k}.py": f"import m{k + 1}\n\ndef f{k}():\n    return 'größe {k}'\n" for k in range(12)} | {"docs/read.md": "# Title\n\nSome words.\n", "node/node_modules/x.js": "var a = 1; var b;", "a.bin": "0123456789"}


def test_files_are_read_with_pushed_filters_and_limits(spark, host):
    register(spark)
    host.commit("c1", FILES)
    read = lambda **more: spark.read.format("repository").options(**options(host, **more)).load(ADDRESS)
    found = {r["path"]: r for r in read().collect()}
    assert {p: r["content"] for p, r in found.items()} == {p: c for p, c in FILES.items() if p.endswith((".py", ".md"))}
    assert found["docs/read.md"]["file_type"] == "md" and found["docs/read.md"]["raw_url"] == f"{host.root}/raw/acme/tool/main/docs/read.md"
    assert read(partitions="4").rdd.getNumPartitions() == 4 and read(most="5").count() == 5
    for condition, paths in [("path = 'src/m3.py'", ["src/m3.py"]), ("path IN ('src/m1.py', 'none.py')", ["src/m1.py"]), ("path LIKE 'docs/%'", ["docs/read.md"]), ("path LIKE 'src/%' AND content LIKE '%f11()%'", ["src/m11.py"])]:
        host.asked.clear()
        assert [r["path"] for r in read().filter(condition).collect()] == paths
        assert set(host.asked) == (set(paths) if "content" not in condition else {p for p in FILES if p.startswith("src/")})
    host.commit("c2", {})
    assert read().count() == 0


def test_requests_are_made_again_and_a_failed_task_alone(host):
    host.commit("c1", FILES)
    reader = FilesReader(_Where({"path": ADDRESS, **options(host, partitions="3", attempts="3")}))
    parts = reader.partitions()
    host.fails = {"src/m0.py": [503, 429], "src/m1.py": [500] * 3, "src/m2.py": [404]}
    rows = lambda k: [r[0] for r in reader.read(parts[k])]
    assert "src/m0.py" in rows(0) and host.asked["src/m0.py"] == 3
    with pytest.raises(urllib.error.HTTPError):
        rows(1)
    assert "src/m2.py" not in rows(2) and host.asked["src/m2.py"] == 1
    assert "src/m1.py" in rows(1) and host.asked["src/m1.py"] == 4
    assert all(host.asked[p] == 1 for k in (0, 2) for p, _ in parts[k].found if p != "src/m0.py")
    with pytest.raises(ValueError):
        RepositorySource({"path": "https://example.com/x"}).reader(None)


def test_the_filter_of_a_listing_is_that_of_columns(spark):
    names = ["a.py", "A.PY", "x/Makefile", "Makefile.x", "dir.py/file", "b", "x/dist/a.js", "dist/a.js", "a.min.js", "yarn.lock", "x.", ".py", "Dockerfile", "a.b/README"]
    entries = [(p, kind, size) for p in names for kind in ("blob", "tree") for size in (0, 9, 10, 200_000, 200_001)]
    found = spark.createDataFrame(entries, "path string, type string, size long").filter(repository.is_wanted(F.col("path"), F.col("type"), F.col("size")))
    assert sorted(tuple(r) for r in found.collect()) == sorted(e for e in entries if repository.keeps(*e))


def test_commits_become_changes_and_an_index(spark, host, tmp_path):
    """Files come, change, go and come back; the index that takes the stream equals one of the last commit, and only what changed is fetched."""
    register(spark)
    first = {p: FILES[p] for p in ("src/m0.py", "src/m1.py", "src/m2.py", "src/m5.py")}
    third = {"src/m0.py": FILES["src/m0.py"], "src/m1.py": FILES["src/m1.py"] + "\nx = 1\n", "src/m3.py": FILES["src/m3.py"], "src/m5.py": FILES["src/m5.py"]}
    store = SegmentStore(spark, str(tmp_path / "s"))
    for name, files, asked in [("c1", first, set(first)), ("c2", third, {"src/m1.py", "src/m3.py"}), ("c2", third, set()), ("c3", first, {"src/m1.py", "src/m2.py"})]:
        host.commit(name, files)
        host.asked.clear()
        index_stream(spark.readStream.format("repository").options(**options(host, partitions="2")).load(ADDRESS), store, "a", str(tmp_path / "ck")).awaitTermination()
        assert set(host.asked) == asked
    same(spark, store.open("a"), first)
