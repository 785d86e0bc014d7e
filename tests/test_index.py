import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import matching
from corpusloom.goldens import GOLDEN_FILES, GOLDEN_IMPORTS, GRAPH_PATHS, PARSED, UNITS
from corpusloom.operators import diagram, graph, parsing, retrieval
from corpusloom.plans.index import Index, ingest, languages
from corpusloom.plans.providers import Models, ScriptedPlanner
from corpusloom.sources import repository
from corpusloom.sources.index_store import Conflict, IndexCache, IndexStore, checked_join

FILES = [
    ("app/main.py", "import app.util\n\ndef main():\n    'Starts.'\n    return app.util.load()\n"),
    ("app/util.py", "def load():\n    return 1\n\nclass Store:\n    pass\n"),
    ("docs/guide.md", "# Guide\n" + "How to load the store and start. " * 5 + "\n## Next\n" + "More on the store follows here. " * 4),
    ("docs/flow.mmd", "graph TD\nA --> B\nB --> C"),
    ("web/a.js", "import x from './b'\nexport function go(a) { return x }\n"),
    ("web/b.js", "const twice = (x) => { return 2 * x }\n"),
    ("empty.py", ""),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, c, f"https://example.org/{p}", p.rsplit(".", 1)[-1]) for p, c in FILES]
    return spark.createDataFrame(rows, repository.FILES)


@pytest.fixture(scope="module")
def index(spark, files, tmp_path_factory):
    seen = []
    made = ingest(files, IndexStore(spark, str(tmp_path_factory.mktemp("index"))), "acme__tool", progress=lambda p, w: seen.append(p))
    assert seen == sorted(seen) and seen[-1] == 100
    return made


def test_units_and_imports_of_each_language(spark):
    units, parsed = parsing.parse_files(spark.createDataFrame(GOLDEN_FILES, "path string, content string"))
    names = ("path", "ord", "name", "unit_type", "signature", "docstring", "line_start", "line_end")
    assert sorted(tuple(r[n] for n in names) for r in units.collect()) == sorted(UNITS)
    assert sorted((r["path"], r["language"], " ".join(r["raw_imports"]), r["module_doc"]) for r in parsed.collect()) == sorted(PARSED)


@pytest.mark.parametrize(("content", "brace", "end"), [("{a{b}c}d", 0, 7), ("{'}'}x", 0, 5), ('{"\\"}"}x', 0, 7), ("{ // don't }", 0, 12), ("{`}`", 0, 4)])
def test_block_end(content, brace, end):
    points, starts = matching.code_points(["{'", content, '"}'])
    assert matching.block_ends(points, starts[1:2] + brace, starts[2:3] - 1) - starts[1] == end


def one_by_one(content, at):
    """The end of the block that opens at ``at``, a character after the other."""
    depth, quote, k = 0, None, at
    while k < len(content):
        c = content[k]
        if quote:
            k += c == "\\"
            quote = None if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return k + 1
        k += 1
    return len(content)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(st.sampled_from("{}'\"`\\x\n"), max_size=40), min_size=1, max_size=6))
def test_blocks_of_many_texts_end_where_a_walk_says(contents):
    points, starts = matching.code_points(contents)
    places = [(k, i) for k, t in enumerate(contents) for i, c in enumerate(t) if c == "{"]
    of = np.array([k for k, _ in places], int)
    found = matching.block_ends(points, starts[of] + np.array([i for _, i in places], int), starts[of + 1] - 1) - starts[of]
    assert found.tolist() == [one_by_one(contents[k], i) for k, i in places]


def test_a_file_of_many_declarations_takes_time_by_its_size():
    import time

    content = "".join(f"// does {k}\nfunction f{k}(x) {{ return '}}' + x }}\n" for k in range(20_000))
    began = time.perf_counter()
    units = parsing.declared([content, content], ["javascript", "typescript"])
    assert time.perf_counter() - began < 5
    assert [len(u) for u in units] == [20_000, 20_000] and units[1][-1] | {"docstring": ""} == {
        "name": "f19999", "unit_type": "function", "signature": "function f19999(", "docstring": "", "ord": 19_999, "body": "function f19999(x) { return '}' + x }", "line_start": 40_000, "line_end": 40_000}


def test_contents_are_not_dealt_and_repeated_paths_stay_apart(spark):
    rows = [("a.js", "function f(a) { }\nclass A { f() { } }\n"), ("a.js", "function f(a) { }\nclass A { f() { } }\n"), ("b.lua", "x\n\ny"), ("b.lua", "z")]
    units, parsed = parsing.parse_files(spark.createDataFrame(rows, "path string, content string"))
    assert sorted((r["path"], r["ord"], r["name"]) for r in units.collect()) == [("a.js", 0, "f"), ("a.js", 0, "f"), ("a.js", 1, "A"), ("a.js", 1, "A"), ("b.lua", 0, "block_1"), ("b.lua", 0, "block_1")]
    assert parsed.count() == 4
    for df in (units, parsed):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_goldens_of_imports(spark):
    by = {"python": graph.resolve_python, "javascript": graph.resolve_js, "go": graph.resolve_go}
    paths = spark.createDataFrame([(p,) for p in GRAPH_PATHS], "path string")
    for lang, resolve in by.items():
        rows = [(s, r, d) for s, r, x, d in GOLDEN_IMPORTS if x == lang]
        found = {(r["src"], r["raw"]): r["dst"] for r in resolve(spark.createDataFrame([x[:2] for x in rows], "src string, raw string"), paths).collect()}
        assert all(found.get((s, r)) == d for s, r, d in rows)


def test_neighbours(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "d")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "start string")
    assert {r["path"] for r in graph.neighbours(edges, seed, 1).collect()} == {"b"}
    assert {r["path"] for r in graph.neighbours(edges, seed, 2).collect()} == {"b", "c", "d"}


def test_index_holds_all_files(index):
    by = {r["path"]: r["n_chunks"] for r in retrieval.indexed_files(index.chunks).collect()}
    assert set(by) == {p for p, _ in FILES} and by["docs/guide.md"] == 2
    assert index.chunks.filter("path = 'empty.py'").first()["text"].endswith("(empty or binary)")
    assert {(r["src"], r["dst"]) for r in index.edges.collect()} == {("app/main.py", "app/util.py"), ("web/a.js", "web/b.js")}
    assert index.chunks.select("chunk_id").distinct().count() == index.chunks.count()


def test_answer_streams_sources_tools_and_text(index):
    models = Models(planner=ScriptedPlanner(("get_file", "app/util.py"), ("list_files", ""), ("unknown", "")))
    events = list(index.answer("how does load work", models))
    assert events[0]["type"] == "sources" and events[0]["sources"][0]["place"] == 1
    assert [e["tool"] for e in events if e["type"] == "tool"] == ["get_file", "list_files"]
    text = "".join(e["text"] for e in events if e["type"] == "token")
    assert "class Store" in text and "how does load work" in text


def test_failing_models_leave_the_question(index):
    class Broken:
        def expand(self, question):
            raise RuntimeError("no model")

        def step(self, *_):
            raise RuntimeError("no model")

    events = list(index.answer("store", Models(expander=Broken(), planner=Broken())))
    assert events[0]["sources"] and not [e for e in events if e["type"] == "tool"]


def test_tools(index):
    tools = index.tools()
    assert "app/main.py" in tools["list_files"]("")
    assert "isn't in the index" in tools["get_file"]("zzz")
    assert "docs/guide.md" in tools["search_codebase"]("guide store")
    assert "- Guide" in index.tools(documents=True)["list_sections"]("")


def test_diagram_and_summary(index):
    text = index.mermaid()
    assert "app_main_py --> app_util_py" in text and '["app/"]' in text and ":::py" in text
    assert text.index("subgraph app") < text.index("subgraph web")
    assert "Repository summary: 4 files total, 2 resolved import relationships." in index.summary()
    assert "".join(index.explain()).count("File: ") == 4


def test_no_files_no_diagram(spark):
    none = spark.createDataFrame([], "src string, dst string")
    chunks = spark.createDataFrame([], "path string, unit_name string, unit_type string, chunk_index int")
    assert diagram.render(diagram.diagram_lines(chunks, none)) == ""


def test_store_keeps_clears_and_retains(spark, index, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    assert store.load("a") is None and store.repositories() == []
    for name in "abc":
        index.save(store, name)
    assert store.repositories() == ["a", "b", "c"]
    store.retain_only("b")
    assert store.repositories() == ["b"] and Index.load(store, "b").chunks.count() == index.chunks.count()
    out = store.write_graph_json("b", index.edges)
    assert spark.read.json(out).count() == 4
    assert sorted(store.read_graph_json("b").collect()) == sorted(index.edges.collect())
    with pytest.raises(ValueError):
        Index.load(store, "zzz")


def _versioned(spark, word):
    return {"chunks": spark.createDataFrame([(word,)], "word string"), "edges": spark.createDataFrame([(word, word)], "src string, dst string")}


def _words(store, name, version=None):
    tables = store.load(name, version)
    return {n: tables[n].first()[0] for n in ("chunks", "edges")}


def test_saves_that_cross_lose_nothing(spark, tmp_path):
    """A save that begins between the tables of another, a reader that keeps its version, and a writer that stops before its entry."""
    store, other = IndexStore(spark, str(tmp_path / "s")), IndexStore(spark, str(tmp_path / "s"))
    base = store.save("a", _versioned(spark, "base"))
    read = store.load("a")

    class Slow(dict):
        """Tables between which another writer saves."""

        def items(self):
            for k, item in enumerate(super().items()):
                if k == 1:
                    inner.append(other.save("a", _versioned(spark, "fast")))
                yield item

    inner = []
    last = store.save("a", Slow(_versioned(spark, "slow")))
    assert store.versions("a") == [base, *inner, last]
    assert _words(store, "a") == {"chunks": "slow", "edges": "slow"} and _words(store, "a", inner[0]) == {"chunks": "fast", "edges": "fast"}
    assert read["edges"].first()[0] == "base" == _words(store, "a", base)["chunks"]

    class Stops(dict):
        def items(self):
            yield next(iter(super().items()))
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.save("a", Stops(_versioned(spark, "lost")))
    assert store.version("a") == last and _words(other, "a")["chunks"] == "slow"


def test_a_save_over_another_version_is_a_conflict(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    base = store.save("a", _versioned(spark, "base"))
    next_ = store.save("a", _versioned(spark, "one"), replaces=base)
    with pytest.raises(Conflict):
        store.save("a", _versioned(spark, "two"), replaces=base)
    assert store.versions("a") == [base, next_] and len(store._children("tables", "repo_id=a")) == 2


def test_a_number_of_the_log_is_given_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    assert [store._put("a", 1, ["x"]), store._put("a", 1, ["y"]), store._put("a", 2, ["z"])] == [True, False, True]
    assert store.versions("a") == ["x", "z"]


def test_replaced_versions_go_after_their_grace(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    first, second = (store.save("a", _versioned(spark, w)) for w in ("one", "two"))
    assert store.expire("a") == []
    store.grace = -1.0
    assert store.expire("a") == [first] and store.versions("a") == [second] and store.load("a", first) is None
    assert _words(store, "a")["chunks"] == "two"


def test_cache_has_room_for_two_and_sees_a_save(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    for name in "abc":
        store.save(name, _versioned(spark, name))
    cache = IndexCache(store, int(2.5 * store.size("a", store.version("a"))))
    held = {name: cache.get(name) for name in "ab"}
    cache.get("a")
    cached = lambda name: held[name]["chunks"].storageLevel.useMemory
    assert cached("a") and cached("b") and cache.get("a") is held["a"]
    held["c"] = cache.get("c")
    assert cached("a") and not cached("b") and cached("c")
    store.save("a", _versioned(spark, "new"))
    assert cache.get("a")["chunks"].first()[0] == "new" and not cached("a")
    assert IndexCache(store, 1).get("b")["chunks"].first()[0] == "b" and cache.get("nothing") is None
    cache.clear()
    assert not cached("c")


def test_paths_below_a_folder(spark, tmp_path, monkeypatch):
    """A root whose name occurs again below it, begins other names, is a symbol of patterns, or is given from where one stands."""
    root = tmp_path / "dataX"
    names = ("a.py", f"{str(root)[1:]}/z/w.py", f"{str(root)[1:]}base.py", "dataX/dataX.py", "sub dir/b+c.md")
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("text " * 20)
    (tmp_path / "dataXbase.py").write_text("text " * 20)
    for given in (str(root), f"{root}/", f"file:{root}", f"file://{root}"):
        assert sorted(r["path"] for r in repository.load_directory(spark, given).collect()) == sorted(names)
    assert [r["path"] for r in repository.load_directory(spark, str(root / "a.py")).collect()] == ["a.py"]


def test_an_appended_index_equals_one_built_at_once(spark, files, tmp_path):
    """Files that import each other link whichever comes first, and the result can be saved over what it was made from."""
    store = IndexStore(spark, str(tmp_path / "s"))
    first, more = files.filter("path NOT IN ('app/util.py', 'web/a.js')"), files.filter("path IN ('app/util.py', 'web/a.js')")
    ingest(first, store, "acme__tool")
    for _ in range(2):  # the second time it replaces what is there
        Index.load(store, "acme__tool").appended(more).save(store, "acme__tool")
    both, whole = Index.load(store, "acme__tool"), Index.build(files)
    rows = lambda df, *names: sorted(tuple(r) for r in df.select(*names).collect())
    assert rows(both.edges, "src", "dst") == rows(whole.edges, "src", "dst") == [("app/main.py", "app/util.py"), ("web/a.js", "web/b.js")]
    assert rows(both.chunks, "chunk_id", "text") == rows(whole.chunks, "chunk_id", "text")
    assert rows(both.bm25.terms, "term", "df", "idf") == rows(whole.bm25.terms, "term", "df", "idf")
    assert both.bm25.totals.collect() == whole.bm25.totals.collect()


@pytest.mark.parametrize("content", ["x = " + "(" * 5000 + ")" * 5000, "def f(a: " + "-" * 900 + "1): pass\n", "x = '\0'", "def f(:"])
def test_files_that_break_the_parser_become_blocks(spark, content):
    units, parsed = parsing.parse_files(spark.createDataFrame([("p/odd.py", content), ("p/a.py", "import os\n")], "path string, content string"))
    assert {r["path"] for r in units.collect()} == {"p/odd.py", "p/a.py"}
    assert {r["path"]: r["raw_imports"] for r in parsed.collect()}["p/a.py"] == ["os"]


def test_unwanted_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.PY").write_text("import os\n")
    (tmp_path / "large.py").write_text("x" * 300_000)
    (tmp_path / "large.bin").write_text("x" * 300_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 250_000)  # reading a larger content is an error
    try:
        assert [r["path"] for r in repository.load_directory(spark, str(tmp_path)).collect()] == ["a.PY"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_turns_are_appended_with_their_sources(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q", None)], "question_id long, turn long, role string, text string, sources array<string>")
    new = spark.createDataFrame([(1, 0, "assistant", "a", ["x :: f"]), (2, 0, "user", "r", None), (1, 1, "user", "s", None)], "question_id long, place int, role string, text string, sources array<string>")
    rows = sorted(tuple(r) for r in retrieval.appended_turns(turns, new).collect())
    assert rows == [(1, 0, "user", "q", []), (1, 1, "assistant", "a", ["x :: f"]), (1, 2, "user", "s", []), (2, 0, "user", "r", [])]


def test_comments_before_declarations():
    cases = {"/* a */ f": "a", "/** A.\n * b\n */\nf": "A.\nb", "x\n// a\n# b\nf": "a\nb", "/* a */ x /* b */f": "a */ x /* b", "x;\nf": "", "/*/f": ""}
    assert {k: parsing.comment_before(k, len(k) - 1, k.find("/*")) for k in cases} == cases


def test_vectors_must_fit(spark, index):
    vectors = index.chunks.select("chunk_id", "embedding")
    assert checked_join(index.chunks.drop("embedding"), vectors).count() == index.chunks.count()
    with pytest.raises(ValueError):
        checked_join(index.chunks.drop("embedding"), vectors.limit(1))


def test_directory_and_http_sources(spark, tmp_path):
    for path, content in FILES:
        (tmp_path / "r" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / path).write_text(content)
    (tmp_path / "r/a/dist").mkdir(parents=True)
    (tmp_path / "r/a/dist/x.js").write_text("x" * 50)
    found = repository.load_directory(spark, str(tmp_path / "r"))
    assert {r["path"] for r in found.collect()} == {p for p, c in FILES if len(c) >= 10}

    class Host(repository.HttpHost):
        def _get(self, url, timeout):
            if url.endswith("/repos/acme/tool"):
                return json.dumps({"default_branch": "main"}).encode()
            if "/git/trees/" in url:
                return json.dumps({"truncated": True, "tree": [{"path": p, "type": "blob", "size": len(c)} for p, c in FILES] + [{"path": "gone.py", "type": "blob", "size": 99}]}).encode()
            if url.endswith("gone.py"):
                raise OSError("gone")
            return dict(FILES)[url.partition("/main/")[2]].encode()

    files, where = repository.fetch_repository(spark, "https://github.com/acme/tool", Host(token="t"), connections=2)
    assert where.repo_id == "acme__tool" and {r["path"] for r in files.collect()} == {p for p, c in FILES if len(c) >= 10}


def test_bad_address(spark):
    with pytest.raises(Exception, match="not a repository address"):
        repository.fetch_repository(spark, "https://example.com/x")


def test_plugged_model(spark):
    from corpusloom.operators.embedding import embed

    class Lengths:
        def embed(self, texts):
            return [[len(t), 1] for t in texts]

    df = spark.createDataFrame([("a" * 900,), ("b",), (None,)], "text string")
    assert [r["embedding"] for r in embed(df, model=Lengths).collect()] == [[800.0, 1.0], [1.0, 1.0], [0.0, 1.0]]


def test_languages(files):
    assert {r["language"]: r["n_files"] for r in languages(files).collect()} == {"python": 3, "javascript": 2, "markdown": 1, "mermaid": 1}


def test_streamed_files_become_chunks_once(spark, files, tmp_path):
    from corpusloom.streaming.ingest import chunk_stream, latest

    files.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(repository.FILES).parquet(str(tmp_path / "in"))
    for _ in range(2):
        chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    made = latest(spark.read.parquet(str(tmp_path / "out")))
    assert made.select("path").distinct().count() == len(FILES) and made.count() == made.select("chunk_id").distinct().count()
