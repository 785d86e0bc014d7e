"""An index in segments against one that is built at once."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.graph import import_edges
from corpusloom.plans.index import Index
from corpusloom.plans.segments import SegmentStore
from corpusloom.sources import repository
from corpusloom.sources.index_store import Conflict


def written_files(n, seed=0, words=150, about=""):
    r = random.Random(seed)
    return {f"lib/m{k}.py": f"import lib.m{(k * 7 + 1) % n}\n" + "".join(f"\ndef f{j}(a):\n    '''{' '.join(f'w{r.randint(0, 900)}' for _ in range(words))} {about}'''\n    return a\n" for j in range(3)) for k in range(n)}


def table(spark, files):
    return spark.createDataFrame([(p, c, f"u/{p}", "py") for p, c in files.items()], repository.FILES)


def rows(df, *names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


def same(spark, found, files):
    whole = Index.build(table(spark, files))
    assert rows(found.chunks, "chunk_id", "text") == rows(whole.chunks, "chunk_id", "text")
    assert rows(found.edges, "src", "dst") == rows(whole.edges, "src", "dst")
    assert rows(found.bm25.terms, "term", "df", "idf") == rows(whole.bm25.terms, "term", "df", "idf")
    assert rows(found.bm25.totals, "n", "avgdl") == rows(whole.bm25.totals, "n", "avgdl")
    assert rows(found.bm25.postings, "term", "chunk_id", "tf", "dl") == rows(whole.bm25.postings, "term", "chunk_id", "tf", "dl")
    asked = spark.createDataFrame([(0, "where is w17 and w4", None), (1, "changed things", "w5 w6\nw7")], "question_id long, question string, response string")
    hits = lambda index: [rows(x, "question_id", "rank", "chunk_id", "score") for x in index.retrieve(asked)]
    assert hits(found) == hits(whole)


def test_one_percent_of_files_writes_little_and_scores_like_all(spark, tmp_path):
    store, files = SegmentStore(spark, str(tmp_path / "s")), written_files(200)
    store.append("a", table(spark, files))
    size = lambda: sum(x.stat().st_size for x in (tmp_path / "s").rglob("*.parquet"))
    before = size()
    new = {"lib/m3.py": "import lib.m9\n\ndef changed(a):\n    'Changed things w17.'\n    return a\n", "lib/more.py": "import lib.m3\n\ndef other(a):\n    return a\n"}
    store.append("a", table(spark, new))
    assert size() - before < 0.05 * before
    same(spark, store.open("a"), files | new)


def test_changes_in_any_order_equal_a_build(spark, tmp_path):
    """Files are added, replaced, taken out and put back; then the parts are merged."""
    store, files = SegmentStore(spark, str(tmp_path / "s")), written_files(9, words=6)
    store.append("a", table(spark, {p: c for p, c in files.items() if p != "lib/m2.py"}))
    store.append("a", table(spark, {p: c for p, c in files.items() if p in ("lib/m2.py", "lib/m3.py")}))
    store.remove("a", spark.createDataFrame([("lib/m3.py",), ("lib/m5.py",), ("none.py",)], "path string"))
    changed = written_files(9, seed=4, words=5, about="changed")
    store.append("a", table(spark, {"lib/m5.py": changed["lib/m5.py"], "lib/m1.py": changed["lib/m1.py"]}))
    now = files | {"lib/m5.py": changed["lib/m5.py"], "lib/m1.py": changed["lib/m1.py"]}
    del now["lib/m3.py"]
    same(spark, store.open("a"), now)
    assert store.remove("a", spark.createDataFrame([("none.py",)], "path string")) == store.version("a")
    store.compact("a")
    assert len(store.parts("a")[1]) == 1 and not store.parts("a")[2]
    same(spark, store.open("a"), now)
    store.grace = -1.0
    assert len(store.expire("a")) == 10 and len(store.versions("a")) == 1
    assert rows(store.open("a").chunks, "path") == rows(Index.build(table(spark, now)).chunks, "path")


def test_writers_that_cross_conflict(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.open("a")
    store.append("a", table(spark, written_files(2, words=3)))
    version, segments, lists = store.parts("a")
    store.append("a", table(spark, {"x.py": "x = 1\n"}))
    with pytest.raises(Conflict):
        store._commit("a", version, [*segments, *lists])
    assert store.open("a").chunks.filter(F.col("path") == "x.py").count() == 1


def test_links_follow_files_that_shadow_each_other_and_files_without_chunks(spark, tmp_path):
    """A better candidate comes and goes; an empty file is led to though it has no chunk."""
    store, first = SegmentStore(spark, str(tmp_path / "s")), {"src/a.py": "import b\nimport c\n\ndef f():\n    return 1\n", "lib/b.py": "import a\n", "c.py": ""}
    links = lambda: rows(store.open("a").edges, "src", "dst")
    whole = lambda files: rows(import_edges(store.open("a").imports, spark.createDataFrame([(p,) for p in files], "path string")), "src", "dst")
    store.append("a", table(spark, first))
    assert links() == whole(first) == [("lib/b.py", "src/a.py"), ("src/a.py", "c.py"), ("src/a.py", "lib/b.py")]
    more = {"b.py": "x = 1\n", "d.py": "import lib.b\n"}
    store.append("a", table(spark, more))
    assert links() == whole(first | more)
    assert ("src/a.py", "b.py") in links()
    store.remove("a", spark.createDataFrame([("b.py",), ("c.py",)], "path string"))
    now = {p: c for p, c in (first | more).items() if p not in ("b.py", "c.py")}
    assert links() == whole(now) and ("src/a.py", "lib/b.py") in links()
    store.compact("a")
    assert links() == whole(now) and len(store._now("a").links) == 1
