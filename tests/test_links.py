"""Links kept over changes against links of all imports."""

import random

from corpusloom.functions.scratch import written
from corpusloom.operators import links

IMPORTS, PATHS = "src string, language string, raw string", "path string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def made(r, k):
    """A file and its imports, whose candidates shadow each other."""
    kind = k % 3
    if kind == 0:
        path = f"{r.choice(('', 'src/', 'lib/'))}p{k % 4}{r.choice(('.py', '/__init__.py'))}"
        return path, [(path, "python", r.choice((f"p{r.randrange(4)}", f".p{r.randrange(4)}", "..p1", ".", "os"))) for _ in range(2)]
    if kind == 1:
        path = f"w/m{k % 4}{r.choice(('.ts', '.js', '/index.js', '.jsx', ''))}"
        return path, [(path, r.choice(("javascript", "typescript")), r.choice((f"./m{r.randrange(4)}", f"../w/m{r.randrange(4)}", "react"))) for _ in range(2)]
    path = f"{r.choice(('', 'x/', 'y/'))}g{k % 4}.go"
    return path, [(path, "go", f"h.com/g{r.randrange(4)}") for _ in range(2)] + [(path, "rust", "std")]


def test_random_changes_equal_all_links(spark):
    r, files, parts, index = random.Random(3), {}, [], spark.createDataFrame([], "key string, " + IMPORTS)
    for step in range(7):
        went = set(r.sample(sorted(files), min(len(files), r.randrange(4))))
        came = dict(made(r, r.randrange(12)) for _ in range(5))
        was, old = set(files), [i for p in went | (came.keys() & files.keys()) for i in files[p]]
        files = {p: i for p, i in files.items() if p not in went and p not in came} | came
        table = lambda found, schema: spark.createDataFrame(sorted(set(found)), schema)
        differ = table([(p,) for p in was ^ set(files)], PATHS)
        keys = written(differ.select(__import__("pyspark.sql.functions", fromlist=["explode"]).explode(links.keys_of(differ.path)).alias("key")).distinct(), "keys")
        stay = index.join(table([(p,) for p in went | came.keys()], "src string"), "src", "left_anti").select("key", "src", "language", "raw")
        new = table([i for p in came for i in files[p]], IMPORTS)
        again = links.touched(stay, keys).unionByName(new)
        parts.append(written(links.relinked(again, table(old, IMPORTS), table([(p,) for p in files], PATHS), written), "links"))
        index = written(stay.unionByName(links.tries(new)), "tries")
        whole = links.all_links(table([i for p in files for i in files[p]], IMPORTS), table([(p,) for p in files], PATHS))
        assert rows(links.newest(parts)) == rows(whole), step
    assert whole.count() > 5


def test_only_imports_that_changed_paths_concern_are_resolved(spark):
    paths = [f"lib/m{k}.py" for k in range(200)]
    imports = spark.createDataFrame([(p, "python", f"m{(k * 7 + 1) % 200}") for k, p in enumerate(paths)], IMPORTS)
    index, seen = written(links.tries(imports), "tries"), {}

    def stored(df, label):
        seen[label] = written(df, label)
        return seen[label]

    changed = spark.createDataFrame([("path:m8.py",)], "key string")
    delta = links.relinked(links.touched(index, changed), imports.limit(0), spark.createDataFrame([(p,) for p in [*paths, "m8.py"]], PATHS), stored)
    assert rows(delta) == [("lib/m1.py", "m8", "m8.py")]
    assert seen["again"].count() == 1


def test_nulls_empty_tables_and_repeats(spark):
    """Imports without a text or a rule lead nowhere; a row that comes twice counts once; empty tables give empty ones."""
    imports = spark.createDataFrame([("a.py", "python", None), ("a.py", "python", "b"), ("a.py", "python", "b"), ("x.rs", "rust", "b")], IMPORTS)
    paths = spark.createDataFrame([("a.py",), ("b.py",), ("b.py",)], PATHS)
    none = imports.limit(0)
    assert {r["raw"] for r in links.tries(imports).collect()} == {"b"}
    assert rows(links.newest([links.relinked(imports, none, paths, written)])) == [("a.py", "b", "b.py")]
    assert rows(links.relinked(none, imports.filter("raw = 'b' AND language = 'python'"), paths, written)) == [("a.py", "b", None)]
    assert rows(links.relinked(none, none, paths.limit(0), written)) == []
