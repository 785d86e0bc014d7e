"""The file graph: imports resolved to paths by joins, neighbours, degrees and summaries.

Tables: ``imports`` (src, language, raw), ``paths`` (path), ``edges`` (src, dst; distinct, no loops).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname, normalised
from ..functions.scratch import written

# Roots, extensions and index files that are tried, in order.
PYTHON_ROOTS = ("", "src/", "lib/")
PYTHON_ENDS = (".py", "/__init__.py")
JS_ENDS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs",
    "",
    "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py", "/mod.rs", "/lib.rs",
)


def _nth(values: list[Column]) -> Column:
    """(place, path) of candidates, the best first."""
    return F.array(*(F.struct(F.lit(k).alias("place"), v.alias("path")) for k, v in enumerate(values)))


def python_candidates(src: Column, raw: Column) -> Column:
    """Absolute modules are tried below each root; relative ones climb a directory per dot after the first."""
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    module = F.replace(F.substring(raw, dots + 1, F.length(raw)), F.lit("."), F.lit("/"))
    parts = F.filter(F.split(dirname(src), "/"), lambda x: x != "")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    near = F.when(base == "", module).otherwise(F.concat(base, F.lit("/"), module))
    # a bare module at the root is its package file
    inside = F.when(near == "", F.lit("__init__.py")).otherwise(F.concat(near, F.lit("/__init__.py")))
    absolute = _nth([F.concat(F.lit(root), module, F.lit(end)) for root in PYTHON_ROOTS for end in PYTHON_ENDS])
    return F.when(dots > 0, _nth([F.concat(near, F.lit(".py")), inside])).otherwise(absolute)


def js_candidates(src: Column, raw: Column) -> Column:
    """Relative modules only."""
    base = normalised(F.concat(dirname(src), F.lit("/"), raw))
    return F.when(raw.startswith("."), _nth([F.concat(base, F.lit(end)) for end in JS_ENDS]))


def go_stem(path: Column) -> Column:
    """The name, without its ending, of a Go file below a directory; else empty."""
    return F.regexp_extract(path, r"/([^/]+)\.go$", 1)


def _first_hit(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, raw, dst): the first candidate that exists, by an equi-join on paths."""
    tried = candidates.select("src", "raw", F.inline("c")).join(paths, "path")
    return tried.groupBy("src", "raw").agg(F.min_by("path", "place").alias("dst"))


def resolve_python(imports: DataFrame, paths: DataFrame) -> DataFrame:
    return _first_hit(imports.select("src", "raw", python_candidates(F.col("src"), F.col("raw")).alias("c")), paths)


def resolve_js(imports: DataFrame, paths: DataFrame) -> DataFrame:
    return _first_hit(imports.select("src", "raw", js_candidates(F.col("src"), F.col("raw")).alias("c")), paths)


def resolve_go(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """The smallest path below a directory whose file is named like the import's last segment."""
    files = paths.select(go_stem(F.col("path")).alias("stem"), "path").filter("stem <> ''").groupBy("stem").agg(F.min("path").alias("dst"))
    return imports.select("src", "raw", F.substring_index("raw", "/", -1).alias("stem")).join(files, "stem").select("src", "raw", "dst")


def resolve(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, raw, dst) of every import that resolves; languages without a rule never do."""
    paths = paths.select("path").distinct()
    of = lambda *names: imports.filter(F.col("language").isin(*names)).select("src", "raw").distinct()
    return resolve_python(of("python"), paths).unionByName(resolve_js(of("javascript", "typescript"), paths)).unionByName(resolve_go(of("go"), paths))


def import_edges(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct (src, dst) without loops."""
    return resolve(imports, paths).filter("dst <> src").select("src", "dst").distinct()


# ---------------------------------------------------------------- walks and summaries
def both_ways(edges: DataFrame) -> DataFrame:
    """(path, other) along and against each edge."""
    return edges.select(F.col("src").alias("path"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("path"), F.col("src").alias("other"))).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(start, path, hops): files within ``depth`` steps of each ``start``, by any direction, itself left out.

    Each hop joins only the last frontier with the edges and is written, so plans stay short at any depth.
    """
    links = both_ways(edges)
    seen = seeds.select("start", F.col("start").alias("path"), F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(links, "path").select("start", F.col("other").alias("path")).distinct()
        frontier = step.join(seen, ["start", "path"], "left_anti").withColumn("hops", F.lit(hop))
        if depth > 1:
            frontier = written(frontier, f"hop-{hop}")
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0")


def degrees(edges: DataFrame) -> DataFrame:
    """(path, degree): edges that leave a file plus edges that enter it."""
    ends = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path")))
    return ends.groupBy("path").agg(F.count("*").alias("degree"))


def edge_lists(edges: DataFrame) -> DataFrame:
    """(path, imports, imported_by): sorted arrays, empty where there is none."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("imports"))
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast("array<string>")
    return out.join(into, "path", "full_outer").select("path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def from_edge_lists(lists: DataFrame) -> DataFrame:
    """Edges of (path, imports, imported_by): what ``edge_lists`` was made of."""
    out = lists.select(F.col("path").alias("src"), F.explode("imports").alias("dst"))
    return out.unionByName(lists.select(F.explode("imported_by").alias("src"), F.col("path").alias("dst"))).distinct()


def connection_summary(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, summary): what a file imports and what imports it, in one line."""
    parts = F.array_compact(F.array(
        F.when(F.size("imports") > 0, F.concat(F.lit("imports: "), F.array_join("imports", ", "))),
        F.when(F.size("imported_by") > 0, F.concat(F.lit("imported by: "), F.array_join("imported_by", ", "))),
    ))
    joined = paths.select("path").distinct().join(edge_lists(edges), "path", "left")
    return joined.select("path", F.coalesce(F.when(F.size(parts) > 0, F.array_join(parts, " | ")), F.lit("no resolved dependencies")).alias("summary"))
