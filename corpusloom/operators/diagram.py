"""Diagrams and summaries of the file graph: bounded selections of files, rendered from ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, top_directory
from .graph import degrees, edge_lists

MOST_NODES, MOST_SUMMARY, NODE_UNITS, SUMMARY_UNITS = 60, 40, 4, 6
SHOWN_TYPES = ("function", "class", "method")
# The style class of each extension, and the colours of each class.
STYLES = {"py": "py", "ts": "ts", "tsx": "ts", "js": "js", "jsx": "js", "mjs": "js", "go": "go", "rs": "rs"}
COLOURS = {
    "py": ("#3572a5", "#264f78", "#fff"),
    "ts": ("#2b7489", "#1a5c6b", "#fff"),
    "js": ("#f1e05a", "#c9b700", "#333"),
    "go": ("#00acd7", "#007fa3", "#fff"),
    "rs": ("#dea584", "#b5724d", "#333"),
}


def file_units(chunks: DataFrame) -> DataFrame:
    """(path, units): names of functions and classes in order of first appearance."""
    named = chunks.filter(F.col("unit_type").isin(*SHOWN_TYPES) & F.col("unit_name").isNotNull() & (F.col("unit_name") != ""))
    first = named.groupBy("path", "unit_name").agg(F.min("chunk_index").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "unit_name"))), lambda x: x["unit_name"])
    return first.groupBy("path").agg(ordered.alias("units"))


def all_files(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that have named units or edges."""
    return file_units(chunks).select("path").unionByName(edges.select(F.col("src").alias("path"))).unionByName(edges.select(F.col("dst").alias("path"))).distinct()


def top_files(chunks: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(path, degree): the best connected files; ties by path."""
    known = all_files(chunks, edges).join(degrees(edges), "path", "left").select("path", F.coalesce("degree", F.lit(0)).alias("degree"))
    return known.orderBy(F.desc("degree"), "path").limit(most)


def node_id(path: Column) -> Column:
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "_")


def node_style(path: Column) -> Column:
    extension = F.when(path.contains("."), F.substring_index(path, ".", -1)).otherwise(F.lit("other"))
    out = F.lit(None).cast("string")
    for name, style in STYLES.items():
        out = F.when(extension == name, F.lit(style)).otherwise(out)
    return out


def nodes(chunks: DataFrame, edges: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(path, directory, node, label, style) of the files of a diagram."""
    shown = top_files(chunks, edges, most).join(file_units(chunks), "path", "left")
    units = F.transform(F.slice(F.coalesce("units", F.array().cast("array<string>")), 1, NODE_UNITS), lambda u: F.concat(F.lit("+ "), u))
    label = F.concat(F.lit('"'), F.array_join(F.concat(F.array(basename(F.col("path"))), units), "\\n"), F.lit('"'))
    return shown.select("path", top_directory(F.col("path")).alias("directory"), node_id(F.col("path")).alias("node"), label.alias("label"), node_style(F.col("path")).alias("style"))


def node_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """(src_node, dst_node): edges between shown files, equal node ids taken together."""
    one, two = shown.select(F.col("path").alias("src")), shown.select(F.col("path").alias("dst"))
    kept = edges.join(one, "src", "left_semi").join(two, "dst", "left_semi")
    return kept.select(node_id(F.col("src")).alias("src_node"), node_id(F.col("dst")).alias("dst_node")).distinct()


def groups(shown: DataFrame) -> DataFrame:
    """(directory, files): shown files by top directory, sorted."""
    return shown.groupBy("directory").agg(F.sort_array(F.collect_list("path")).alias("files"))


def diagram_lines(chunks: DataFrame, edges: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(part, key, line): the diagram's lines; ordered by part and key they are the whole text."""
    shown = nodes(chunks, edges, most)
    head = chunks.sparkSession.createDataFrame([(0, "", '%%{init: {"theme": "neutral"}}%%'), (1, "", "graph LR")], "part int, key string, line string")
    tail = chunks.sparkSession.createDataFrame(
        [(4, f"{k}", f"    classDef {name}  fill:{fill},stroke:{stroke},color:{ink}") for k, (name, (fill, stroke, ink)) in enumerate(COLOURS.items())], "part int, key string, line string")
    opened = shown.select("directory").distinct().select(
        F.lit(2).alias("part"), F.concat("directory", F.lit("\x00")).alias("key"), F.concat(F.lit("    subgraph "), node_id(F.col("directory")), F.lit('["'), "directory", F.lit('/"]')).alias("line"))
    closed = shown.select("directory").distinct().select(F.lit(2).alias("part"), F.concat("directory", F.lit("\x02")).alias("key"), F.lit("    end").alias("line"))
    style = F.coalesce(F.concat(F.lit(":::"), "style"), F.lit(""))
    inner = shown.select(F.lit(2).alias("part"), F.concat("directory", F.lit("\x01"), "path").alias("key"), F.concat(F.lit("        "), "node", F.lit("["), "label", F.lit("]"), style).alias("line"))
    arrows = node_edges(edges, shown).select(F.lit(3).alias("part"), F.concat("src_node", F.lit(" "), "dst_node").alias("key"), F.concat(F.lit("    "), "src_node", F.lit(" --> "), "dst_node").alias("line"))
    return head.unionByName(opened).unionByName(inner).unionByName(closed).unionByName(arrows).unionByName(tail)


def render(lines: DataFrame) -> str:
    """The text of a bounded table of lines; empty if it shows no file."""
    rows = lines.orderBy("part", "key").collect()
    return "\n".join(r["line"] for r in rows) if any(r["part"] == 2 for r in rows) else ""


def summary_lines(chunks: DataFrame, edges: DataFrame, most: int = MOST_SUMMARY) -> DataFrame:
    """(part, key, line): a header with totals, then a paragraph for each of the best connected files."""
    shown = top_files(chunks, edges, most).join(file_units(chunks), "path", "left").join(edge_lists(edges), "path", "left")
    told = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(names, ", ")))
    body = F.concat_ws(
        "\n", F.concat(F.lit("File: "), "path"), told("Defines", F.slice("units", 1, SUMMARY_UNITS)), told("Imports", F.col("imports")), told("Imported by", F.col("imported_by")), F.lit(""))
    files = shown.select(F.lit(2).alias("part"), F.concat(F.lpad((F.lit(1 << 40) - F.col("degree")).cast("string"), 14, "0"), "path").alias("key"), body.alias("line"))
    totals = all_files(chunks, edges).agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("e")))
    head = totals.select(F.lit(1).alias("part"), F.lit("").alias("key"), F.concat(F.lit("Repository summary: "), F.col("n").cast("string"), F.lit(" files total, "), F.col("e").cast("string"), F.lit(" resolved import relationships.\n")).alias("line"))
    return head.unionByName(files)
