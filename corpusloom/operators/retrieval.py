"""Answers to batches of questions: retrieval with graph neighbours, sources, context blocks and lookups.

``questions`` is (question_id, question, response): the response is what a query expander said, or null.
``queries`` is (question_id, query_id, text, vec); query_id is unique over all questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..functions.text import blank_as_null, preview, strip
from .graph import both_ways
from .fusion import hybrid_search
from .ranking import Bm25, best_per_group, diverse_top, merged

PER_QUERY, FINAL, BY_GRAPH, CANDIDATES = 14, 10, 4, 100
CONTEXT_CHUNKS, CONTEXT_CHARS = 4, 400
TOOL_HITS = 6
#: References of one lookup; more are refused, as each is compared with every path and heading.
MOST_REFS = 1_000


# ---------------------------------------------------------------- retrieval
def augmented(semantic: DataFrame, pool: DataFrame, asked: DataFrame, edges: DataFrame, k: int = BY_GRAPH) -> DataFrame:
    """question_id, chunk_id, path, score, rank: the best chunk of each file next to one that was found.

    ``pool`` holds the first ``CANDIDATES`` hits of the original questions; ``asked`` (question_id, query_id) names them.
    """
    matched = semantic.select("question_id", "path").distinct()
    near = matched.join(both_ways(edges), "path").select("question_id", F.col("other").alias("path")).distinct()
    near = near.join(matched, ["question_id", "path"], "left_anti")
    own = pool.join(asked, "query_id").drop("rank").join(near, ["question_id", "path"], "left_semi")
    order = [F.desc(F.round("score", 9)), F.col("chunk_id")]
    first = best_per_group(own, ["question_id", "path"], order, 1)
    return best_per_group(first, ["question_id"], order, k, "rank").select("question_id", "chunk_id", "path", "score", "rank")


def retrieve(chunks: DataFrame, bm25: Bm25, edges: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(semantic, by graph) hits of every question; the first query of a question is the question itself."""
    semantic = merged(hybrid_search(chunks, bm25, queries, PER_QUERY), queries, FINAL)
    asked = queries.groupBy("question_id").agg(F.min("query_id").alias("query_id"))
    pool = hybrid_search(chunks, bm25, queries.join(asked.select("query_id"), "query_id", "left_semi"), CANDIDATES)
    return semantic, augmented(semantic, pool, asked, edges)


# ---------------------------------------------------------------- what is shown
def display_label(path: Column, unit_name: Column, heading: Column) -> Column:
    """A path with the unit, else the heading; empty strings count as missing."""
    unit = F.concat(path, F.lit(" :: "), blank_as_null(unit_name))
    return F.coalesce(unit, F.concat(path, F.lit(" › "), blank_as_null(heading)), path)


def badge(file_type: Column, unit_type: Column, via_graph: Column) -> Column:
    kind = F.when(file_type == "mmd", "diagram").when(unit_type.isin("function", "method"), "fn").when(unit_type == "class", "class").otherwise(F.upper(file_type))
    return F.concat(kind, F.when(via_graph, " · graph").otherwise(""))


def sources(semantic: DataFrame, by_graph: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, place (from 1), via_graph and what a source card shows, in the order of cards."""
    both = semantic.select("question_id", "chunk_id", "score", "rank", F.lit(False).alias("via_graph")).unionByName(
        by_graph.select("question_id", "chunk_id", "score", "rank", F.lit(True).alias("via_graph")))
    counts = semantic.groupBy("question_id").agg(F.count("*").alias("n"))
    both = both.join(counts, "question_id", "left").withColumn("place", F.col("rank") + F.when(F.col("via_graph"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)))
    c = chunks.select("chunk_id", "path", "raw_url", "file_type", "language", "heading", "unit_name", "unit_type", "diagram_type", "text")
    return both.join(c, "chunk_id").select(
        "question_id", "place", "via_graph", "chunk_id", "path", "raw_url", "file_type", "language", "heading", "unit_name", "unit_type", "diagram_type", "score",
        preview(F.col("text")).alias("preview"), display_label(F.col("path"), F.col("unit_name"), F.col("heading")).alias("label"),
        badge(F.col("file_type"), F.col("unit_type"), F.col("via_graph")).alias("badge"), F.floor(F.col("score") * 100).cast("int").alias("percent"))


def _joined(rows: DataFrame, by: str, order: list[str], text: Column, joint: str, name: str) -> DataFrame:
    """One text for each group of a bounded number of rows, in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("t"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), joint).alias(name))


def context_blocks(semantic: DataFrame, by_graph: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, context): snippets of the first hits and the first one by graph."""
    first = semantic.filter(F.col("rank") <= CONTEXT_CHUNKS).select("question_id", "chunk_id", "rank", F.lit(0).alias("part"))
    first = first.unionByName(by_graph.filter(F.col("rank") == 1).select("question_id", "chunk_id", "rank", F.lit(1).alias("part")))
    rows = first.join(chunks.select("chunk_id", "path", "unit_name", "heading", "text"), "chunk_id")
    snippet = strip(F.substring("text", 1, CONTEXT_CHARS))
    more = F.when(F.length("text") > CONTEXT_CHARS, F.concat(snippet, F.lit("\n…"))).otherwise(snippet)
    shown = F.concat(F.lit("["), display_label(F.col("path"), F.col("unit_name"), F.col("heading")), F.lit("]\n"), more)
    return _joined(rows, "question_id", ["part", "rank"], shown, "\n\n", "context")


# ---------------------------------------------------------------- lookups
def chunks_of(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("path") == path).orderBy("chunk_index")


def indexed_files(chunks: DataFrame) -> DataFrame:
    """(path, file_type, n_chunks) by path."""
    return chunks.groupBy("path").agg(F.min_by("file_type", "chunk_index").alias("file_type"), F.count("*").alias("n_chunks")).orderBy("path")


def file_counts(chunks: DataFrame) -> DataFrame:
    """One row: how many files, of them diagrams and others."""
    files = indexed_files(chunks)
    return files.agg(F.count("*").alias("n_files"), F.count_if(F.col("file_type") == "mmd").alias("n_diagrams"), F.count_if(F.col("file_type") != "mmd").alias("n_other"))


def search_tool(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, answer): whole texts of a query's hits under their labels."""
    rows = hits.join(chunks.select("chunk_id", "unit_name", "unit_type", "heading", "text"), "chunk_id")
    unit = F.concat("path", F.lit(" :: "), blank_as_null(F.col("unit_name")), F.lit(" ("), "unit_type", F.lit(")"))
    label = F.coalesce(unit, F.concat("path", F.lit(" › "), blank_as_null(F.col("heading"))), F.col("path"))
    return _joined(rows, "query_id", ["rank"], F.concat(F.lit("["), label, F.lit("]\n"), "text"), "\n---\n", "answer")


def fetch_tool(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, chunk_id, path, text) for each ``ref``: the file of that path, else every chunk whose path or heading holds it.

    At most ``MOST_REFS`` references, which are broadcast: the stated set against all chunks.
    """
    refs = written(refs, "refs")
    if refs.limit(MOST_REFS + 1).count() > MOST_REFS:
        raise ValueError(f"more than {MOST_REFS} references in one lookup")
    exact = F.broadcast(refs).join(chunks, F.col("ref") == F.col("path")).select("ref", "chunk_id", "path", "text")
    rest = refs.join(chunks.select(F.col("path").alias("ref")).distinct(), "ref", "left_anti")
    held = F.lower(F.coalesce("heading", F.lit(""))).contains(F.lower("ref")) | F.lower("path").contains(F.lower("ref"))
    return exact.unionByName(F.broadcast(rest).join(chunks, held).select("ref", "chunk_id", "path", "text"))


def sections(chunks: DataFrame) -> DataFrame:
    """(section, at): distinct headings, else units, else paths, by first appearance."""
    name = F.coalesce(blank_as_null(F.col("heading")), blank_as_null(F.col("unit_name")), F.col("path"))
    return chunks.select(name.alias("section"), F.struct("path", "chunk_index").alias("at")).groupBy("section").agg(F.min("at").alias("at")).orderBy("at")


def file_list(chunks: DataFrame) -> DataFrame:
    return chunks.select("path").distinct().orderBy("path")


def history(turns: DataFrame, sources_of: DataFrame) -> DataFrame:
    """``turns`` with the sources of their question as an array of labels, the first card first."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"])
    return turns.join(sources_of.groupBy("question_id").agg(listed.alias("sources")), "question_id", "left")


def appended_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """``turns`` (question_id, turn, role, text, sources) with the rows of ``new`` (question_id, place, role, text, sources) after each question's last turn.

    ``sources`` is an array of labels, empty for turns without; ``place`` orders the new turns of a question.
    """
    last = turns.groupBy("question_id").agg(F.max("turn").alias("last"))
    number = F.row_number().over(Window.partitionBy("question_id").orderBy("place")) + F.coalesce("last", F.lit(-1))
    none = F.array().cast("array<string>")
    added = new.join(last, "question_id", "left").select("question_id", number.cast("long").alias("turn"), "role", "text", F.coalesce("sources", none).alias("sources"))
    return turns.select("question_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.coalesce("sources", none).alias("sources")).unionByName(added)
