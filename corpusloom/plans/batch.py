"""Gathering and answering for many questions at once: a round of planning is one table, a lookup one join.

In a round the planner says a step for every open question, in tasks; the table of steps is written, since a planner may say something else
when it is asked again. Then each kind of lookup runs once, over the distinct inputs of all questions, and its texts are joined to the steps.
A run has as many rounds as one question may have steps, and the number of jobs doesn't grow with the questions, beyond the blocks in which lookups bound what they broadcast.
The planner, the expander and the generator are sent to tasks, so they must be picklable and keep no state between questions: a planner
sees how far it is by the observations.

State: question_id (unique), question, context, steps (array of tool, input, seen), open. A null question is asked as an empty one; an unknown tool or a planner's
failure does what it does in ``Index.gather``.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..functions.text import strip
from ..operators import retrieval
from ..operators.fusion import hybrid_search
from .index import MOST_FETCHED, MOST_LISTED, MOST_STEPS, Index
from .providers import CODE_PROMPT, DOCUMENT_PROMPT, Models

_STEPS = "array<struct<tool:string,input:string,seen:string>>"
_JOINT = "\n\n---\n\n"


def _by_row(df: DataFrame, call, schema: str, *names: str) -> DataFrame:
    """``question_id`` and what ``call`` gives for the columns ``names`` of each row, a tuple of strings, or None for nulls."""
    key = df.schema["question_id"].dataType.simpleString()
    typed = df.sparkSession.createDataFrame([], f"question_id {key}, {schema}").schema
    width = len(typed) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [call(*given) or (None,) * width for given in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]
            columns = [pa.array([g[k] for g in got], pa.string()) for k in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column("question_id"), *columns], typed.names)

    return df.select("question_id", *names).mapInArrow(run, typed)


def expanded(questions: DataFrame, models: Models) -> DataFrame:
    """(question_id, question, response): what the expander says; null where it fails."""
    expander = models.expander

    def call(question: str) -> tuple[str] | None:
        try:
            return (expander.expand(question),)
        except Exception as error:  # the question alone still works
            logging.getLogger(__name__).warning("the expander failed: %s", error)
            return None

    said = _by_row(questions, call, "response string", "question")
    return written(questions.select("question_id", "question").join(said, "question_id"), "expanded")


# ---------------------------------------------------------------- lookups, each over all inputs of a round
def _searched(index: Index, inputs: DataFrame) -> DataFrame:
    """(input, seen)"""
    asked = written(inputs.select(F.monotonically_increasing_id().alias("question_id"), "input"), "searches")  # numbered once
    queries = index.queries(asked.select("question_id", F.col("input").alias("question"), F.lit(None).cast("string").alias("response")))
    answers = retrieval.search_tool(hybrid_search(index.chunks, index.bm25, queries, retrieval.TOOL_HITS), index.chunks)
    found = queries.select("question_id", "query_id").join(answers, "query_id")
    return asked.join(found, "question_id", "left").select("input", F.coalesce("answer", F.lit("Nothing was found.")).alias("seen"))


def _fetched(index: Index, inputs: DataFrame) -> DataFrame:
    """(input, seen); references are looked up ``MOST_REFS`` at a time."""
    refs = written(inputs.select(F.col("input").alias("ref")), "refs")
    n = refs.count()
    blocks = 1 if n <= retrieval.MOST_REFS else -(-2 * n // retrieval.MOST_REFS)  # half full, as a hash deals them
    parts = [refs.filter(F.pmod(F.xxhash64("ref"), F.lit(blocks)) == b) for b in range(blocks)]
    found = None
    for part in parts:
        rows = retrieval.fetch_tool(index.chunks, part)
        found = rows if found is None else found.unionByName(rows)
    found = found.select("ref", "chunk_id").join(index.chunks.select("chunk_id", "path", "chunk_index", "text"), "chunk_id")
    first = Window.partitionBy("ref").orderBy("path", "chunk_index")
    kept = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= MOST_FETCHED)
    listed = F.array_sort(F.collect_list(F.struct("place", "text")))
    shown = kept.groupBy("ref").agg(F.array_join(F.transform(listed, lambda x: x["text"]), _JOINT).alias("text"))
    counts = found.groupBy("ref").agg((F.count("*") - MOST_FETCHED).alias("more"))
    rest = F.concat(F.lit(f"{_JOINT}("), F.col("more").cast("string"), F.lit(" more passages match '"), F.col("ref"), F.lit("'.)"))
    said = F.when(F.col("more") > 0, F.concat("text", rest)).otherwise(F.col("text"))
    both = refs.join(shown, "ref", "left").join(counts, "ref", "left")
    return both.select(F.col("ref").alias("input"), F.coalesce(said, F.concat(F.lit("'"), "ref", F.lit("' isn't in the index."))).alias("seen"))


def _listed(label: str, names: DataFrame) -> Column:
    """One text for every question that asks, bounded by ``MOST_LISTED``."""
    lines = [f"- {r[0]}" for r in names.limit(MOST_LISTED).collect()]
    if len(lines) == MOST_LISTED and (more := names.count() - MOST_LISTED):
        lines.append(f"({more} more.)")
    return F.lit("\n".join([f"{label}:", *lines]))


def _observed(index: Index, said: DataFrame, documents: bool) -> DataFrame:
    """(question_id, tool, input, seen) of a round's steps; those of unknown tools are left out."""
    search, fetch, names = ("search_document", "get_section", "list_sections") if documents else ("search_codebase", "get_file", "list_files")
    used = {r["tool"] for r in said.select("tool").distinct().filter(F.col("tool").isin(search, fetch, names)).collect()}
    out = said.limit(0).withColumn("seen", F.lit(""))
    for tool, look in ((search, _searched), (fetch, _fetched)):
        if tool in used:
            own = said.filter(F.col("tool") == tool)
            out = out.unionByName(own.join(look(index, own.select("input").distinct()), "input").select(*out.columns))
    if names in used:
        table = retrieval.sections(index.chunks) if documents else retrieval.file_list(index.chunks)
        out = out.unionByName(said.filter(F.col("tool") == names).withColumn("seen", _listed("Sections" if documents else "Files", table)))
    return out.filter(strip(F.col("seen")) != "")


# ---------------------------------------------------------------- rounds
def gather(index: Index, questions: DataFrame, models: Models, documents: bool = False) -> DataFrame:
    """(question_id, question, context, steps) of ``questions`` (question_id, question, context): at most ``MOST_STEPS`` rounds, each over all open questions."""
    question, context = (F.coalesce(n, F.lit("")).alias(n) for n in ("question", "context"))
    state = written(questions.select("question_id", question, context, F.array().cast(_STEPS).alias("steps"), F.lit(models.planner is not None).alias("open")), "state")
    planner = models.planner

    def call(question: str, context: str, seen: list[str]) -> tuple[str, str] | None:
        try:
            return planner.step(question, context, seen)
        except Exception as error:  # a model's failure leaves what is known
            logging.getLogger(__name__).warning("the planner failed: %s", error)
            return None

    for _ in range(MOST_STEPS if planner is not None else 0):
        asked = state.filter("open").withColumn("seen", F.transform("steps", lambda x: x["seen"]))
        said = written(_by_row(asked, call, "tool string, input string", "question", "context", "seen").filter("tool IS NOT NULL"), "said")
        if said.isEmpty():
            break
        seen = _observed(index, said.withColumn("input", F.coalesce("input", F.lit(""))), documents)
        new = seen.select("question_id", F.array(F.struct("tool", "input", "seen")).cast(_STEPS).alias("new"))
        went_on = said.select("question_id", F.lit(True).alias("went_on"))
        joined = state.join(went_on, "question_id", "left").join(new, "question_id", "left")
        steps = F.concat("steps", F.coalesce("new", F.array().cast(_STEPS)))
        state = written(joined.select("question_id", "question", "context", steps.alias("steps"), F.coalesce("went_on", F.lit(False)).alias("open")), "state")
    return state.drop("open")


def answers(index: Index, questions: DataFrame, models: Models | None = None, documents: bool = False) -> DataFrame:
    """(question_id, steps, answer) of ``questions`` (question_id, question): what ``Index.answer`` says to each, as one text."""
    models = models or Models()
    asked = expanded(questions.select("question_id", F.coalesce("question", F.lit("")).alias("question")), models)
    semantic, near = (written(x, "hits") for x in index.retrieve(asked))
    contexts = retrieval.context_blocks(semantic, near, index.chunks)
    found = gather(index, asked.join(contexts, "question_id", "left").select("question_id", "question", "context"), models, documents)
    passages = F.array_join(F.filter(F.concat(F.array("context"), F.transform("steps", lambda x: x["seen"])), lambda x: x != ""), _JOINT)
    opening, generator = DOCUMENT_PROMPT if documents else CODE_PROMPT, models.generator
    prompts = found.withColumn("prompt", F.concat(F.lit(opening + "\n\n"), passages, F.lit("\n\n"), "question", F.lit("\n")))
    said = written(_by_row(prompts, lambda prompt: ("".join(generator.stream(prompt)),), "answer string", "prompt"), "answers")
    return found.select("question_id", "steps").join(said, "question_id")
