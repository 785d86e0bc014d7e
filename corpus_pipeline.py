"""The corpus pipeline: five stages over ``documents``, each an operator of ``corpusloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before
the next one. All but the last return the columns of ``documents``:

1. toxicity: documents whose score reaches ``TOXIC`` go;
2. line dedup: lines that occur in ``LINE_DOCS`` unequal texts or more go (``n_chars`` follows the text);
3. MinHash near-dedup: one document of each group stays, the one with the smallest id, and
   of a line of more than ``LONG_LINE`` words that several of those hold the first occurrence;
4. benchmark decontamination: documents with a confirmed benchmark item go;
5. SentencePiece: ids of what is left, decoded again to prove the round trip.

Defined results: documents with null, empty or very long texts pass the filters like any
other (an empty text has no neighbour, no shingle and no leak) and get an empty list of ids at
the end; rows without an id stay; extra columns are carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, unused, written
from corpusloom.llm.decontaminate import without_leaks
from corpusloom.llm.line_dedup import LineIndex, drop_lines, keep_first_of_long
from corpusloom.llm.near_dups import keep_one_of_each
from corpusloom.llm.piece_codec import encode_checked
from corpusloom.llm.toxicity import score, train
from corpusloom.session import ship

#: Score from which a document is rejected as toxic.
TOXIC = 0.7
#: Unequal texts in which a line occurs before it counts as boilerplate.
LINE_DOCS = 10
#: A line of more words than this stays in one document only.
LONG_LINE = 50
#: Jaccard similarity of word shingles, in percent, from which documents are near copies.
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    index = train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name, evidence = unused(docs.columns, "score", "evidence")
    return score(docs, index, name=name, evidence=evidence).filter(F.col(name) < TOXIC).select(*docs.columns)


def _recounted(cleaned: DataFrame, docs: DataFrame, dropped: str) -> DataFrame:
    """The columns of ``docs`` with ``n_chars`` of the rows that lost lines, as the column ``dropped`` counts them."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return cleaned.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # equal texts count once: near-dedup still needs the lines of a group of copies to keep one of them
    lines, dropped = unused(docs.columns, "n_lines", "n_dropped")
    cleaned = drop_lines(docs, LineIndex.build(docs.select("text").distinct(), min_docs=LINE_DOCS), n_lines=lines, n_dropped=dropped)
    return _recounted(cleaned, docs, dropped)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = keep_one_of_each(docs, percent=NEAR_PERCENT)
    # only now, so that no copy that stays is emptied for one that goes
    dropped, = unused(docs.columns, "n_dropped")
    return _recounted(keep_first_of_long(kept, LONG_LINE, n_dropped=dropped), docs, dropped)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = encode_checked(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", pieces),
]

#: SQL can express neither the learned stages nor the piece ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each but the last is written in between."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
