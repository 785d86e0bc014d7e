"""Ranks of all chunks, exchanged in compressed pieces, against sorted scores."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_fusion import ASKED, asked, corpus

from corpusloom import queries
from corpusloom.operators import placing, ranking


def of(df):
    return sorted((r["query_id"], r["chunk_id"], r["path"], r["vector_rank"], r["bm25_rank"]) for r in df.collect())


def sorted_ranks(chunks, index, queries):
    """All scores in one table, and its rows sorted for each list."""
    scored = ranking.cosine_scores(chunks, queries).join(ranking.bm25_matches(index, queries), ["query_id", "chunk_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    return ranking.with_rank(ranking.with_rank(scored, "query_id", "cosine", "vector_rank"), "query_id", "bm25", "bm25_rank")


@pytest.mark.parametrize(("text_ids", "cells", "most", "queries"), [(False, 400, 25, 500), (True, 6, 1, 500), (True, 10_000, 10_000, 2)])
def test_ranks_equal_those_of_sorted_scores(spark, monkeypatch, text_ids, cells, most, queries):
    """300 chunks with copies, ties and unknown scores in blocks of 64 or one, lists in many ranges or one, and queries two at a time or all at once."""
    monkeypatch.setattr(ranking, "RANKED_CELLS", cells)
    monkeypatch.setattr(ranking, "RANKED_QUERIES", queries)
    monkeypatch.setattr(placing, "RANGE", most)
    chunks = corpus(spark, 300, text_ids, seed=most).repartition(3)
    index = ranking.bm25_index(chunks, keep=True)
    assert of(ranking.rank_lists(chunks, index, asked(spark))) == of(sorted_ranks(chunks, index, asked(spark)))


def test_ranks_of_nothing(spark):
    chunks = corpus(spark, 20, True)
    index = ranking.bm25_index(chunks, keep=True)
    names = ["query_id", "chunk_id", "path", "cosine", "bm25", "vector_rank", "bm25_rank"]
    assert ranking.rank_lists(chunks, index, asked(spark, [])).columns == names
    none = chunks.limit(0)
    assert ranking.rank_lists(none, ranking.bm25_index(none, keep=True), asked(spark)).count() == 0


def test_no_stored_table_of_chunks_and_queries(spark, monkeypatch):
    """900 chunks and 6 queries: no table that is stored has a row for each of both, and what travels between blocks and lists has a row for each of those."""
    chunks = corpus(spark, 900, False, seed=2)
    index = ranking.bm25_index(chunks, keep=True)
    sizes, plain = [], ranking.written

    def watched(df, label, **options):
        out = plain(df, label, **options)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ranking, "written", watched)
    found = ranking.rank_lists(chunks, index, asked(spark))
    assert found.count() == 900 * len(ASKED)
    assert sizes and max(sizes) <= 900
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan


def test_a_few_bytes_for_a_score():
    values = np.unique(np.random.default_rng(0).integers(-(10**9), 10**9, 4000))
    data = placing._steps(values)
    assert (placing._rising(values[0], data, len(values)) == values).all() and len(data) < 3 * len(values)
    ends = np.array([0, 1 << 62, 255, 256, 7])
    assert (placing.unpacked(placing.packed(ends), len(ends)) == ends).all() and (placing.unpacked(placing.packed(ends[:0]), 0) == ends[:0]).all()


def test_orders_follow_rounded_scores():
    score = np.array([0.5, -0.5, np.nan, 0.0, -0.0, 2.5e-9, 3e-9, 1.0, 7.0])
    found = placing.descending(score, np.array([False] * 8 + [True]))
    assert list(found) == [-500_000_000, 500_000_000, found.min(), 0, 0, -3, -3, -(10**9), placing.LAST]


def test_a_count_that_does_not_fit_is_an_error(spark):
    import pyarrow as pa

    block = pa.table({"chunk_id": [1, 2], "block": [0, 0]})
    scores = lambda t: (np.array([[5, 6]]), None)
    one = placing._counted(np.zeros((1, 1), np.int64))(placing._sent(lambda t: (np.array([[5, 5]]), None), [np.empty(0, np.int64)])(block))
    with pytest.raises(ValueError, match="2 scores of a block, counts of 1"):
        placing._placed(scores, "chunk_id", lambda t, more, ranks: t)(block, one)


@pytest.mark.parametrize("name", ["rrf_fusion", "rank_lists"])
def test_queries_store_neither_texts_nor_rows_of_chunks_and_queries(spark, monkeypatch, name):
    stored = []
    for module in (queries, ranking):
        monkeypatch.setattr(module, "written", lambda df, label, plain=module.written, **options: stored.append(set(df.columns)) or plain(df, label, **options))
    assert queries.QUERIES[name](spark, SF).count() > 0
    assert stored and not any(x >= {"query_id", "chunk_id"} or x >= {"chunk_id", "text"} for x in stored)
