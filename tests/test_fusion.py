"""Bounded fusion against the fused ranks of all chunks, and what it reads and writes."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fusion, ranking
from corpusloom.operators.ranking import bm25_index, bm25_matches, diverse_top, fused, rank_lists


def corpus(spark, n, text_ids, seed=0, words=12):
    """Chunks with copies, equal and missing vectors, and texts of few frequent words (whose weights may be below zero)."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        vector = r.choice([[float(r.randint(-2, 2)), float(r.randint(0, 2))], [1.0, 1.0], [0.0, 0.0], None])
        text = r.choice(["", None, "same text", " ".join(r.choice("abcdefghijklmnop"[:words]) for _ in range(r.randint(1, 9)))])
        rows.append((f"c{k}" if text_ids else k, f"p{min(r.randint(0, 9), 4)}" if k else "alone", text, vector))
    return spark.createDataFrame(rows, f"chunk_id {'string' if text_ids else 'long'}, path string, text string, embedding array<float>")


ASKED = [(0, "a b zz", [1.0, 0.5]), (1, "nothing known", [0.0, 1.0]), (2, "", None), (3, "same a a p", [-1.0, 0.0]), (4, None, [0.0, 0.0]), (5, "text", [1.0])]


def asked(spark, rows=ASKED):
    return spark.createDataFrame(rows, "query_id long, text string, vec array<float>")


def rounded(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["path"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize(("n", "text_ids", "k", "first"), [(150, False, 6, 4), (90, True, 3, 2), (60, False, 40, 8), (5, True, 6, None), (150, False, 5, None)])
def test_hits_equal_those_of_all_ranks(spark, n, text_ids, k, first):
    chunks = corpus(spark, n, text_ids, seed=n + k)
    index = bm25_index(chunks, keep=True)
    whole = diverse_top(fused(rank_lists(chunks, index, asked(spark))), "query_id", k)
    assert rounded(fusion.hybrid_search(chunks, index, asked(spark), k, first=first)) == rounded(whole)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(fusion, "MOST_CELLS", 30)
    monkeypatch.setattr(fusion, "BLOCK_CELLS", 7)
    chunks = corpus(spark, 80, False, seed=3).repartition(3)
    index = bm25_index(chunks, keep=True)
    whole = diverse_top(fused(rank_lists(chunks, index, asked(spark))), "query_id", 4)
    assert rounded(fusion.hybrid_search(chunks, index, asked(spark), 4, first=8)) == rounded(whole)


def test_many_tasks_agree_on_bounds_first(spark, monkeypatch):
    """40 tasks and lists of 8: nearly all rows are kept back, and the hits are those of all ranks."""
    calls = []
    plain = fusion._few
    monkeypatch.setattr(fusion, "_few", lambda *args: calls.append(1) or plain(*args))
    monkeypatch.setattr(fusion, "FEW", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        chunks = corpus(spark, 300, True, seed=8).repartition(40)
        index = bm25_index(chunks, keep=True)
        whole = diverse_top(fused(rank_lists(chunks, index, asked(spark))), "query_id", 4)
        assert rounded(fusion.hybrid_search(chunks, index, asked(spark), 4, first=8)) == rounded(whole)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(calls) >= 2


def test_hits_of_nothing(spark):
    chunks = corpus(spark, 20, True)
    index = bm25_index(chunks, keep=True)
    assert fusion.hybrid_search(chunks, index, asked(spark, []), 3).count() == 0
    none = chunks.limit(0)
    assert fusion.hybrid_search(none, bm25_index(none, keep=True), asked(spark), 3).columns == ["query_id", "chunk_id", "path", "score", "rank"]


def test_no_table_of_chunks_and_queries(spark, monkeypatch):
    """3,000 chunks and 6 queries: nothing that is written, brought to the driver or sorted has a row for each of both."""
    chunks = corpus(spark, 3000, False, seed=5)
    index = bm25_index(chunks, keep=True)
    sizes, plans = [], []
    plain = fusion.written

    def watched(df, label, **options):
        out = plain(df, label, **options)
        sizes.append(out.count())
        return out

    arrow = type(chunks).toArrow

    def to_arrow(df):
        out = arrow(df)
        sizes.append(out.num_rows)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(fusion, "written", watched)
    monkeypatch.setattr(type(chunks), "toArrow", to_arrow)
    assert fusion.hybrid_search(chunks, index, asked(spark), 3).count() == 18
    depth = fusion.FIRST + 3 * fusion.PER_HIT
    assert max(sizes) <= 8 * depth * len(ASKED) < 3000 * len(ASKED)
    assert not any("cosines" in p or "Generate" in p and "embedding" in p for p in plans)


def test_one_question_reads_few_row_groups(spark):
    """Postings of 4,000 chunks: the statistics of all but a few row groups exclude the terms, and scores equal those of unclustered postings."""
    r = random.Random(1)
    rows = [(k, "p", "the " + " ".join(f"w{r.randint(0, 5000)}" for _ in range(12)), [1.0]) for k in range(4000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, text string, embedding array<float>")
    index = bm25_index(chunks, keep=True, cluster=True, row_group=2048)
    terms, groups, read = ("w17", "w4242", "w999"), 0, 0
    for file in index.postings.inputFiles():
        meta = pq.ParquetFile(Path(file.removeprefix("file://"))).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            groups += 1
            read += any(stats.min <= t <= stats.max for t in terms)
    assert groups > 300 and 0 < read < groups / 100
    query = asked(spark, [(0, " ".join(terms), [1.0])])
    found = bm25_matches(index, query)
    plan = found._jdf.queryExecution().toString()
    assert all(f"EqualTo(term,{t})" in plan for t in terms)
    plain = bm25_matches(bm25_index(chunks), query)
    of = lambda df: sorted((x["chunk_id"], round(x["bm25"], 9)) for x in df.collect())
    assert of(found) == of(plain) and len(of(found)) > 10


def test_a_frequent_term_spreads_over_ranges_of_chunks(spark):
    chunks = spark.range(20_000).selectExpr("id AS chunk_id", "'p' AS path", "'the' AS text")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt, _ = ranking.clustered(ranking.postings_of(chunks))
        sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 4 and max(sizes) < 8_000
