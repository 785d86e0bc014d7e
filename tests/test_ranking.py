import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ranking


def _chunks(spark, texts):
    return spark.createDataFrame([(k, f"p{k % 2}", t, [float(k), 1.0]) for k, t in enumerate(texts)], "chunk_id long, path string, text string, embedding array<float>")


def _queries(spark, texts):
    return spark.createDataFrame([(0, k, t, [1.0, 0.0]) for k, t in enumerate(texts)], "question_id long, query_id long, text string, vec array<float>")


def brute_bm25(docs, query):
    tokens = [t.lower().split() if t else [] for t in docs]
    n, avg = len(docs), sum(map(len, tokens)) / len(docs)
    df = Counter(w for t in tokens for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = []
    for t in tokens:
        tf = Counter(t)
        out.append(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()))
    return out


def test_bm25_equals_the_formula(spark):
    docs = ["a b c", "a a d", "a", "", None, "b d d e"]
    query = "a d d zz"
    index = ranking.bm25_index(_chunks(spark, docs))
    found = {r["chunk_id"]: r["bm25"] for r in ranking.bm25_matches(index, _queries(spark, [query])).collect()}
    for k, score in enumerate(brute_bm25(docs, query)):
        assert found.get(k, 0.0) == pytest.approx(score)


def test_mean_weight_is_exact_in_any_order(spark):
    """300,000 terms: the share of the mean is that of the exact sum, however the terms lie in partitions."""
    counts = spark.range(300_000).select(F.concat(F.lit("t"), "id").alias("term"), F.when(F.col("id") == 0, 39_999).otherwise(F.col("id") * 7919 % 971 + 1).alias("df"))
    totals = spark.createDataFrame([(40_000, 1.0)], "n long, avgdl double")
    of = [math.log(40_000 - c + 0.5) - math.log(c + 0.5) for c in [39_999] + [k * 7919 % 971 + 1 for k in range(1, 300_000)]]
    mean = 0.25 * math.fsum(of) / len(of)
    for parts in (1, 7):
        found = ranking.weighted(counts.repartition(parts), totals).filter("term = 't0'").first()["idf"]
        assert found == pytest.approx(mean, rel=1e-15, abs=0)


def test_equal_counts_of_words_score_alike(spark):
    """60 chunks of the same words in another order each: sums in the order of their words would differ in the last digits, and round apart now and then."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(40) for _ in range(k % 4 + 1)]
    texts = [" ".join(r.sample(words, len(words))) for _ in range(60)] + [" ".join(r.sample(words, r.randint(1, 20))) + " other" for _ in range(300)]
    found = ranking.bm25_matches(ranking.bm25_index(_chunks(spark, texts).repartition(5)), _queries(spark, [" ".join(words)])).filter("chunk_id < 60").collect()
    assert len(found) == 60 and len({x["bm25"] for x in found}) == 1


def test_distributed_rank_equals_a_plain_sort(spark):
    rows = [(g, k, float((k * 7919) % 13)) for g in range(3) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, chunk_id long, score double")
    found = {(r["g"], r["chunk_id"]): r["r"] for r in ranking.with_rank(df, "g", "score", "r").collect()}
    for g in range(3):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1]))
        assert [found[g, x[1]] for x in own] == list(range(1, 501))


def test_rank_of_nothing(spark):
    df = spark.createDataFrame([], "g long, chunk_id long, score double")
    assert ranking.with_rank(df, "g", "score", "r").count() == 0


def test_diversity_cap_walks_the_ranking(spark):
    rows = [(0, k, p, 1.0 - k / 10) for k, p in enumerate("AAAABBC")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, path string, score double")
    assert [r["path"] for r in ranking.diverse_top(df, "query_id", 5).orderBy("rank").collect()] == list("AAABB")


def test_fusion_of_mirrored_ranks_ties(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 1, 1)], "chunk_id long, vector_rank long, bm25_rank long")
    found = {r["chunk_id"]: r["score"] for r in ranking.fused(df).collect()}
    assert found[0] == found[1] == pytest.approx(1 / 61 + 1 / 62) and found[2] == pytest.approx(2 / 61)


def test_bonus_for_several_queries(spark):
    hits = spark.createDataFrame([(q, c, "p", 0.03) for c in range(3) for q in range(c + 1)], "query_id long, chunk_id long, path string, score double")
    found = {r["chunk_id"]: r["score"] for r in ranking.merged(hits, _queries(spark, ["x", "y", "z"])).collect()}
    assert found == {0: pytest.approx(0.03), 1: pytest.approx(0.0345), 2: pytest.approx(0.039)}


def test_cosine_without_length(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(ranking.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(1.0)]


def test_cosines_in_blocks_equal_the_column(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_CELLS", 5)
    chunks = spark.createDataFrame([(k, "p", [float(k), 1.0 - k]) for k in range(9)] + [(9, "p", [0.0, 0.0]), (10, "p", None), (11, "p", [1.0]), (12, "p", [None, 1.0])], "chunk_id long, path string, embedding array<float>")
    asked = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [3.0]), ("e", [0.5, None])], "query_id string, vec array<float>")
    plain = chunks.crossJoin(asked).select("query_id", "chunk_id", F.round(ranking.cosine(F.col("embedding"), F.col("vec")), 9).alias("cosine"))
    for most in (10_000, 2):
        monkeypatch.setattr(ranking, "BROADCAST_QUERIES", most)
        own = ranking.cosine_scores(chunks, asked).select("query_id", "chunk_id", F.round("cosine", 9).alias("cosine"))
        assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert ranking.cosine_scores(chunks, asked.limit(0)).count() == 0
