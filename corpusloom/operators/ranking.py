"""Scoring and ranking of chunks for batches of queries.

Tables: ``chunks`` (chunk_id, path, text, embedding, ...), ``queries`` (question_id, query_id,
text, vec). An index over chunks is a set of tables keyed by chunk_id. Every ranking
orders by a score rounded to nine places, then by chunk_id, so that equal scores (and
sums taken in another order) rank alike everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.scratch import written
from ..functions.text import strip, words
from .placing import descending, placed

#: Fixed values of BM25 and of rank fusion.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
PER_PATH = 3
BONUS = 0.15
NO_NORM = 1e-10
#: Rows of queries, and of their terms, that a broadcast may hold: some tens of MB at most.
BROADCAST_QUERIES, BROADCAST_TERMS = 10_000, 500_000
#: Cosines that a task holds at once.
BLOCK_CELLS = 2_000_000
#: The same where cosines are added up in order, so that sums stay in a core's cache.
EXACT_CELLS = 50_000
#: Queries whose ranks of all chunks are made at once, and about how many scores a block of chunks has.
RANKED_QUERIES, RANKED_CELLS = 500, 800_000
#: Terms that become a filter of the scan, and the size of a row group of clustered postings.
PUSHED_TERMS, ROW_GROUP = 500, 4 << 20


# ---------------------------------------------------------------- BM25
@dataclass(frozen=True)
class Bm25:
    """postings (term, chunk_id, tf, dl), lengths (chunk_id, dl), terms (term, df, idf), totals (n, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    totals: DataFrame


def token_counts(chunks: DataFrame) -> DataFrame:
    """chunk_id, n_tokens and n_distinct of every chunk."""
    own = chunks.select("chunk_id", words(F.col("text")).alias("w"))
    return own.select("chunk_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, words) to a row for each word a chunk holds; a chunk is one row, so nothing is shuffled to count its words."""
    for batch in batches:
        lists = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.list_flatten(lists).dictionary_encode()
        width = max(1, len(found.dictionary))
        key, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + found.indices.to_numpy(), return_counts=True)
        row = key // width
        yield pa.RecordBatch.from_arrays(
            [found.dictionary.take(pa.array(key % width)), batch.column(0).take(pa.array(row)), pa.array(times.astype(np.int64)), pa.array(sizes[row])], ["term", "chunk_id", "tf", "dl"])


def postings_of(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf and dl (words of the chunk). One scan without a shuffle."""
    own = chunks.select("chunk_id", words(F.col("text")).alias("w"))
    kind = StructType([StructField("term", StringType()), own.schema["chunk_id"], StructField("tf", LongType()), StructField("dl", LongType())])
    return own.mapInArrow(_runs, kind)


def clustered(postings: DataFrame, row_group: int = ROW_GROUP) -> tuple[DataFrame, dict[str, object]]:
    """``postings`` dealt by ranges of (term, chunk_id) and sorted, and the options to write them with.

    A term lies in few row groups, whose statistics say so; a frequent term spreads over ranges of chunks.
    """
    return postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"), {"parquet.block.size": row_group}


def bm25_index(chunks: DataFrame, keep: bool = False, cluster: bool = False, row_group: int = ROW_GROUP) -> Bm25:
    """BM25 statistics; with ``keep`` the postings are written and the other tables made from them, with ``cluster`` they are clustered by term for many questions to come."""
    lengths = chunks.select("chunk_id", F.size(words(F.col("text"))).cast("long").alias("dl"))
    postings = postings_of(chunks)
    if keep:
        postings = written(postings, "postings")
        if cluster:  # ranges are sampled, so words are counted into a table first
            dealt, options = clustered(postings, row_group)
            postings = written(dealt, "clustered", **options)
        totals = chunks.agg(F.count("*").alias("n")).crossJoin(postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("all")))
        totals = written(totals.select("n", F.coalesce(F.try_divide("all", "n"), F.lit(0.0)).alias("avgdl")), "totals")
    else:
        totals = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))
    terms = weighted(postings.groupBy("term").agg(F.count("*").alias("df")), totals, keep)
    return Bm25(postings, lengths, written(terms, "terms") if cluster else terms, totals)


def exact_sum(value: Column) -> Column:
    """The sum of doubles in 20 decimal places, alike in any order; doubles would differ in their last digits, so that rows of equal values round apart."""
    return F.sum(value.cast("decimal(38,20)")).cast("double")


def weighted(counts: DataFrame, totals: DataFrame, keep: bool = False) -> DataFrame:
    """term, df and idf of ``counts`` (term, df); terms of most chunks, whose weight would fall below zero, get a share of the mean."""
    raw = counts.crossJoin(F.broadcast(totals)).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    raw = written(raw, "document-frequencies") if keep else raw
    floor = raw.agg((EPSILON * F.try_divide(exact_sum(F.col("raw")), F.count("*"))).alias("floor"))
    return raw.crossJoin(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and how often the query has it."""
    return queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def any_of(name: str, values: list[str]) -> Column:
    """Equality with one of ``values`` as a balanced tree: each comparison reaches the statistics of row groups, which an IN of many values doesn't."""
    if len(values) <= 1:
        return F.col(name) == values[0] if values else F.lit(False)
    half = len(values) // 2
    return any_of(name, values[:half]) | any_of(name, values[half:])


def bm25_matches(index: Bm25, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id and the BM25 score of chunks that hold a query's term; all others score 0.

    The queries' terms are counted. Up to ``PUSHED_TERMS`` of them are pushed into the scan of the postings, which skips the row groups of other terms
    where they are clustered; up to ``BROADCAST_TERMS`` rows are broadcast, and beyond that joined.
    """
    asked = written(query_terms(queries).join(index.terms, "term"), "asked")
    names = [r["term"] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    postings = index.postings.filter(any_of("term", sorted(names))) if len(names) <= PUSHED_TERMS else index.postings
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return (
        postings.join(F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked, "term").crossJoin(F.broadcast(index.totals))
        .groupBy("query_id", "chunk_id").agg(exact_sum(part).alias("bm25"))
    )


def asked_terms(index: Bm25, texts: DataFrame) -> pa.Table:
    """place, term, weight (times x idf) and code (of the term) of a block's queries (query_id is the place) that the index knows, sorted by code; codes follow the terms' order."""
    found = query_terms(texts).join(index.terms, "term").select(F.col("query_id").alias("place"), "term", (F.col("times") * F.col("idf")).alias("weight")).toArrow()
    found = found.sort_by([("term", "ascending"), ("place", "ascending")])
    return found.append_column("code", found.column("term").combine_chunks().dictionary_encode().indices.cast(pa.int32()))


def asked_postings(index: Bm25, asked: pa.Table) -> DataFrame:
    """chunk_id, code, tf, dl of the asked terms' postings. Few terms are a filter of the scan, more are joined."""
    terms = asked.group_by(["code", "term"]).aggregate([])
    names = terms.column("term").to_pylist()
    own = index.postings.filter(any_of("term", sorted(names))) if len(names) <= PUSHED_TERMS else index.postings
    codes = index.postings.sparkSession.createDataFrame(terms, "code int, term string")
    return own.join(F.broadcast(codes) if len(names) <= BROADCAST_TERMS else codes, "term").select("chunk_id", "code", "tf", "dl")


def run_heads(ids: pa.Array) -> np.ndarray:
    """Where a run of equal ids begins."""
    out = np.ones(len(ids), bool)
    out[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    return out


# ---------------------------------------------------------------- vectors
def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_dot(vector, vector))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a vector without length gives 0."""
    return _over(_dot(a, b), norm(a) * norm(b))


def _over(product: Column, length: Column) -> Column:
    return product / F.when(length == 0, F.lit(NO_NORM)).otherwise(length)


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y``, added up in the order of the columns: the same bits for equal rows, wherever they stand and on any machine."""
    out, part = np.zeros((len(x), y.shape[1])), np.empty((len(x), y.shape[1]))
    for k in range(x.shape[1]):
        out += np.multiply(x[:, k : k + 1], y[k], out=part)
    return out


def cosine_blocks(vectors: list[list[float] | None], exact: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    """A function of batches with an ``embedding``: slices of them, their cosines with ``vectors`` (a column each), and where those are unknown.

    With ``exact`` they are added up in order, which takes longer than a product of matrices.
    """
    places: dict[int, list[int]] = {}
    for at, vector in enumerate(vectors):
        if vector is not None and None not in vector:
            places.setdefault(len(vector), []).append(at)
    by_size = {n: (np.array(at), np.array([vectors[k] for k in at], dtype=float).reshape(len(at), n).T) for n, at in places.items()}
    step = max(1, (EXACT_CELLS if exact else BLOCK_CELLS) // max(1, len(vectors)))
    squares = lambda x: _in_order(x * x, np.ones((x.shape[1], 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                own = part.column("embedding")
                sizes = pc.fill_null(pc.list_value_length(own), -1).to_numpy(zero_copy_only=False)
                out = np.zeros((part.num_rows, len(vectors)))
                unknown = np.ones(out.shape, dtype=bool)
                for n, (at, asked) in by_size.items():
                    here = np.flatnonzero(sizes == n)
                    flat = pc.list_flatten(own.take(pa.array(here)))
                    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(here), n)
                    length = np.sqrt(squares(x) * squares(asked.T).T) if exact else np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(asked, axis=0))
                    out[np.ix_(here, at)] = (_in_order(x, asked) if exact else x @ asked) / np.where(length == 0, NO_NORM, length)
                    unknown[np.ix_(here, at)] = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(here), n).any(axis=1)[:, None]
                yield part, out, unknown

    return score


def _cosines(vectors: list[list[float] | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches (chunk_id, path, embedding): instead of the embedding the cosines with ``vectors``, in their order."""
    blocks = cosine_blocks(vectors)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, out, unknown in blocks(batches):
            lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * len(vectors), pa.array(out.ravel(), mask=unknown.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("chunk_id"), part.column("path"), lists], ["chunk_id", "path", "cosines"])

    return score


def cosine_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, path and cosine of every chunk for every query; null where a vector is, has a null, or sizes differ.

    The stated query set goes against all rows in blocks of ``BROADCAST_QUERIES`` at most; a task multiplies slices of its
    rows with a block's vectors, ``BLOCK_CELLS`` results at a time.
    """
    own = chunks.select("chunk_id", "path", "embedding")
    kept = StructType([own.schema["chunk_id"], own.schema["path"], StructField("cosines", ArrayType(DoubleType()))])
    asked = written(queries.select("query_id", "vec"), "queries")
    named = StructType([StructField("place", IntegerType()), asked.schema["query_id"]])
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))
    out = None
    for k in range(blocks):
        few = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).collect()
        ids = chunks.sparkSession.createDataFrame([(at, row["query_id"]) for at, row in enumerate(few)], named)
        rows = own.mapInArrow(_cosines([row["vec"] for row in few]), kept).select("chunk_id", "path", F.posexplode("cosines").alias("place", "cosine"))
        made = rows.join(F.broadcast(ids), "place").select("query_id", "chunk_id", "path", "cosine")
        out = made if out is None else out.unionByName(made)
    return out


# ---------------------------------------------------------------- ranks
def with_rank(df: DataFrame, by: str, score: str, rank: str, tie: str = "chunk_id") -> DataFrame:
    """``df`` with ``rank`` (long, from 1) by falling ``score`` within ``by``, for groups of any size.

    Rows are dealt by ranges of (group, score, tie), so one group spreads over many
    tasks; rows in a range are numbered as they are written, and each range's offset
    comes from a table with a row per range and group.
    """
    keys = [F.col(by), F.desc("__s"), F.col(tie)]
    dealt = df.withColumn("__s", F.round(score, 9)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = written(dealt.withColumn("__m", F.monotonically_increasing_id()), f"rank-{rank}")
    ranges = numbered.groupBy(F.col(by).alias("__g"), F.shiftright("__m", 33).alias("__p")).agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.select("__g", "__p", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    placed = numbered.withColumn("__q", F.shiftright("__m", 33))
    joined = placed.join(offsets, placed[by].eqNullSafe(offsets["__g"]) & (placed["__q"] == offsets["__p"]))
    return joined.select(*df.columns, (F.col("__m") + F.col("__shift")).alias(rank))


def best_per_group(df: DataFrame, by: list[str], order: list[Column], most: int, place: str | None = None) -> DataFrame:
    """The first ``most`` rows of each group; Spark limits groups before the shuffle, so no group is gathered whole."""
    out = df.withColumn(place or "__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(place or "__place") <= most)
    return out if place else out.drop("__place")


def diverse_top(df: DataFrame, by: str, k: int, score: str = "score", per_path: int = PER_PATH) -> DataFrame:
    """The k best rows of each group with at most ``per_path`` of a path, and ``rank`` (from 1)."""
    order = [F.desc(F.round(score, 9)), F.col("chunk_id")]
    return best_per_group(best_per_group(df, [by, "path"], order, per_path), [by], order, k, "rank")


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """query_id, chunk_id, path, score, rank by cosine alone."""
    return diverse_top(cosine_scores(chunks, queries).withColumnRenamed("cosine", "score"), "query_id", k)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, code, tf, dl) to a row for each run of a chunk: chunk_id, dl, codes and tfs."""
    for batch in batches:
        if batch.num_rows:
            at = np.flatnonzero(run_heads(batch.column(0)))
            ends, first = np.append(at, batch.num_rows).astype(np.int32), pa.array(at)
            lists = [pa.ListArray.from_arrays(ends, batch.column(k).cast(pa.int32())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(3).take(first), *lists], ["chunk_id", "dl", "codes", "tfs"])


def _blocks(chunks: DataFrame, index: Bm25, asked: pa.Table, queries: int) -> DataFrame:
    """A stored row for each chunk: chunk_id, path, embedding, dl, found (codes and tfs of the asked terms that it holds) and block, which rises with chunk_id."""
    own = chunks.select("chunk_id", "path", "embedding")
    postings = asked_postings(index, asked)
    kind = StructType([own.schema["chunk_id"], StructField("dl", LongType()), StructField("codes", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))])
    runs = postings.mapInArrow(_gathered, kind).groupBy("chunk_id").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("codes", "tfs")).alias("found"))
    rows = own.join(runs, "chunk_id", "left").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").withColumn("__m", F.monotonically_increasing_id())
    place = F.floor(F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(max(64, RANKED_CELLS // queries)))
    return written(rows.withColumn("block", F.shiftleft(F.shiftright("__m", 33), 33) + place).drop("__m"), "blocks")


def _scores(vectors: list, asked: pa.Table, avgdl: float):
    """Rows of ``_blocks`` to the orders of their cosines and of their BM25 scores (queries x 2 x rows as one axis), and both scores; alike for equal rows, wherever they stand."""
    queries = len(vectors)
    code, place, weight = (asked.column(c).to_numpy() for c in ("code", "place", "weight"))
    bounds = np.searchsorted(code, np.arange(int(code.max(initial=-1)) + 2))
    cosines = cosine_blocks(vectors, exact=True)
    step = max(1, BLOCK_CELLS // (4 * queries))

    def bm25(rows: pa.Table) -> np.ndarray:
        found = rows.column("found").combine_chunks()
        runs = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
        lists = pc.list_flatten(found)
        sizes = pc.list_value_length(pc.struct_field(lists, 0)).to_numpy(zero_copy_only=False).astype(np.int64)
        own, tf = (pc.list_flatten(pc.struct_field(lists, k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        row = np.repeat(runs, sizes)
        order = np.lexsort((own, row))  # terms in one order
        own, tf, row = own[order], tf[order], row[order]
        dl = pc.fill_null(rows.column("dl"), 0).to_numpy()[row]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        each = bounds[own + 1] - bounds[own]
        at = np.arange(each.sum()) - np.repeat(each.cumsum() - each, each) + np.repeat(bounds[own], each)
        return np.bincount(np.repeat(row, each) * queries + place[at], weight[at] * np.repeat(part, each), len(rows) * queries).astype(float).reshape(len(rows), queries)

    def run(rows: pa.Table) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found = list(cosines(rows.select(["embedding"]).combine_chunks().to_batches()))
        cosine, unknown = (np.vstack([x[k] for x in found]).T for k in (1, 2))
        score = np.vstack([bm25(rows.slice(k, step)) for k in range(0, len(rows), step)]).T
        return np.vstack([descending(cosine, unknown), descending(score)]), (cosine, unknown, score)

    return run


def _rank_rows(queries: pa.Array):
    """A block's rows, scores and ranks to a row for each chunk and query."""

    def run(rows: pa.Table, scores: tuple[np.ndarray, np.ndarray, np.ndarray], ranks: np.ndarray) -> pa.Table:
        cosine, unknown, score = scores
        query, chunk = (pa.array(x.ravel()) for x in np.indices(cosine.shape, np.int32))
        columns = [queries.take(query), rows.column("chunk_id").take(chunk), rows.column("path").take(chunk), pa.array(cosine.ravel(), mask=unknown.ravel()), pa.array(score.ravel()), *(pa.array(x.ravel()) for x in np.split(ranks, 2))]
        return pa.table(columns, ["query_id", "chunk_id", "path", "cosine", "bm25", "vector_rank", "bm25_rank"])

    return run


def rank_lists(chunks: DataFrame, index: Bm25, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, path, cosine, bm25 and both ranks (from 1) over all chunks; ``RANKED_QUERIES`` queries at a time."""
    spark = chunks.sparkSession
    asked = written(queries.select("query_id", "text", "vec"), "asked-queries")
    kind = StructType([asked.schema["query_id"], chunks.schema["chunk_id"], chunks.schema["path"], *(StructField(x, DoubleType()) for x in ("cosine", "bm25")), *(StructField(x, LongType()) for x in ("vector_rank", "bm25_rank"))])
    avgdl = index.totals.select("avgdl").first()[0]
    blocks, out = max(1, -(-asked.count() // RANKED_QUERIES)), None
    for k in range(blocks):
        few = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).toArrow().combine_chunks()
        if not len(few):
            continue
        texts = spark.createDataFrame(list(enumerate(few.column("text").to_pylist())), "query_id int, text string")
        terms = asked_terms(index, texts)
        rows = _blocks(chunks, index, terms, len(few))
        made = placed(rows, _scores(few.column("vec").to_pylist(), terms, avgdl), 2 * len(few), _rank_rows(few.column("query_id").combine_chunks()), kind)
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], kind) if out is None else out


def fused(ranks: DataFrame) -> DataFrame:
    """``ranks`` with ``score``, the reciprocal rank fusion of both lists."""
    return ranks.withColumn("score", 1.0 / (RRF_K + F.col("vector_rank")) + 1.0 / (RRF_K + F.col("bm25_rank")))


# ---------------------------------------------------------------- several queries of a question
def merged(hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """question_id, chunk_id, path, hits, score, rank: best score of a chunk, raised by 15 % for each further query that found it."""
    best = (
        hits.join(queries.select("question_id", "query_id"), "query_id").groupBy("question_id", "chunk_id", "path")
        .agg(F.count("*").alias("hits"), F.max("score").alias("best"))
    )
    raised = best.withColumn("score", F.col("best") * (1 + BONUS * (F.col("hits") - 1))).drop("best")
    return diverse_top(raised, "question_id", k)


def expanded(questions: DataFrame, most: int = 2) -> DataFrame:
    """question_id, query_id (from 0) and text: the question and the first lines of ``response`` that differ from it.

    Blank lines don't count; a null response leaves the question alone.
    """
    own = F.filter(F.transform(F.split(strip(F.coalesce("response", F.lit(""))), "\n"), strip), lambda x: (x != "") & (x != F.col("question")))
    return questions.select("question_id", F.posexplode(F.concat(F.array("question"), F.slice(own, 1, most))).alias("query_id", "text")).withColumn("query_id", F.col("query_id").cast("long"))
