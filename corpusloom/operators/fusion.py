"""Fused search that doesn't rank everything: a threshold algorithm over the list of cosines and that of BM25 scores.

A round takes for each query the ``depth`` best chunks of either list, which each task picks among its own rows. Their exact ranks in both lists come
from counting: a task counts, for each candidate, how many of its chunks stand above it. A chunk that is in neither list has at most the
reciprocal ranks that follow both lists' ends; once the last hit scores more than that, nothing unseen can change the answer. Queries that
aren't decided go into a deeper round, and a round as deep as the index has seen every chunk.

Scores exist only inside tasks, a slice of chunks at a time: no table has a row for a query and a chunk but that of the candidates. Postings of the asked terms
are dealt by chunk once and stay with the executors for a block of queries. Candidates of a block are held on the driver and sent to tasks, ``MOST_CELLS`` of
each list at most, as deeper rounds take fewer queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.scratch import written
from .ranking import B, BLOCK_CELLS, K1, PER_PATH, RRF_K, Bm25, asked_postings, asked_terms, best_per_group, cosine_blocks, diverse_top, run_heads

#: Depth of the first round beside ``PER_HIT`` for each hit that is asked for, and by what it grows. The k-th hit of one list alone scores above
#: the bound of a list 2 k + RRF_K deep; the rest is for hits that few chunks of a path keep out.
FIRST, PER_HIT, GROWTH = 64, 8, 4
#: Candidates of one list that a block of queries holds.
MOST_CELLS = 500_000
#: Scores of each query that a task gives first where there are many tasks: the last of a list's depth among them bounds the list's scores from below.
FEW = 4
_NONE = -np.inf


# ---------------------------------------------------------------- what a task does
class _Best:
    """The ``most`` best rows (place, score, id) of each place so far, by falling score and then by id."""

    def __init__(self, most: int, least: np.ndarray):
        self.most, self.least, self.held, self.rows, self.room = most, least.copy(), [], 0, 2 * most * len(least) + 100_000

    def add(self, place: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        kept = np.flatnonzero(score >= self.least[place])
        self.held.append(pa.table({"place": place[kept].astype(np.int32), "score": score[kept], "chunk_id": ids.take(pa.array(kept))}))
        self.rows += len(kept)
        if self.rows > self.room:
            self.compact()

    def compact(self) -> pa.Table | None:
        if not self.held:
            return None
        every = pa.concat_tables(self.held)
        every = every.take(pc.sort_indices(every, [("place", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
        place = every.column("place").to_numpy()
        first = np.searchsorted(place, place)
        at = np.arange(len(place)) - first
        last = np.flatnonzero(at == self.most - 1)
        self.least[place[last]] = every.column("score").to_numpy()[last]
        every = every.filter(pa.array(at < self.most))
        self.held, self.rows = [every], every.num_rows
        return every

    def batches(self) -> Iterator[pa.RecordBatch]:
        every = self.compact()
        if every is not None:
            yield from every.select(["place", "chunk_id", "score"]).combine_chunks().to_batches()


class _Above:
    """How many rows stand above each of the candidates (place, score, id), by falling score and then by id; ``order`` sorts them by place, score and id."""

    def __init__(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray, order: np.ndarray):
        self.order, self.place, self.score, self.ids = order, place[order], score[order], ids[order]
        self.counts = np.zeros(len(place), np.int64)

    def add(self, place: int, score: np.ndarray, ids: pa.Array) -> None:
        lo, hi = np.searchsorted(self.place, [place, place + 1])
        own, counts = self.score[lo:hi], self.counts[lo:hi]
        left, right = np.searchsorted(own, score, "left"), np.searchsorted(own, score, "right")
        counts += np.bincount(left, minlength=hi - lo + 1)[::-1].cumsum()[::-1][1:]
        tied = np.flatnonzero(right > left)
        if len(tied):
            mine = ids.take(pa.array(tied)).to_numpy(zero_copy_only=False)
            for at in np.unique(left[tied]):
                rows = left[tied] == at
                end = int(right[tied[rows][0]])
                beaten = np.searchsorted(self.ids[lo + at : lo + end], mine[rows], "right")
                counts[at:end] += np.bincount(beaten, minlength=end - at + 1).cumsum()[:-1]

    def found(self, kind: int) -> pa.RecordBatch:
        some = np.flatnonzero(self.counts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(self.order[some].astype(np.int32)), pa.array(self.counts[some])], ["kind", "at", "n"])


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.round(score, 9) + 0.0


def _cosines(vectors: list):
    """Batches (chunk_id, embedding) to slices (ids, rounded cosines with a column for each query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for part, cosines, unknown in cosine_blocks(vectors)(batches):
            yield part.column("chunk_id"), np.where(unknown, _NONE, _rounded(cosines))

    return run


def _bm25(asked: pa.Table, queries: int, avgdl: float):
    """Batches (chunk_id, code, tf, dl) sorted by chunk to slices (ids, rounded scores); ``asked`` has code, place and weight, sorted by code."""
    code, place, weight = (asked.column(c).to_numpy() for c in ("code", "place", "weight"))
    bounds = np.searchsorted(code, np.arange(int(code.max(initial=-1)) + 2))
    most = max(1, BLOCK_CELLS // queries)

    def scores(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
        ids = rows.column("chunk_id").combine_chunks()
        heads = np.flatnonzero(run_heads(ids))
        own, tf, dl = (rows.column(c).to_numpy() for c in ("code", "tf", "dl"))
        each = bounds[own + 1] - bounds[own]
        at = np.arange(each.sum()) - np.repeat(each.cumsum() - each, each) + np.repeat(bounds[own], each)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        chunk = np.repeat(np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(ids)))), each)
        sums = np.bincount(chunk * queries + place[at], weight[at] * np.repeat(part, each), len(heads) * queries)
        return ids.take(pa.array(heads)), _rounded(sums).reshape(len(heads), queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            heads = np.append(np.flatnonzero(run_heads(rows.column("chunk_id").combine_chunks())), len(rows))
            last = heads[-2]  # its chunk may go on in the next batch
            for k in range(0, len(heads) - 2, most):
                yield scores(rows.slice(heads[k], min(heads[min(k + most, len(heads) - 2)], last) - heads[k]))
            rest = rows.slice(last)
        if rest is not None:
            yield scores(rest)

    return run


def _few(slices, queries: int, more):
    """(place, score): the ``FEW`` best scores of each query that ``more`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((FEW, queries), _NONE)
        for _, score in slices(batches):
            top = np.partition(np.vstack([top, np.where(more.listed(score), score, _NONE)]), -FEW, axis=0)[-FEW:]
        row, place = np.nonzero(top > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(top[row, place])], ["place", "score"])

    return run


def _lists(slices, floor: np.ndarray, most: int, more):
    """(place, chunk_id, score): of the chunks that ``more`` lists the ``most`` best of each query that score ``floor`` or more, and what ``more`` gives beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(most, floor)
        for ids, score in slices(batches):
            n = len(score)
            least = np.maximum(best.least, np.partition(score, n - most, axis=0)[n - most]) if n > most else best.least
            row, place = np.nonzero((score >= least) & more.listed(score))
            best.add(place, score[row, place], ids.take(pa.array(row)))
            more.add(ids, score)
        yield from best.batches()
        yield from more.batches()

    return run


class _SmallestIds:
    """Beside all cosines: the ``most`` smallest ids, as place -1."""

    def __init__(self, most: int):
        self.most, self.ids = most, None

    def listed(self, score: np.ndarray) -> np.ndarray:
        return np.ones(score.shape, bool)

    def add(self, ids: pa.Array, score: np.ndarray) -> None:
        every = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        self.ids = every.take(pc.bottom_k_unstable(every, min(self.most, len(every))))

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            n = len(self.ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), self.ids, pa.array(np.zeros(n))], ["place", "chunk_id", "score"])


class _NotZero:
    """Beside positive scores: which of ``ids`` (sent) score other than 0 for a query, as place - queries - 1."""

    def __init__(self, sent, queries: int):
        self.sent, self.queries, self.found = sent, queries, []

    def listed(self, score: np.ndarray) -> np.ndarray:
        return score > 0

    def add(self, ids: pa.Array, score: np.ndarray) -> None:
        rows = np.flatnonzero(pc.is_in(ids, value_set=pa.array(self.sent.value, ids.type)).to_numpy(zero_copy_only=False))
        row, place = np.nonzero(score[rows])
        self.found.append(pa.RecordBatch.from_arrays([pa.array((place - self.queries - 1).astype(np.int32)), ids.take(pa.array(rows[row])), pa.array(np.zeros(len(row)))], ["place", "chunk_id", "score"]))

    def batches(self) -> Iterator[pa.RecordBatch]:
        yield from self.found


def _counts(slices, queries: int, sent, which: int, kind: int):
    """(kind, at, n): for each candidate the chunks above it (``kind``), for each of their ids the chunks with smaller ones (``kind`` + 1), and all chunks (``kind`` + 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, alone, lists = sent.value
        zero = np.zeros(len(alone), np.int64)
        above, before, every = _Above(place, lists[which][0], ids, lists[which][1]), _Above(zero, zero.astype(float), alone, np.arange(len(alone))), 0
        for own, score in slices(batches):
            for k in range(queries):
                above.add(k, score[:, k], own)
            before.add(0, np.zeros(len(own)), own)
            every += len(own)
        yield from (above.found(kind), before.found(kind + 1))
        yield pa.RecordBatch.from_arrays([pa.array([kind + 2], pa.int32()), pa.array([0], pa.int32()), pa.array([every])], ["kind", "at", "n"])

    return run


def _picked(slices, sent):
    """(place, chunk_id, score) of the candidates (place, chunk_id) among the slices' chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, wanted = sent.value
        for ids, score in slices(batches):
            codes = pc.index_in(pa.array(wanted, ids.type), value_set=ids)
            some = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
            row = codes.take(pa.array(some)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(place[some]), ids.take(pa.array(row)), pa.array(score[row, place[some]])], ["place", "chunk_id", "score"])

    return run


# ---------------------------------------------------------------- a round
def _postings(index: Bm25, asked: pa.Table) -> DataFrame:
    """chunk_id, code, tf, dl of the asked terms' postings, dealt and sorted by chunk."""
    return asked_postings(index, asked).repartition("chunk_id").sortWithinPartitions("chunk_id", "code")


def _scored(chunks: DataFrame, index: Bm25, asked: pa.Table, vectors: list, depth: int, n: int, avgdl: float) -> pa.Table:
    """place, chunk_id, score and bound (of what wasn't seen) of a block's candidates."""
    spark, queries = chunks.sparkSession, len(vectors)
    own, held = chunks.select("chunk_id", "embedding"), _postings(index, asked).persist()
    rows = StructType([StructField("place", IntegerType()), own.schema["chunk_id"], StructField("score", DoubleType())])
    cosines, bm25 = _cosines(vectors), _bm25(asked, queries, avgdl)
    best = lambda df: best_per_group(df, ["place"], [F.desc("score"), F.col("chunk_id")], depth).toArrow()
    is_ = lambda table, test: table.filter(pa.array(test(table.column("place").to_numpy())))

    def listed(df: DataFrame, slices, more) -> pa.Table:
        """The lists of all tasks together; many tasks first agree on scores that a list can't end below."""
        least = np.full(queries, _NONE)
        if df.rdd.getNumPartitions() * FEW >= 2 * depth:
            few = df.mapInArrow(_few(slices, queries, more), StructType([rows["place"], rows["score"]]))
            last = best_per_group(few, ["place"], [F.desc("score")], depth, "at").filter(F.col("at") == depth).toArrow()
            least[last.column("place").to_numpy()] = last.column("score").to_numpy()
        return best(df.mapInArrow(_lists(slices, least, depth, more), rows))

    first = listed(own, cosines, _SmallestIds(depth))
    small = is_(first, lambda x: x < 0).column("chunk_id").combine_chunks()
    sent = spark.sparkContext.broadcast(small.to_pylist())
    second = listed(held, bm25, _NotZero(sent, queries))
    positive, other = is_(second, lambda x: x >= 0), is_(second, lambda x: x < 0)
    some = np.bincount(positive.column("place").to_numpy(), minlength=queries)
    known = np.where(some < depth, some + len(small) - np.bincount(other.column("place").to_numpy() + queries + 1, minlength=queries), depth)
    pairs = [is_(first, lambda x: x >= 0), positive]
    if len(few := np.flatnonzero(some < depth)):  # their lists go on with chunks that score 0, by id
        ids = pa.concat_arrays([small] * len(few))
        pairs.append(pa.table({"place": np.repeat(few, len(small)).astype(np.int32), "chunk_id": ids, "score": np.zeros(len(ids))}))
    pairs = pa.concat_tables(pairs, promote_options="permissive").group_by(["place", "chunk_id"]).aggregate([])

    wanted = spark.sparkContext.broadcast((pairs.column("place").to_numpy(), pairs.column("chunk_id").to_pylist()))
    for name, df, slices in (("cosine", own, cosines), ("bm25", held, bm25)):
        seen = df.mapInArrow(_picked(slices, wanted), rows).toArrow().rename_columns(["place", "chunk_id", name])
        pairs = pairs.join(seen, ["place", "chunk_id"], join_type="left outer").combine_chunks()
    place, ids = pairs.column("place").to_numpy(), pairs.column("chunk_id")
    cosine, score = pairs.column("cosine").fill_null(_NONE).to_numpy(), pairs.column("bm25").fill_null(0.0).to_numpy()
    named = ids.to_numpy()
    alone, own_id = np.unique(named, return_inverse=True)
    sent = spark.sparkContext.broadcast((place, named, alone, [(x, np.lexsort((own_id, x, place))) for x in (cosine, score)]))
    kind = "kind int, at int, n long"
    counted = own.mapInArrow(_counts(cosines, queries, sent, 0, 0), kind).unionByName(held.mapInArrow(_counts(bm25, queries, sent, 1, 3), kind))
    counted = counted.groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    held.unpersist()
    of = lambda k: np.bincount(*(counted.filter(pc.equal(counted.column("kind"), k)).column(c).to_numpy() for c in ("at", "n")), len(place)).astype(np.int64)
    plain = np.where(score < 0, n - of(5)[:1].sum(), np.where(score == 0, (of(1) - of(4))[own_id], 0))  # chunks without an asked term that stand above
    value = 1.0 / (RRF_K + 1 + of(0)) + 1.0 / (RRF_K + 1 + of(3) + plain)
    bound = 1.0 / (RRF_K + 1 + depth) + 1.0 / (RRF_K + 1 + known[place])
    return pa.table({"place": place, "chunk_id": ids, "score": value, "bound": bound})


def hybrid_search(chunks: DataFrame, index: Bm25, queries: DataFrame, k: int = 6, per_path: int = PER_PATH, first: int | None = None) -> DataFrame:
    """query_id, chunk_id, path, score, rank: fused ranking, ``per_path`` chunks of a path, k per query.

    Equal to ``diverse_top`` of the fused ranks of all chunks. ``index`` and ``chunks`` should be stored tables, as each round reads them several times.
    """
    spark = chunks.sparkSession
    asked = written(queries.select("query_id", "text", "vec"), "asked-queries")
    n, avgdl = index.totals.select("n", "avgdl").first()
    depth, parts, room = first or FIRST + PER_HIT * k, [], None
    named = StructType([StructField("place", IntegerType()), asked.schema["query_id"]])
    left = asked.count()
    while left and n:
        size = max(1, MOST_CELLS // min(depth, n))
        blocks, undecided = -(-left // size), []
        for b in range(blocks):
            block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            few = block.collect()
            if not few:
                continue
            ids = spark.createDataFrame([(at, r["query_id"]) for at, r in enumerate(few)], named)
            texts = spark.createDataFrame([(at, r["text"]) for at, r in enumerate(few)], "query_id int, text string")
            found = _scored(chunks, index, asked_terms(index, texts), [r["vec"] for r in few], min(depth, n), n, avgdl)
            scored = spark.createDataFrame(found, StructType([named[0], chunks.schema["chunk_id"], StructField("score", DoubleType()), StructField("bound", DoubleType())]))
            scored = chunks.select("chunk_id", "path").join(F.broadcast(scored), "chunk_id")
            hits = diverse_top(scored, "place", k, per_path=per_path)
            hits = written(hits.join(F.broadcast(ids), "place"), "hits")
            if depth < n:
                last = hits.groupBy("query_id").agg(F.count("*").alias("rows"), F.min(F.round("score", 9)).alias("low"), F.max(F.round("bound", 9)).alias("high"))
                state = last.collect()
                if room is None and any(r["rows"] < k for r in state):  # no query can have more hits than this
                    room = chunks.groupBy("path").agg(F.least(F.count("*"), F.lit(per_path)).alias("n")).agg(F.sum("n")).first()[0]
                most = k if room is None else min(k, room)
                open_ = [r["query_id"] for r in state if r["rows"] < most or r["low"] <= r["high"]]
                undecided += open_
                if open_:
                    hits = hits.join(F.broadcast(spark.createDataFrame([(x,) for x in open_], StructType([named[1]]))), "query_id", "left_anti")
            parts.append(hits.select("query_id", "chunk_id", "path", "score", "rank"))
        if undecided:
            asked = asked.join(spark.createDataFrame([(x,) for x in undecided], StructType([named[1]])), "query_id", "left_semi")
        left, depth = len(undecided), depth * GROWTH
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    if out is None:
        kinds = StructType([named[1], *(chunks.schema[c] for c in ("chunk_id", "path")), StructField("score", DoubleType()), StructField("rank", LongType())])
        return spark.createDataFrame([], kinds)
    return out
