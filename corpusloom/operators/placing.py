"""Ranks of all rows in many lists at once, without a table that has a row for each row and list before the result.

Rows lie in blocks, by ranges of their id. A block's scores are computed where they are needed and sorted there; only the differences of neighbours in
a list's order travel, a byte or three each, to a task for each list and range of scores. It counts what stands above each score anywhere and the equal scores of
blocks before, and sends those counts back to the blocks in the same way. No id travels: equal scores of a block are one entry, and its
rows follow each other by id. Scores are computed twice, so they must be the same bits each time on every machine; a count of entries that doesn't fit is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Entries of a range of scores, about, and the rows that are sampled for each to find where ranges end.
RANGE, SAMPLED = 500_000, 100
#: Scores that a task computes at once where it isn't given whole blocks.
CELLS = 1_600_000
#: The order of a row that has no score.
LAST = 1 << 62
#: Rows of an Arrow batch of the result.
BATCH = 32_768

#: Of a table of rows: their order in each list (lists x rows; the least first), and what the result needs beside it.
Scores = Callable[[pa.Table], tuple[np.ndarray, object]]


def descending(score: np.ndarray, unknown: np.ndarray | bool = False) -> np.ndarray:
    """Integers that ascend as scores, rounded to nine places and halves away from zero, fall; unknown ones are last and what is no number is first, as an ORDER BY has them."""
    scaled = score * 1e9
    with np.errstate(invalid="ignore"):
        whole = np.trunc(scaled)
        whole += np.where(np.abs(scaled - whole) >= 0.5, np.copysign(1.0, scaled), 0.0)
        return np.where(unknown, LAST, np.where(np.isnan(whole), -(LAST >> 1), -np.clip(whole, -9e18 / 4, 9e18 / 4).astype(np.int64)))


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 as planes of bytes, no more of them than the largest needs, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[1:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def _rising(first: int, steps: bytes, n: int) -> np.ndarray:
    return first + unpacked(steps, n).cumsum()


def _steps(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=values[:1]))


# ---------------------------------------------------------------- what a task does
def _sent(scores: Scores, ends: list[np.ndarray]):
    """A block's rows to its entries: list, range, block, n, first, steps and times (rows of each entry beyond the first)."""

    def run(block: pa.Table) -> pa.Table:
        order, _ = scores(block)
        own, rows = block.column("block")[0].as_py(), []
        for k, keys in enumerate(order):
            values, times = np.unique(keys, return_counts=True)
            cuts = [0, *np.searchsorted(values, ends[k], "right"), len(values)]
            rows += [(k, r, own, hi - lo, values[lo], _steps(values[lo:hi]), packed(times[lo:hi] - 1)) for r, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SENT.types, strict=True)], schema=_SENT) if rows else _SENT.empty_table()

    return run


def _counted(above: np.ndarray):
    """Entries of a list's range from all blocks to the rows that stand above each; ``above`` (lists x ranges) are the rows of the ranges before."""

    def run(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("block")
        n, first, steps, times = (pieces.column(c).to_pylist() for c in ("n", "first", "steps", "times"))
        values = np.concatenate([_rising(*x) for x in zip(first, steps, n, strict=True)])
        order = np.argsort(values, kind="stable")  # equal values stay in the order of their blocks
        rows = np.concatenate([unpacked(*x) for x in zip(times, n, strict=True)])[order] + 1
        start = np.empty(len(values), np.int64)
        start[order] = rows.cumsum() - rows + above[pieces.column("list")[0].as_py(), pieces.column("range")[0].as_py()]
        own = np.split(start, np.cumsum(n)[:-1])
        return pa.table([pieces.column("list"), pieces.column("range"), pieces.column("block"), pieces.column("n"), pa.array([x[0] for x in own]), pa.array([_steps(x) for x in own], pa.binary())], schema=_BACK)

    return run


def _placed(scores: Scores, id_: str, out: Callable[[pa.Table, object, np.ndarray], pa.Table]):
    """A block's rows and their entries' counts to the result."""

    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        block, back = block.sort_by(id_), back.sort_by([("list", "ascending"), ("range", "ascending")])
        order, more = scores(block)
        of, n, first, steps = (back.column(c).to_pylist() for c in ("list", "n", "first", "steps"))
        bounds, ranks = np.searchsorted(of, np.arange(len(order) + 1)), np.empty(order.shape, np.int64)
        for k, keys in enumerate(order):
            start = np.concatenate([_rising(first[x], steps[x], n[x]) for x in range(bounds[k], bounds[k + 1])])
            at = np.argsort(keys, kind="stable")
            heads = np.flatnonzero(np.diff(keys[at], prepend=keys[at[:1]] - 1))
            if len(heads) != len(start):
                raise ValueError(f"{len(heads)} scores of a block, counts of {len(start)}")
            ranks[k, at] = np.repeat(start - heads, np.diff(heads, append=len(keys))) + np.arange(1, len(keys) + 1)
        return pa.Table.from_batches(out(block, more, ranks).to_batches(BATCH))

    return run


_SENT = pa.schema([("list", pa.int32()), ("range", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("first", pa.int64()), ("steps", pa.binary()), ("times", pa.binary())])
_BACK = pa.schema(list(_SENT)[:-1])
_KINDS = "list int, range int, block long, n int, first long, steps binary"


# ---------------------------------------------------------------- ranges of scores
def _orders(scores: Scores, lists: int):
    """Batches of rows to slices of their orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        step = max(1, CELLS // lists)
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                yield scores(pa.Table.from_batches([batch.slice(k, step)]))[0]

    return run


def _ends(rows: DataFrame, scores: Scores, lists: int, ranges: int, n: int) -> list[np.ndarray]:
    """Where ranges of each list end, by a sample; what they hold is counted afterwards."""
    if ranges == 1:
        return [np.empty(0, np.int64)] * lists

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for order in _orders(scores, lists)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(lists, dtype=np.int32), order.shape[1])), pa.array(order.ravel())], ["list", "value"])

    some = rows.sample(min(1.0, SAMPLED * ranges / n), 1).mapInArrow(sampled, "list int, value long")
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    found = {r["list"]: r["ends"] for r in some.groupBy("list").agg(F.percentile_approx("value", shares).alias("ends")).collect()}
    return [np.unique(np.array(found.get(k, []), np.int64)) for k in range(lists)]


def _above(rows: DataFrame, scores: Scores, ends: list[np.ndarray]) -> np.ndarray:
    """How many rows each list has in the ranges before each."""
    width = max(map(len, ends), default=0) + 1
    if width == 1:
        return np.zeros((len(ends), 1), np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ends), width), np.int64)
        for order in _orders(scores, len(ends))(batches):
            for k, keys in enumerate(order):
                total[k] += np.bincount(np.searchsorted(ends[k], keys, "left"), minlength=width)
        k, r = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(total[k, r])], ["list", "range", "n"])

    out = np.zeros((len(ends), width), np.int64)
    for r in rows.mapInArrow(counted, "list int, range int, n long").groupBy("list", "range").agg(F.sum("n").alias("n")).collect():
        out[r["list"], r["range"]] = r["n"]
    return out.cumsum(axis=1) - out


def placed(rows: DataFrame, scores: Scores, lists: int, out: Callable[[pa.Table, object, np.ndarray], pa.Table], kind: StructType, id_: str = "chunk_id", most: int | None = None) -> DataFrame:
    """``out`` of each block of ``rows`` (a stored table whose column ``block`` rises with ``id_``), what ``scores`` gives beside, and the ranks (lists x rows, from 1)."""
    n = rows.count()
    ends = _ends(rows, scores, lists, -(-n // (most or RANGE)) or 1, n)
    above = _above(rows, scores, ends)
    sent = rows.groupBy("block").applyInArrow(_sent(scores, ends), f"{_KINDS}, times binary")
    back = sent.groupBy("list", "range").applyInArrow(_counted(above), _KINDS)
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_placed(scores, id_, out), kind)
