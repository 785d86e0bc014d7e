"""A quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Features are word 1- and 2-grams and 1- and 2-grams of word shapes (case, symbols, length,
whether a word repeats the one before), hashed into one space. Counts of a family are
scaled to unit length, so texts of any length compare. Training takes at most
``MAX_LABELLED`` labelled rows: each of ``PARTS`` partitions (whose states of fixed size
go to the driver) runs FTRL over its rows, and the
states are averaged after every round. A score is a sparse dot product.

Defined results: a null or empty text has only a bias and a length feature and gets the score
of those; rows with null or repeated ids are scored like any other; extra columns are ignored;
with no labelled row every score is 0.5; an empty table gives an empty result.
Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined_bytes, labelled_sample, list_array, mix, slices, span_hashes, word_spans, written

BITS = 18
#: Labelled rows that are learned from, at most about so many.
MAX_LABELLED = 20_000
PARTS, ROUNDS = 4, 4
_SPACE = 1 << BITS


def _class_table() -> np.ndarray:
    """1 lower-case ASCII letter, 2 upper-case, 3 symbol, 4 digit, 0 other bytes."""
    out = np.zeros(256, np.uint8)
    out[97:123], out[65:91], out[48:58] = 1, 2, 4
    for lo, hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
        out[lo:hi] = 3
    return out


_CLASS = _class_table()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and values of each text's features end to end, and how many each has."""
    data, offsets = joined_bytes(texts)
    starts, ends, bounds = word_spans(data, offsets)
    n_docs = len(offsets) - 1
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(n_docs), counts)
    words = span_hashes(data.lower(), starts, ends)
    kinds = _CLASS[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)

    def within(kind: int) -> np.ndarray:
        sums = np.zeros(len(kinds) + 1, np.int32)
        np.cumsum(kinds == kind, out=sums[1:])
        return sums[ends] - sums[starts]

    lower, upper, symbol, digit = (within(k) for k in (1, 2, 3, 4))
    next_to = np.zeros(len(words), bool)  # the word before is of the same text
    next_to[1:] = owner[1:] == owner[:-1]
    same = next_to.copy()
    same[1:] &= words[1:] == words[:-1]
    case = np.where(lower > 0, np.where(upper > 0, 1, 0), np.where(upper > 1, 2, 3))
    shape = (case + 4 * np.minimum(symbol, 4) + 32 * np.minimum((ends - starts) // 4, 5) + 256 * same + 512 * (digit > 0)).astype(np.uint64)
    pairs = np.flatnonzero(next_to)
    length = np.floor(np.log2(1 + counts)).astype(np.uint64)
    families = [
        (owner, mix(words + np.uint64(1))),
        (owner[pairs], mix(mix(words[pairs - 1]) + words[pairs] + np.uint64(2))),
        (owner, mix(shape + np.uint64(3 << 32))),
        (owner[pairs], mix(mix(shape[pairs - 1] + np.uint64(4 << 32)) + shape[pairs])),
        (np.arange(n_docs), mix(length + np.uint64(5 << 32))),
        (np.arange(n_docs), np.full(n_docs, mix(np.array([6], np.uint64))[0])),
    ]
    keys, values = [], []
    for who, h in families:
        key = np.sort(who * _SPACE + (h >> np.uint64(64 - BITS)).astype(np.int64))
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(key))).astype(np.float64)
        key = key[head]
        value = np.sqrt(times)
        norm = np.sqrt(np.bincount(key // _SPACE, times, n_docs))
        keys.append(key)
        values.append(value / norm[key // _SPACE])
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    return (key % _SPACE).astype(np.int32), value.astype(np.float32), np.bincount(key // _SPACE, minlength=n_docs).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal state for logistic loss."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.002

    @classmethod
    def empty(cls) -> Ftrl:
        return cls(np.zeros(_SPACE), np.zeros(_SPACE))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        active = np.abs(z) > self.l1
        return np.where(active, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, index: np.ndarray, value: np.ndarray, y: int) -> None:
        """One example. Families that hash to one place add up to one feature there."""
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
        g = (p - y) * value
        n = self.n[index]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        np.add.at(self.z, index, g - sigma * w)
        np.add.at(self.n, index, g * g)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> np.ndarray:
    """Weights learned from labelled rows for which ``usable`` (over ``labels``) is true; None without any."""
    spark = docs.sparkSession
    picked = labelled_sample(labels, label, usable, max_labelled, doc_id)  # bounded, so it may be broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            index, value, counts = features(part.column(text))
            yield pa.RecordBatch.from_arrays(
                [part.column("__id"), part.column("__y"), list_array(index, counts, pa.int32()), list_array(value, counts, pa.float32())], ["id", "y", "index", "value"])

    rows = docs.select(F.col(doc_id).alias("__id"), text).join(F.broadcast(picked), "__id")
    id_type = rows.schema["__id"].dataType.simpleString()
    rows = rows.mapInArrow(extract, f"id {id_type}, y int, index array<int>, value array<float>")
    rows = written(rows, "quality-rows")
    state = Ftrl.empty()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((state.z, state.n))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Ftrl(sent.value[0].copy(), sent.value[1].copy())
            seen = 0
            for batch in batches:
                for y, index, value in zip(*(batch.column(c) for c in ("y", "index", "value")), strict=True):
                    own.learn(index.values.to_numpy(), value.values.to_numpy().astype(np.float64), y.as_py())
                    seen += 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([own.z.tobytes()], pa.binary()), pa.array([own.n.tobytes()], pa.binary())], ["seen", "z", "n"])

        found = rows.coalesce(PARTS).sortWithinPartitions(F.xxhash64("id"), "index").mapInArrow(learn, "seen long, z binary, n binary").collect()
        sent.unpersist()
        if not found:
            return None
        total = sum(r["seen"] for r in found)
        mean = lambda c: sum(np.frombuffer(r[c]) * (r["seen"] / total) for r in found)  # noqa: E731,B023
        state = Ftrl(mean("z"), mean("n"))
    return state.weights()


def score(docs: DataFrame, weights: np.ndarray | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` (0 to 1). One scan without a shuffle; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in kept]
    sent = docs.sparkSession.sparkContext.broadcast(np.zeros(_SPACE, np.float32) if weights is None else weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for part in slices(batches, text):
            index, value, counts = features(part.column(text))
            margin = np.add.reduceat(w[index] * value, np.cumsum(counts) - counts).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], [*names, name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))
