r"""Collocations: phrases whose words stand together more often than their parts would.

Two passes over the texts. The first builds a count-min sketch of all n-grams up to ``MOST_WORDS`` words in each task; cells
stop at the threshold, so one takes a byte, and merged sketches stop there, too. A cell that reaches the threshold is one bit of a
table of at most ``ROWS`` times ``2**MOST_BITS`` bits, which is broadcast. A sketch never counts too little, so the second pass exactly counts only n-grams whose cells and whose
shorter parts all pass, and nothing frequent is lost. Where a corpus fills the largest sketch more n-grams pass: the exact counts grow, the result stays. Every part of a frequent
phrase is frequent itself, so scores need only joins among the frequent ones.

Scores of the lowest cut and the shares of longer phrases are integers of up to 38 digits.

Defined results: a null text is empty, a null language ``und``; rows with null or repeated ids are documents like others; phrases don't cross the marks
``.,;:!?`` nor line ends; ties go by a, then by the phrase's bytes; without a frequent phrase, or for an empty table, the result is empty; other columns aren't read. Texts are never cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_bytes, lean, mix, sized, slices, span_hashes, span_texts, word_spans, written

MOST_WORDS, MIN_COUNT, COVERED, BEST = 5, 100, 100, 2000
#: Rows of a sketch, and the least and most bits of a cell's number; the number of cells follows the size of the texts between them.
ROWS, LEAST_BITS, MOST_BITS = 2, 20, 26
#: Bytes of text to a cell of a row, and least bytes of text to a byte of a task's sketch (where there are more tasks than twice the cores).
CELL_BYTES, SKETCH_SHARE = 64, 8
#: Cells that travel in one row.
CHUNK = 1 << 18
#: Bytes of text that are counted at once.
SLICE = 2 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OF_WORD = ~_BREAK
_OF_WORD[[0x20, 0x09]] = False


class _Words:
    """The words of a slice (text, lang) with hashes, and of every length the places where an n-gram begins."""

    def __init__(self, part: pa.RecordBatch, most: int):
        data, offsets = joined_bytes(part.column(0))
        data = data.lower()
        starts, ends, bounds = word_spans(data, offsets, _OF_WORD)
        self.data, self.starts, self.ends = data, starts, ends
        self.lang = part.column(1).dictionary_encode()
        self.owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
        breaks = np.zeros(len(data) + 1, np.int32)
        if data:
            np.cumsum(_BREAK[np.frombuffer(data, np.uint8)], out=breaks[1:])
        piece = breaks[starts] + self.owner  # grows with every mark and every text
        names, cuts = joined_bytes(self.lang.dictionary)
        own = span_hashes(names, cuts[:-1], cuts[1:])[self.lang.indices.to_numpy()][self.owner] if len(starts) else np.zeros(0, np.uint64)
        words = span_hashes(data, starts, ends)
        self.begin, self.hash, h = [np.arange(len(starts))], [], mix(words ^ own)
        self.hash.append(h)
        for n in range(2, most + 1):
            at = np.flatnonzero(piece[n - 1 :] == piece[: len(piece) - n + 1]) if len(piece) >= n else np.zeros(0, np.int64)
            whole = mix(self.hash[-1][: max(len(piece) - n + 1, 0)] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :])
            self.begin.append(at)
            self.hash.append(whole)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _sketching(bits: int, most: int, enough: int):
    kind = np.min_scalar_type(enough)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in slices(batches, 0, SLICE):
            words = _Words(part, most)
            held = np.zeros((ROWS, 1 << bits), kind) if held is None else held
            every = np.concatenate([h[at] for at, h in zip(words.begin, words.hash, strict=True)])
            for row in range(ROWS):
                cell = np.sort(_cells(every, row, bits))
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(cell)))
                cell = cell[first]
                held[row, cell] = np.minimum(held[row, cell] + times, enough)
        for row in range(ROWS if held is not None else 0):
            for k in range(0, 1 << bits, CHUNK):
                if (some := held[row, k : k + CHUNK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([(row << bits) + k]), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], ["at", "cells"])

    return run


def _merging(enough: int):
    """Sorted rows (at, cells) to (at, bits): sums that stop at ``enough``, then a bit for each cell that got there."""
    kind = np.min_scalar_type(enough)

    def row(at: int, cells: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.packbits(cells >= enough, bitorder="little").tobytes()], pa.binary())], ["at", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for at, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some = np.frombuffer(zlib.decompress(cells.as_py()), kind).astype(np.int64)
                if at == now:
                    held = np.minimum(held + some, enough)
                    continue
                if now is not None:
                    yield row(now, held)
                now, held = at, some
        if now is not None:
            yield row(now, held)

    return run


def sketch(read: DataFrame, most: int, enough: int) -> np.ndarray:
    """ROWS of packed bits: whether a cell of the merged sketch of ``read`` (text, lang) holds ``enough``."""
    spark = read.sparkSession
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size // CELL_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(size // (SKETCH_SHARE * ROWS << bits)))
    made = read.coalesce(tasks).mapInArrow(lean(_sketching(bits, most, enough)), "at long, cells binary")
    merged = made.repartition("at").sortWithinPartitions("at").mapInArrow(_merging(enough), "at long, bits binary")
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for found in merged.toLocalIterator():  # at most ROWS * 2 ** MOST_BITS / 8 bytes in all
        row, k = divmod(found["at"], 1 << bits)
        own = np.frombuffer(found["bits"], np.uint8)
        out[row, k // 8 : k // 8 + len(own)] = own
    return out


# ---------------------------------------------------------------- exact counts
def _surviving(sent, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        cells = bits.shape[1].bit_length() + 2  # of 2 ** cells cells, eight to a byte
        for part in slices(batches, 0, SLICE):
            words = _Words(part, most)
            texts = span_texts(words.data, words.starts, words.ends).dictionary_encode()
            code, names = texts.indices.to_numpy().astype(np.int64), texts.dictionary
            lang = words.lang.indices.to_numpy()[words.owner].astype(np.int64)
            total = np.bincount(lang, minlength=len(words.lang.dictionary))
            langs, sizes, phrases, counts = [pa.array(np.arange(len(total)))], [np.zeros(len(total), np.int32)], [pa.array([""] * len(total), pa.large_string())], [total]
            passed = np.ones(len(code) + 1, bool)
            number = lang  # of the n-gram that begins at a place, exact within the slice
            for n, (at, h) in enumerate(zip(words.begin, words.hash, strict=True), 1):
                at = at[passed[at] & passed[at + (1 if n > 1 else 0)]]
                for row in range(ROWS):
                    cell = _cells(h[at], row, cells)
                    at = at[(bits[row, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1]
                if not len(at):
                    break
                _, first, own, times = np.unique(number[at] * len(names) + code[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                number = np.zeros(len(code), np.int64)
                number[at] = own
                passed = np.zeros(len(code) + 1, bool)
                passed[at] = True
                first = at[first]
                langs.append(pa.array(lang[first]))
                sizes.append(np.full(len(first), n, np.int32))
                phrases.append(pc.binary_join_element_wise(*(names.take(pa.array(code[first + k])) for k in range(n)), pa.scalar(" ", pa.large_string())))
                counts.append(times)
            yield pa.RecordBatch.from_arrays([
                words.lang.dictionary.take(pa.concat_arrays(langs)), pa.array(np.concatenate(sizes)), pa.concat_arrays(phrases).cast(pa.string()),
                pa.array(np.concatenate(counts).astype(np.int64))], ["lang", "size", "phrase", "n"])

    return run


def frequent(docs: DataFrame, most: int = MOST_WORDS, enough: int = MIN_COUNT, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, size, phrase and n of all n-grams with n of at least ``enough``; size 0 has a language's number of words. Written."""
    read = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(sketch(read, most, enough))
    found = read.mapInArrow(lean(_surviving(sent, most)), "lang string, size int, phrase string, n long")
    return written(found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= enough) | (F.col("size") == 0)), "frequent")


# ---------------------------------------------------------------- scores
def _between(phrase, begin, size):
    return F.array_join(F.slice(F.split(phrase, " "), begin, size), " ")


def collocations(docs: DataFrame, most: int = MOST_WORDS, enough: int = MIN_COUNT, covered: int = COVERED, best: int = BEST, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases that no longer phrase covers to ``covered`` percent."""
    known = frequent(docs, most, enough, lang, text)
    totals = sized(known.filter("size = 0").select("lang", F.col("n").alias("total")), "totals")
    part = lambda name, count: known.filter("size > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    own = known.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))

    inner = own.filter("size > 2").withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    longer = inner.groupBy("lang", _between("phrase", F.col("begin"), F.col("length")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = own.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))

    cut = kept.select("lang", "size", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"first": _between("phrase", F.lit(1), F.col("k")), "rest": _between("phrase", F.col("k") + 1, F.col("size") - F.col("k"))})
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    cut = cut.withColumn("above", (wide("a") * wide("total")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", wide("l") * wide("r"))
    lowest = cut.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut"))
    shown = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = shown.withColumn("rank", place).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
