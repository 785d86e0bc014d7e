r"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features of a text are the 1- to ``ORDER``-grams of its lower-cased letters, with one space for each run of other characters,
hashed into ``2**BITS`` buckets. Counts by language come from at most about ``MAX_LABELLED`` labelled rows of each language, picked by a
hash of their id; the prior counts all labelled rows. The matrix of log-probabilities is broadcast in blocks of ``BLOCK`` languages (16 MB each);
more languages take more blocks, one after the other. A batch of texts is scored as a product of its sparse counts and the matrix. The score is
the posterior of the language that was picked, with a text's evidence scaled to that of ``EVIDENCE`` features, as n-grams of a long text aren't independent.

Defined results: a text that is null or has no letter (``\p{L}``) is ``und`` with score 0, and so is every text where nothing was learned; ties go to the
smallest language; rows with null ids aren't learned from but are scored; repeated rows count as often as they occur; an empty table gives an empty result; clashing extra
columns are kept unless they bear the results' names. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mix, sized, slices, unused, written

BITS, ORDER = 16, 3
#: Rows of a language that are learned from, about.
MAX_LABELLED = 20_000
SMOOTH, EVIDENCE = 0.5, 100
BLOCK = 64
UNKNOWN = "und"
#: Products that are held at once while a batch is scored.
_CELLS = 1 << 22


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the n-grams of each text, sorted by text and bucket."""
    each = [(t or "").lower() for t in texts.to_pylist()]
    points = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(each)), [len(t) for t in each])
    kinds, at = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[at]
    starts = np.ones(len(points), bool)
    starts[1:] = owner[1:] != owner[:-1]
    kept = letter.copy()
    kept[1:] |= letter[:-1] & ~starts[1:]  # the first other character after a letter stands for its run
    points, owner = np.where(letter, points, 0x20)[kept].astype(np.uint64), owner[kept]
    keys, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, ORDER + 1):
        size = max(len(points) - n + 1, 0)
        h = mix(h[:size] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n))
        whole = owner[n - 1 :] == owner[:size]
        keys.append((owner[:size][whole].astype(np.uint64) << np.uint64(BITS)) | (h[whole] >> np.uint64(64 - BITS)))
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), times


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n of each slice of (text, lang)."""
    for part in slices(batches, 0):
        lang = part.column(1).dictionary_encode()
        text, bucket, times = features(part.column(0))
        key, own = np.unique((lang.indices.to_numpy().astype(np.int64)[text] << BITS) | bucket, return_inverse=True)
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key >> BITS)), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)), pa.array(np.bincount(own, times, len(key)).astype(np.int64))], ["lang", "bucket", "n"])


@dataclass
class LanguageModel:
    """Blocks of (languages, log-probabilities with a row per bucket, log-priors)."""

    blocks: list[tuple[list[str], np.ndarray, np.ndarray]]

    @property
    def languages(self) -> list[str]:
        return [x for names, _, _ in self.blocks for x in names]


def train(docs: DataFrame, usable: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", max_labelled: int = MAX_LABELLED, block: int = BLOCK) -> LanguageModel:
    """A model of the rows for which ``usable`` is true and whose language is known."""
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & usable).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("id"))
    known = sized(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(1 << 30) * (F.lit(max_labelled) / F.col("rows"))
    picked = rows.join(known, "lang").filter(place).select("text", "lang")
    counts = picked.mapInArrow(lean(_counting), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = known.orderBy("lang").toArrow()
    names, seen = table.column("lang").to_pylist(), np.array(table.column("rows").to_pylist(), float)
    counts, blocks = written(counts, "language-counts"), []
    for begin in range(0, len(names), block):
        own = names[begin : begin + block]
        found = counts.filter(F.col("lang").isin(own)).toArrow()
        n = np.zeros((1 << BITS, len(own)))
        at = {x: k for k, x in enumerate(own)}
        code = found.column("lang").combine_chunks().dictionary_encode()
        n[found.column("bucket").to_numpy(), np.array([at[x] for x in code.dictionary.to_pylist()], np.int64)[code.indices.to_numpy()]] = found.column("n").to_numpy()
        blocks.append((own, np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * (1 << BITS))).astype(np.float32), np.log(seen[begin : begin + block] / seen.sum())))
    return LanguageModel(blocks)


def _scoring(sent, column: int, names: list[str], made: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logs, prior = sent.value
        for part in slices(batches, column):
            text, bucket, times = features(part.column(column))
            sums = np.zeros((part.num_rows, len(languages)))
            step = max(1, _CELLS // len(languages))
            for k in range(0, len(text), step):
                own = text[k : k + step]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                sums[own[first]] += np.add.reduceat(logs[bucket[k : k + step]] * times[k : k + step, None], first, axis=0, dtype=np.float64)
            total = np.bincount(text, times, part.num_rows)
            sums = prior + sums * np.minimum(1.0, EVIDENCE / np.maximum(total, 1))[:, None]
            best = sums.argmax(axis=1)
            top = sums[np.arange(len(best)), best]
            rest = np.exp(sums - top[:, None]).sum(axis=1)
            found = pa.StructArray.from_arrays([pa.array(top), pa.array(languages).take(pa.array(best)), pa.array(rest)], ["top", "lang", "rest"])
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), found], [*names, made])

    return run


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with a string ``name`` and a double ``score`` (0 to 1). One scan without a shuffle; columns of those names are replaced."""
    docs = docs.drop(name, score)
    rows, made = docs, unused(docs.columns, *(f"__found{k}" for k in range(len(model.blocks))))
    for block, column in zip(model.blocks, made, strict=True):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        kind = T.StructType([*rows.schema.fields, T.StructField(column, T.StructType([T.StructField("top", T.DoubleType()), T.StructField("lang", T.StringType()), T.StructField("rest", T.DoubleType())]))])
        rows = rows.mapInArrow(lean(_scoring(sent, rows.columns.index(text), rows.columns, column)), kind)
    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if made else F.lit(False)
    tops = [F.col(c)["top"] for c in made]
    high = F.greatest(*tops) if len(tops) > 1 else tops[0] if tops else F.lit(0.0)
    picked = F.coalesce(*(F.when(F.col(c)["top"] == high, F.col(c)["lang"]) for c in made)) if made else F.lit(None)
    sure = sum((F.col(c)["rest"] * F.exp(F.col(c)["top"] - high) for c in made), F.lit(0.0))
    return rows.select(*docs.columns, F.when(spoken, picked).otherwise(F.lit(UNKNOWN)).alias(name), F.when(spoken, 1.0 / sure).otherwise(F.lit(0.0)).alias(score))
