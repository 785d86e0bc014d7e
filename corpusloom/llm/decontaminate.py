"""Benchmark decontamination by latent semantic retrieval with exact confirmation.

1. The words of the benchmark items are the vocabulary. One scan of the documents keeps, for each,
   the known words and their places; all later steps read this table only.
2. Passages of ``PASSAGE`` words give TF-IDF rows. A randomised SVD finds their main directions:
   each task multiplies its rows with a common random matrix and back, sums go
   through a shuffle per word, and only matrices of vocabulary size reach the driver.
3. Every window of a document, as long as an item and aligned to ``STEP`` words, is projected; items whose
   cosine reaches ``COSINE`` of what a window with the whole item has on average are candidates. No number of candidates is capped.
4. Candidates that share too few words with the item, in whatever order, go: their subsequence can be no longer. The
   others are confirmed by the longest common subsequence of item and window, and by the
   item's answer (its last sentence): near-whole items, or most of one with its answer.

Items are taken in blocks of ``ITEM_BLOCK``, which bounds what is broadcast.

Defined results: words are compared without symbols and case; items of fewer than ``LEAST_WORDS``
words, or without id or text, are not searched (so few words occur in clean texts by chance); null and empty texts and those without a known
word match nothing; rows without an id are never reported; rows that share an id report once per item;
extra columns don't matter; empty tables give an empty result. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, joined_bytes, lean, list_array, sized, slices, span_hashes, unused, word_spans, written

STEP, PASSAGE = 8, 32
RANK, OVERSAMPLE = 56, 8
COSINE = 0.62
#: A word of every passage still weighs this much: else passages that are all alike would have no vector.
LEAST_IDF = 0.05
#: Cosines of items and windows that a task holds at once.
COSINES = 1 << 21
#: Runs of known words that are added up together, so that their sums stay in a core's cache.
RUNS = 1 << 12
ITEM_BLOCK = 2_000
LEAST_WORDS = 6
#: A candidate is a leak at this share of the item in order, or at the lower one with this share of its answer.
WHOLE, PART, ANSWER = 0.8, 0.6, 0.75


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes without symbols and case, and each text's bounds."""
    data, offsets = joined_bytes(pc.utf8_lower(texts.fill_null("")))
    data = data.translate(PLAIN)
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends), bounds


def answer_words(text: str, total: int) -> int:
    """How many words at an item's end are its answer: its last sentence, at least a quarter and at most half of it."""
    last = re.split(r"[.!?]\s+", text.strip().rstrip(".!?"))[-1]
    n = len(re.findall(r"[^\s!-/:-@\[-`{-~]+", last))
    return max(min(n, total // 2), -(-total // 4))


@dataclass
class Items:
    """A block of benchmark items over its own vocabulary."""

    ids: list[int]
    words: list[np.ndarray]  # vocabulary numbers
    answers: list[int]
    vocabulary: np.ndarray  # sorted hashes

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> Items:
        hashes, bounds = _words(pa.array([t for _, t in rows], pa.string()))
        kept = [k for k in range(len(rows)) if bounds[k + 1] - bounds[k] >= LEAST_WORDS]
        vocabulary = np.unique(np.concatenate([hashes[bounds[k] : bounds[k + 1]] for k in kept])) if kept else np.zeros(0, np.uint64)
        words = [np.searchsorted(vocabulary, hashes[bounds[k] : bounds[k + 1]]) for k in kept]
        return cls([rows[k][0] for k in kept], words, [answer_words(rows[k][1], len(w)) for k, w in zip(kept, words, strict=True)], vocabulary)

    def blocks(self) -> np.ndarray:
        """How many steps of words cover each item wherever it begins."""
        return np.array([-(-(len(w) + STEP - 1) // STEP) for w in self.words])


def common_subsequence(item: list[int], window: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in window:
        if m := masks.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


# ---------------------------------------------------------------- known words of documents
def known_words(docs: DataFrame, items: Items, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (words), places and terms (arrays) of every document with a word of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    bits = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        slot = (vocabulary & np.uint64(bits - 1)).astype(np.int64)
        seen, number = np.zeros(bits, bool), np.zeros(bits, np.int32)
        seen[slot], number[slot] = True, np.arange(len(vocabulary))
        for part in slices(batches, text):
            words, bounds = _words(part.column(text))
            slot = (words & np.uint64(bits - 1)).astype(np.int64)
            maybe = np.flatnonzero(seen[slot])
            at = number[slot[maybe]]
            other = np.flatnonzero(vocabulary[at] != words[maybe])  # unknown, or of a slot that known words share
            at[other] = np.minimum(np.searchsorted(vocabulary, words[maybe[other]]), len(vocabulary) - 1)
            hit = vocabulary[at] == words[maybe]
            place, term = maybe[hit], at[hit]
            sizes = np.diff(np.searchsorted(place, bounds))
            owner = np.repeat(np.arange(part.num_rows), sizes)
            made = [part.column("doc_id"), pa.array(np.diff(bounds)), list_array((place - bounds[owner]), sizes, pa.int32()), list_array(term, sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n", "places", "terms"]).filter(pa.array(sizes > 0))

    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text))
    return rows.mapInArrow(lean(run), "doc_id long, n long, places array<int>, terms array<int>")


def _ragged(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the cell of ``width`` words each lies in (numbered through the batch), each row's first cell, and row bounds."""
    terms = part.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    places = part.column("places").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = part.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    cells = -(-part.column("n").to_numpy() // width)
    first = np.cumsum(cells) - cells
    row = np.repeat(np.arange(part.num_rows), sizes)
    return terms, first[row] + places // width, np.append(first, cells.sum()), np.concatenate([[0], np.cumsum(sizes)])


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about ``most`` known words (one row at least)."""
    for batch in batches:
        sizes = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")), at + 1)
            yield batch.slice(at, end - at)
            at = end


def _sums(rows: DataFrame, run, width: int) -> np.ndarray | None:
    """Sums of the vectors that tasks give per number; tasks pre-sum, the rest is a grouped sum."""
    columns = [f"v{k}" for k in range(width)]
    found = rows.mapInArrow(lean(run), "at int, " + ", ".join(f"{c} double" for c in columns)).groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    return found.column("at").to_numpy(), np.stack([found.column(c).to_numpy() for c in columns], 1) if width else None


def _emit(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total.any(1))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(np.ascontiguousarray(total[at, k])) for k in range(total.shape[1]))], ["at", *(f"v{k}" for k in range(total.shape[1]))])


def _sums_of(lines: np.ndarray, term: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sum of ``lines`` (one per term) over each run of known words: the first words of all runs are added at once, then the second ones of those with two."""
    sizes = np.diff(np.append(heads, len(term)))
    order = np.argsort(-sizes, kind="stable")
    sums = np.empty((len(heads), lines.shape[1]), lines.dtype)
    left = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left").tolist()  # how many runs have more words
    for lo in range(0, len(heads), RUNS):
        first = heads[order[lo : lo + RUNS]]
        own = lines[term[first]]
        for k, n in enumerate(left[1:], 1):
            if n <= lo:
                break
            own[: n - lo] += lines[term[first[: n - lo] + k]]
        sums[order[lo : lo + RUNS]] = own
    return sums


def inverse_frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """idf of the vocabulary over all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms + 1, 1))
        for part in _pieces(batches):
            term, cell, first, _ = _ragged(part, PASSAGE)
            key = cell * terms + term
            key.sort()
            total[:terms, 0] += np.bincount(key[np.diff(key, prepend=-1) > 0] % terms, minlength=terms)
            total[terms, 0] += first[-1]
        yield _emit(total)

    at, found = _sums(rows, run, 1)
    out = np.zeros(terms + 1)
    out[at] = found[:, 0]
    return np.maximum(np.log((1 + out[terms]) / (1 + out[:terms])), LEAST_IDF)


def principal_directions(rows: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """The main right singular directions of the TF-IDF passages, each divided by its singular value.

    A randomised range finder with one power step, then the small eigenproblem.
    """
    terms, spark = len(idf), rows.sparkSession
    width = min(rank + OVERSAMPLE, terms)

    def passages(part: pa.RecordBatch, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unit rows of X times a matrix, the known words' terms, their passages, and the passages' lengths."""
        term, cell, _, _ = _ragged(part, PASSAGE)
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        norm = np.sqrt(np.maximum(np.add.reduceat(idf[term] ** 2, heads), 1e-18))
        return _sums_of(lines, term, heads) / norm[:, None], term, np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(term)))), norm

    def spread(matrix: np.ndarray) -> np.ndarray:
        """X'X times a matrix."""
        sent = spark.sparkContext.broadcast((matrix * idf[:, None]).astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((matrix.shape[1], terms))
            for part in _pieces(batches):
                y, term, at, norm = passages(part, sent.value)
                y = np.ascontiguousarray((y / norm[:, None]).T)
                for k in range(len(y)):
                    total[k] += np.bincount(term, y[k][at], terms)
            yield _emit((total * idf).T)

        at, found = _sums(rows, run, matrix.shape[1])
        out = np.zeros((terms, matrix.shape[1]))
        out[at] = found
        return out

    def inner(matrix: np.ndarray) -> np.ndarray:
        """(X matrix)'(X matrix), a small square."""
        sent = spark.sparkContext.broadcast((matrix * idf[:, None]).astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((matrix.shape[1], matrix.shape[1]))
            for part in _pieces(batches):
                y = passages(part, sent.value)[0].astype(np.float32)
                total += y.T @ y
            yield _emit(total)

        at, found = _sums(rows, run, matrix.shape[1])
        out = np.zeros((matrix.shape[1], matrix.shape[1]))
        out[at] = found
        return out

    basis = np.linalg.qr(spread(np.random.default_rng(seed).standard_normal((terms, width))))[0]
    small = inner(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-9 * max(values.max(), 1e-30)]
    return basis @ vectors[:, best] / np.sqrt(values[best])


# ---------------------------------------------------------------- search
def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, item_share, answer_share, first_word and n_words of every confirmed leak (its best window)."""
    spark = docs.sparkSession
    named = benchmark.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = named.count()
    found = []
    for k in range(max(1, -(-total // ITEM_BLOCK))):
        block = -(-total // ITEM_BLOCK)
        own = named if block <= 1 else named.filter(F.pmod(F.xxhash64("i"), F.lit(block)) == k)
        items = Items.build([(r["i"], r["t"]) for r in own.orderBy("i", "t").collect()])
        if len(items.vocabulary):
            found.append(_search(docs, items, doc_id, text, cosine))
    schema = "doc_id long, item_id long, cosine double, item_share double, answer_share double, first_word long, n_words long"
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max(F.struct("item_share", "answer_share", "cosine", (-F.col("first_word")).alias("at"), "n_words")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "m.cosine", "m.item_share", "m.answer_share", (-F.col("m.at")).alias("first_word"), "m.n_words")


def item_counts(words: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers ``item * vocabulary + word`` of the words of items, and how often the item has each."""
    key = np.concatenate([k * vocabulary + w for k, w in enumerate(words)]) if words else np.zeros(0, np.int64)
    return np.unique(key, return_counts=True)


def _shared(term: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, held_by: tuple[np.ndarray, np.ndarray], vocabulary: int, least: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Which candidates (known words ``begin`` to ``end``, item) share ``least`` words of the item, repeats counted as often as both have them."""
    kept: list[np.ndarray] = []
    sizes = end - begin
    upto = np.cumsum(sizes)
    at = 0
    while at < len(item):
        stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")), at + 1)
        n = sizes[at:stop]
        who = np.repeat(np.arange(at, stop), n)
        words = term[np.repeat(begin[at:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        keys, counts = held_by
        wanted = item[who] * vocabulary + words
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        held = keys[place] == wanted
        rough = np.bincount(who[held] - at, minlength=stop - at) >= least[item[at:stop]]
        held &= rough[who - at]
        pair, first, times = np.unique(who[held] * vocabulary + words[held], return_index=True, return_counts=True)
        shared = np.bincount(pair // vocabulary - at, np.minimum(times, counts[place[held][first]]), stop - at)
        kept.append(at + np.flatnonzero(shared >= least[item[at:stop]]))
        at = stop
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _search(docs: DataFrame, items: Items, doc_id: str, text: str, cosine: float) -> DataFrame:
    rows = written(known_words(docs, items, doc_id, text), "leak-words")
    idf = inverse_frequencies(rows, len(items.vocabulary))
    directions = (principal_directions(rows, idf) * idf[:, None]).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((items, directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, basis = sent.value
        length = own.blocks()
        sizes = np.array([len(w) for w in own.words])
        vectors = np.stack([basis[w].sum(0) for w in own.words])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
        vectors = vectors.astype(np.float32)
        least = (cosine * np.sqrt(sizes / (length * STEP))).astype(np.float32)
        counts = item_counts(own.words, len(own.vocabulary))
        for part in _pieces(batches):
            term, cell, first, _ = _ragged(part, STEP)
            heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            cells = np.zeros((basis.shape[1], int(first[-1]) + 1))
            cells[:, cell[heads] + 1] = _sums_of(basis, term, heads).T
            cells = np.cumsum(cells, axis=1).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=int(first[-1])))])  # each cell's first known word
            row_of = np.repeat(np.arange(part.num_rows), np.diff(first))
            row_end = first[row_of + 1]
            ids = part.column("doc_id").to_numpy()
            out: list[tuple] = []
            total = len(row_of)
            few = np.flatnonzero(np.arange(total) == first[row_of])  # where each document begins
            for n in np.unique(length).tolist():
                # the window of n cells from each cell on; a document of fewer cells is one window
                short = few[few + n > row_end[few]]
                whole = max(total + 1 - n, 0)
                begin = np.concatenate([np.arange(whole), short])
                end = np.minimum(begin + n, row_end[begin])
                window = np.concatenate([cells[:, n:] - cells[:, :whole], cells[:, end[whole:]] - cells[:, short]], axis=1)
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->j", window, window)), 1e-9)
                norm[:whole][begin[:whole] + n > row_end[begin[:whole]]] = np.inf  # reaches into the next document
                these = np.flatnonzero(length == n)
                window /= norm
                step = max(1, COSINES // max(len(these), 1))
                for lo in range(0, len(begin), step):  # windows in blocks: a bounded part of items times windows at once
                    likeness = vectors[these] @ window[:, lo : lo + step]
                    near = np.flatnonzero((likeness >= least[these][:, None]).ravel())
                    which, at = np.divmod(near, likeness.shape[1])
                    score = likeness.ravel()[near]
                    which, at = these[which], at + lo
                    keep = _shared(term, starts[begin[at]], starts[end[at]], which, counts, len(own.vocabulary), PART * sizes)
                    for j, a, b, c in zip(which[keep].tolist(), begin[at[keep]].tolist(), end[at[keep]].tolist(), score[keep].tolist(), strict=True):
                        wanted, words = own.words[j].tolist(), term[starts[a] : starts[b]].tolist()
                        share = common_subsequence(wanted, words) / len(wanted)
                        if share < PART:
                            continue
                        tail = wanted[-own.answers[j] :]
                        answer = common_subsequence(tail, words) / len(tail)
                        if share >= WHOLE or answer >= ANSWER:
                            row = int(row_of[a])
                            out.append((int(ids[row]), own.ids[j], c, share, answer, (a - int(first[row])) * STEP, (b - a) * STEP))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                names = ["doc_id", "item_id", "cosine", "item_share", "answer_share", "first_word", "n_words"]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    return rows.mapInArrow(lean(run), "doc_id long, item_id long, cosine double, item_share double, answer_share double, first_word long, n_words long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a confirmed leak, with all their columns."""
    own, = unused(docs.columns, "leak")
    leaks = sized(find_leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(own)).distinct(), "leaks")
    return docs.join(leaks, F.col(doc_id).cast("long") == F.col(own), "left_anti")
