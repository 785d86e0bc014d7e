"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

1. Significant terms: words, and their first letters, of at most ``MAX_LABELLED`` labelled rows that are in
   significantly more toxic ones (likelihood ratio by document) and make up more of their words; at most ``MAX_TERMS``.
2. The vocabulary is these and every word of every labelled row. Document frequencies are counted over all
   documents, and give idf; a word that no labelled row holds counts as one of frequency 0.
3. A vector has the TF-IDF weights of its significant terms and, beside them, of all its other words. Those are scaled
   so that their length grows with the number of words: the cosine tells a text in
   which terms are dense from a long one with a chance hit, and a copy has cosine 1.
4. Every labelled row with a word is indexed: postings of a term lie in blocks, each with its largest weight. A
   query walks its terms in order of their upper bounds and, once the rest cannot lift an
   example over the k-th best, skips the blocks that hold none that is left or whose own largest
   weight is too small, so the k nearest are exact.
5. Votes of the k nearest are weighted by distance (``VOTE_FLOOR``), so a copy outvotes chance likeness; a prior
   of ``PRIOR_VOTES`` at the share of toxic rows pulls thin evidence towards it. A logistic line from the vote's
   log-odds to the score is fitted over the labelled rows, with a row itself left out of its neighbours and with it.

Defined results: a null or empty text, or one without a word of a labelled row, has no neighbours and scores
the prior; ties between examples at the k-th place go to the lower number in the index; rows with null
or repeated ids are scored like any other; extra columns are kept; without labelled rows every
score is 0; an empty table gives an empty result. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLAIN, forget, hand_back, joined_bytes, labelled_sample, lean, list_array, mix, short_hashes, slices, small_batches, span_hashes, word_spans, written
from .near_dups import shingle_sets

#: Labelled rows that are learned from, at most about so many.
MAX_LABELLED = 20_000
MAX_TERMS = 1 << 14
#: Likelihood ratio, lift of the share of words, and toxic documents that make a term.
LEAST_RATIO, LEAST_LIFT, LEAST_DOCS = 24.0, 8.0, 4
#: Length of the part of other words for each word of a text, and words that every text counts as more.
WORD_WEIGHT, MORE_WORDS = 0.05, 40
NEIGHBOURS = 16
BLOCK = 64
#: A term that more than this share of the examples hold has a dense row; a product scores those of ``TOGETHER`` queries at once.
DENSE_SHARE, TOGETHER = 1 / 12, 64
#: Examples whose dense rows are copied at once for a product of some of them.
COPIED = 1 << 11
#: Postings that are added up at once, so that they stay in a core's cache.
ADDED = 1 << 15
#: Texts of about so many bytes are scored at once; what is made of them stands beside the index in each worker.
SCORED_BYTES = 1 << 19
#: Rows of terms that are weighed or searched at once: an Arrow batch has a thousand and more, and each of its terms takes part in some ten arrays of numbers.
ROWS = 256
#: Examples in a group of which only the largest score is looked at first.
GROUP = 64
#: A word's first bytes of these numbers count as terms, too: inflected forms share them.
PREFIXES = (4, 5, 6, 7)
#: Weight of the prior among votes.
PRIOR_VOTES = 0.5
#: A vote at cosine c weighs c^2 / (1 - c + VOTE_FLOOR).
VOTE_FLOOR = 0.02


@dataclass
class Words:
    """The words of texts, lower-cased and without symbols: each word's text, hash and bytes, and each text's number of words."""

    owner: np.ndarray
    hashes: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        data, offsets = joined_bytes(pc.utf8_lower(texts.fill_null("")))
        data = data.translate(PLAIN)
        starts, ends, bounds = word_spans(data, offsets)
        sizes = np.diff(bounds)
        return cls(np.repeat(np.arange(len(texts)), sizes), span_hashes(data, starts, ends), data, starts, ends, sizes)

    def beginnings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, hash) of the first 4 to 7 bytes of every longer word, a length at a time."""
        padded = np.frombuffer(self.data + bytes(8), np.uint8)
        first = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))[self.starts]
        lengths = self.ends - self.starts
        for size in PREFIXES:
            at = np.flatnonzero(lengths > size)
            yield self.owner[at], mix(short_hashes(first[at], size) + np.uint64(size))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of every word and then of its first bytes; and each text's number of words."""
    words = Words.of(texts)
    both = [(words.owner, words.hashes), *words.beginnings()]
    return np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both]), words.sizes


def _counted(owner: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value below ``count``) in order, and how often each occurs."""
    key, times = np.unique(owner * max(count, 1) + values, return_counts=True)
    return key // max(count, 1), key % max(count, 1), times


class Terms:
    """The known terms: sorted hashes and which of them are ``strong`` (significant); a directory of their first bits finds them."""

    BITS = 20

    def __init__(self, hashes: np.ndarray, strong: np.ndarray | None = None):
        self.hashes = np.sort(hashes.view(np.uint64))
        self.strong = np.ones(len(self.hashes), bool) if strong is None else np.isin(self.hashes, strong.view(np.uint64))

    def __len__(self) -> int:
        return len(self.hashes)

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "strong": self.strong}

    @cached_property
    def directory(self) -> np.ndarray:
        top = (self.hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        return np.searchsorted(top, np.arange((1 << self.BITS) + 1)).astype(np.int32)

    @cached_property
    def strong_bits(self) -> np.ndarray:
        out = np.zeros(1 << 16, bool)
        out[(self.hashes[self.strong] & np.uint64(0xFFFF)).astype(np.int64)] = True
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each term, -1 where it isn't known."""
        out = np.full(len(wanted), -1)
        if not len(self):
            return out
        top = (wanted >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end = self.directory[top], self.directory[top + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            here = at[live]
            hit = self.hashes[here] == wanted[live]
            out[live[hit]] = here[hit]
            at[live] += 1
            live = live[~hit & (here + 1 < end[live])]
        return out

    def known(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The term of each word (-1: unknown), and (text, term) of the significant first bytes."""
        owners, terms = [], []
        for owner, hashes in words.beginnings():
            maybe = np.flatnonzero(self.strong_bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            found = self.find(hashes[maybe])
            owners.append(owner[maybe[found >= 0]])
            terms.append(found[found >= 0])
        return self.find(words.hashes), np.concatenate(owners), np.concatenate(terms)

    def held(self, texts: pa.Array) -> np.ndarray:
        """The terms that texts hold, one for each text and term."""
        words = Words.of(texts)
        at, owner, term = self.known(words)
        hit = at >= 0
        return _counted(np.concatenate([words.owner[hit], owner]), np.concatenate([at[hit], term]), len(self))[1]

    def in_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) of the known terms in texts, by text and term; each text's number of words, and its sum of squared times of unknown words."""
        words = Words.of(texts)
        at, owner, term = self.known(words)
        hit = at >= 0
        found = _counted(np.concatenate([words.owner[hit], owner]), np.concatenate([at[hit], term]), len(self))
        far = np.flatnonzero(~hit)
        own = words.owner[far]
        _, one, times = np.unique(mix(words.hashes[far] + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        unknown = np.bincount(own[one], times.astype(float) ** 2, len(words.sizes))
        return *found, words.sizes, unknown


# ---------------------------------------------------------------- learning
def _unlike(rows: DataFrame, text: str) -> DataFrame:
    """Rows without most near copies: one of those with one label and one smallest shingle stays.

    Copies of an example would make all of its words look significant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            sets, sizes = shingle_sets(part.column(text))
            least = np.zeros(part.num_rows, np.uint64)
            full = np.flatnonzero(sizes)
            least[full] = np.minimum.reduceat(mix(sets), (np.cumsum(sizes) - sizes)[full]) if len(full) else least[full]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("__id", text, "__y")), pa.array(least.view(np.int64))], ["__id", text, "__y", "__like"])

    marked = rows.select("__id", text, "__y").mapInArrow(lean(run), T.StructType([*rows.select("__id", text, "__y").schema.fields, T.StructField("__like", T.LongType())]))
    picked = marked.groupBy("__like", "__y").agg(F.min("__id").alias("__id")).select("__id")
    return rows.join(picked, "__id", "left_semi")


def _term_counts(rows: DataFrame, text: str) -> DataFrame:
    """(h, toxic, clean, toxic_share, clean_share): labelled documents of each kind with a word, and the sums of its shares of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            owner, words, sizes = _features(part.column(text))
            order = np.lexsort((owner, words))
            w, o = words[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])) if len(w) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(w)))
            w, o = w[new], o[new]
            y, share = part.column("__y").to_numpy()[o], times / (sizes[o] + MORE_WORDS)
            head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
            sums = [np.add.reduceat(x, head) if len(w) else np.zeros(0) for x in (y, 1 - y, y * share, (1 - y) * share)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(w[head].view(np.int64)), *(pa.array(x.astype(np.int64)) for x in sums[:2]), *map(pa.array, sums[2:])], ["h", *names])

    names = ("toxic", "clean", "toxic_share", "clean_share")
    counted = rows.select("__y", text).mapInArrow(lean(run), "h long, toxic long, clean long, toxic_share double, clean_share double")
    return counted.groupBy("h").agg(*(F.sum(n).alias(n) for n in names))


def _ratio(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """The likelihood ratio statistic of a word's two counts."""
    total, n = all_toxic + all_clean, toxic + clean
    term = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(F.lit(0.0))
    return 2 * (term(toxic, n * all_toxic / total) + term(clean, n * all_clean / total)
                + term(all_toxic - toxic, (total - n) * all_toxic / total) + term(all_clean - clean, (total - n) * all_clean / total))


def _in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches to ``ROWS`` rows."""
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def _document_counts(docs: DataFrame, text: str, terms: Terms) -> np.ndarray:
    """In how many of all documents each term occurs; a sum of one vector per slice."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known), np.int64)
        for part in slices(batches, text):
            total += np.bincount(known.held(part.column(text)), minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    found = docs.select(text).mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    out = np.zeros(len(terms), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of runs that begin at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _range_maxima(scores: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """At least the largest score among the numbers ``first`` to ``last`` of each range: that of the runs of ``BLOCK`` they touch."""
    table = [np.maximum.reduceat(scores, np.arange(0, len(scores), BLOCK))]
    while (step := 1 << (len(table) - 1)) < len(table[0]):
        table.append(np.maximum(table[-1], np.append(table[-1][step:], np.full(min(step, len(table[0])), -np.inf))))
    a, b = (x.astype(np.int64) // BLOCK for x in (first, last))
    level = np.frexp(b - a + 1)[1] - 1
    every = np.stack(table)
    return np.maximum(every[level, a], every[level, b - (1 << level) + 1])


def _floor(scores: np.ndarray, k: int) -> float:
    """At most the k-th largest score: the k-th of the largest scores of disjoint groups, minus infinity with fewer groups."""
    width = len(scores) // GROUP
    if width < k:
        return -np.inf
    largest = scores[: width * GROUP].reshape(GROUP, width).max(axis=0)
    return float(np.partition(largest, width - k)[width - k])


@dataclass
class Blocks:
    """Runs of ``BLOCK`` postings of one term each."""

    starts: np.ndarray  # of each term's blocks
    at: np.ndarray  # each block's first posting, how many it has, and its first and last example
    size: np.ndarray
    first: np.ndarray
    last: np.ndarray
    most: np.ndarray  # its largest weight, and that of each term
    reach: np.ndarray


@dataclass
class Index:
    """A block-max inverted index of unit vectors, as flat arrays."""

    terms: Terms
    idf: np.ndarray
    starts: np.ndarray  # of each term's postings
    postings: np.ndarray  # example numbers, rising within a term, above the bits of their weights: one copy takes both
    labels: np.ndarray
    ids: list
    prior: float
    unknown_idf: float = 1.0
    #: Slope and height of the fitted line from a vote's log-odds to those of the score.
    line: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def build(cls, terms: Terms, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list, prior: float,
              unknown_idf: float = 1.0) -> Index:
        sizes = np.fromiter((len(t) for t, _ in vectors), np.int64, len(vectors))
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        return cls.of_arrays(terms, idf, term, weight, sizes, labels, ids, prior, unknown_idf)

    @classmethod
    def of_arrays(cls, terms: Terms, idf: np.ndarray, term: np.ndarray, weight: np.ndarray, sizes: np.ndarray, labels: list[int], ids: list, prior: float,
                  unknown_idf: float) -> Index:
        """The index of vectors that lie end to end, ``sizes`` places each; examples are numbered by id."""
        rank = np.empty(len(sizes), np.int64)
        by_id = np.argsort(np.array(ids), kind="stable")
        rank[by_id] = np.arange(len(sizes))
        key = term.astype(np.int64) * max(len(sizes), 1)
        key += np.repeat(rank, sizes)
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.searchsorted(key, np.arange(len(terms) + 2) * max(len(sizes), 1))
        key %= max(len(sizes), 1)
        postings = key.view(np.uint64)
        postings <<= np.uint64(32)
        postings |= weight[order].astype(np.float32).view(np.uint32)
        return cls(terms, idf, starts, postings, np.array(labels, np.float64)[by_id], [ids[k] for k in by_id.tolist()], prior, unknown_idf)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("blocks", "dense", "numbers")}

    @property
    def examples(self) -> np.ndarray:
        return self.postings.view(np.uint32)[1::2]

    @property
    def weights(self) -> np.ndarray:
        return self.postings.view(np.float32)[::2]

    @cached_property
    def numbers(self) -> pa.Array:
        """The examples' ids."""
        return pa.array(self.ids, pa.int64())

    @cached_property
    def blocks(self) -> Blocks:
        """The postings' blocks; made where they are used."""
        counts = -(-np.diff(self.starts) // BLOCK)
        starts = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.starts[:-1], counts) + (np.arange(starts[-1]) - np.repeat(starts[:-1], counts)) * BLOCK
        last = np.minimum(at + BLOCK, np.repeat(self.starts[1:], counts)) - 1
        most = np.maximum.reduceat(self.weights, at) if len(at) else np.zeros(0, np.float32)
        reach = np.zeros(len(counts), np.float32)
        np.maximum.at(reach, np.repeat(np.arange(len(counts)), counts), most)
        return Blocks(starts.astype(np.int32), at.astype(np.int32), (last + 1 - at).astype(np.int32), self.examples[at], self.examples[last], most, reach)

    def vector(self, term: np.ndarray, times: np.ndarray, words: int, unknown: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights; the last place is for unknown words, given by their sum of squared times."""
        w = times * self.idf[term]
        other = ~self.terms.strong[term]
        far = self.unknown_idf * np.sqrt(unknown)
        length = np.sqrt((w[other] ** 2).sum() + far * far)
        room = WORD_WEIGHT * (words + MORE_WORDS)
        w[other] *= room / max(length, 1e-300)
        w = np.append(w, room * far / length if length else room)
        return np.append(term, len(self.terms)), w / np.sqrt((w * w).sum())

    def vectors(self, term: np.ndarray, times: np.ndarray, sizes: np.ndarray, words: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``vector`` of texts whose terms lie end to end, ``sizes`` each: all terms and weights, and the place where each text's begin (and where the last's end)."""
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        w = times * self.idf[term]
        other = ~self.terms.strong[term]
        far = self.unknown_idf * np.sqrt(unknown)
        length = np.sqrt(np.bincount(owner, np.where(other, w * w, 0.0), n) + far * far)
        room = WORD_WEIGHT * (words + MORE_WORDS)
        w = np.where(other, w * (room / np.maximum(length, 1e-300))[owner], w)
        last = np.where(length > 0, room * far / np.where(length > 0, length, 1.0), room)
        norm = np.sqrt(np.bincount(owner, w * w, n) + last * last)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        at = np.arange(len(term)) + owner
        terms, weights = np.full(starts[-1], len(self.terms)), np.empty(starts[-1])
        terms[at], weights[at], weights[starts[1:] - 1] = term, w / norm[owner], last / norm
        return terms, weights, starts

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each term that many examples hold (-1 without), and the rows; made where they are used."""
        row = np.full(len(self.starts) - 1, -1)
        common = np.flatnonzero(np.diff(self.starts) > DENSE_SHARE * len(self.labels))
        row[common] = np.arange(len(common))
        out = np.zeros((len(common), len(self.labels)), np.float32)
        for k, t in enumerate(common.tolist()):
            a, b = self.starts[t], self.starts[t + 1]
            out[k, self.examples[a:b]] = self.weights[a:b]
        return row, out

    def common_scores(self, term: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What the dense terms add to each example's cosine, a row per vector; vectors as of ``vectors``."""
        row, dense = self.dense
        at = row[term]
        hit = at >= 0
        held = np.zeros((len(starts) - 1, len(dense)), np.float32)
        held[np.repeat(np.arange(len(starts) - 1), np.diff(starts))[hit], at[hit]] = weight[hit]
        used = np.flatnonzero(held.any(axis=0))
        if 2 * len(used) >= len(dense):
            return held @ dense
        held, out = held[:, used], np.empty((len(held), dense.shape[1]), np.float32)
        for first in range(0, dense.shape[1], COPIED):
            some = slice(first, first + COPIED)
            np.matmul(held, dense[used, some], out=out[:, some])
        return out

    def all_nearest(self, term: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of every vector, in order; vectors as of ``vectors``.

        Vectors in which much is dense are looked at together, so that products for the others are small.
        """
        sizes = np.diff(starts)
        dense = np.concatenate([[0], np.cumsum(self.dense[0][term] >= 0)])
        order = np.argsort(np.diff(dense[starts]) / sizes, kind="stable")
        at = _ranges(starts[:-1][order], sizes[order])
        term, weight, starts = term[at], weight[at], np.concatenate([[0], np.cumsum(sizes[order])])
        sparse = (self.dense[0][term] < 0) & (self.blocks.reach[term] > 0)
        own, own_weight, bounds = term[sparse], weight[sparse], np.concatenate([[0], np.cumsum(sparse)])[starts].tolist()
        found: list = [None] * len(order)
        for first in range(0, len(order), TOGETHER):
            few = starts[first : first + TOGETHER + 1]
            for n, row in enumerate(self.common_scores(term[few[0] : few[-1]], weight[few[0] : few[-1]], few - few[0]), first):
                held = slice(bounds[n], bounds[n + 1])
                found[order[n]] = self._nearest(own[held], own_weight[held], k, row.astype(np.float64))
        return found

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the k nearest with a positive cosine, the nearest first."""
        return self.all_nearest(term, weight, np.array([0, len(term)]), k)[0]

    def _nearest(self, term: np.ndarray, weight: np.ndarray, k: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` of the terms without a dense row, on top of the ``scores`` of those with one.

        Where half of what terms can add at most is under 1, the most a cosine can be, terms come in order of that.
        Once the rest cannot lift an example over the k-th best so far, blocks are only
        read if they hold an example that still can get there.
        """
        lists = self.blocks
        reach = lists.reach[term] * weight
        left = float(reach.sum())
        parts = [(slice(None), left)]
        if left < 2:
            order = np.argsort(-reach, kind="stable")
            term, weight = term[order], weight[order]
            rest = np.append(np.cumsum(reach[order][::-1])[::-1], 0.0)
            middle = int(np.searchsorted(-rest, -rest[0] / 2))
            parts = [(slice(middle), rest[0]), (slice(middle, None), rest[middle])]
        for part, left in parts:
            own, w = term[part], weight[part]
            if not len(own):
                continue
            left += 1e-5  # weights are rounded
            if left < scores.max() and left < (threshold := _floor(scores, k)):
                # a block is read if one of its examples can still get there with the most that it and all other terms add
                first = lists.starts[own]
                counts = lists.starts[own + 1] - first
                blocks, w = _ranges(first, counts), np.repeat(w, counts)
                most = left - (np.repeat(lists.reach[own], counts) - lists.most[blocks]) * w
                keep = _range_maxima(scores, lists.first[blocks], lists.last[blocks]) + most >= threshold
                blocks, w = blocks[keep], w[keep]
                lo, sizes = lists.at[blocks].astype(np.int64), lists.size[blocks].astype(np.int64)
            else:
                lo = self.starts[own]
                sizes = self.starts[own + 1] - lo
            w, total = w.astype(np.float32), np.cumsum(sizes)
            cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, ADDED)), len(lo))).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found = np.concatenate(list(map(self.postings.__getitem__, map(slice, lo[a:b].tolist(), (lo[a:b] + sizes[a:b]).tolist()))))
                added = found.view(np.float32)[::2] * np.repeat(w[a:b], sizes[a:b])
                found >>= np.uint64(32)
                scores += np.bincount(found.view(np.int64), added, len(scores))
        best = np.flatnonzero(scores >= max(_floor(scores, k), 5e-324))
        if len(best) > k:
            floor = np.partition(scores[best], len(best) - k)[len(best) - k]
            best = best[scores[best] >= floor]
        best = best[np.lexsort((best, -scores[best]))][:k]
        return best, scores[best]

    def score(self, cosines: np.ndarray, best: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The calibrated votes."""
        a, b = self.line
        return 1 / (1 + np.exp(-(a * log_odds(self.vote(cosines, best, counts)) + b)))

    def vote(self, cosines: np.ndarray, best: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Labels of neighbours that lie end to end, ``counts`` of each text, weighted by distance, with the prior."""
        votes = cosines**2 / (np.maximum(1 - cosines, 0) + VOTE_FLOOR)
        owner = np.repeat(np.arange(len(counts)), counts)
        toxic, every = (np.bincount(owner, x, len(counts)) for x in (votes * self.labels[best], votes))
        return (toxic + PRIOR_VOTES * self.prior) / (every + PRIOR_VOTES)


def log_odds(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fitted_line(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and height of the logistic line of labels over the log-odds of votes, by Newton's method; the slope isn't below 0."""
    x = np.stack([log_odds(votes), np.ones(len(votes))], 1)
    w = np.array([1.0, 0.0])
    pull = np.array([1e-2, 1e-2])  # towards the plain vote
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + pull * (w - [1.0, 0.0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> Index:
    """The index of labelled examples for which ``usable`` (over ``labels``) is true. Its size is bounded by ``max_labelled``."""
    small_batches(docs.sparkSession)
    picked = labelled_sample(labels, label, usable, max_labelled, doc_id)
    rows = written(docs.select(F.col(doc_id).alias("__id"), text).join(F.broadcast(picked), "__id"), "toxic-rows")
    unlike = written(_unlike(rows, text), "toxic-unlike")
    by = {r["__y"]: r["count"] for r in unlike.groupBy("__y").count().collect()}
    toxic, clean = by.get(1, 0), by.get(0, 0)
    prior = toxic / max(toxic + clean, 1)
    found = []
    if toxic and clean:
        counts = _term_counts(unlike, text).filter(F.col("toxic") >= LEAST_DOCS)
        ratio = _ratio(F.col("toxic"), F.col("clean"), toxic, clean)
        lift = F.col("toxic_share") * clean >= LEAST_LIFT * toxic * F.col("clean_share")
        found = counts.select("h", ratio.alias("g"), lift.alias("l")).filter(F.col("l") & (F.col("g") >= LEAST_RATIO)).orderBy(F.desc("g"), "h").limit(MAX_TERMS).collect()
    strong = np.array([r["h"] for r in found], np.int64)
    forget(unlike)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every word of every labelled row, and the first letters that are significant."""
        for part in slices(batches, text):
            owner, hashes, sizes = _features(part.column(text))
            used = np.isin(hashes, strong.view(np.uint64))
            used[: int(sizes.sum())] = True
            owner, hashes = owner[used], hashes[used]
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(owner) else owner
            counts, times = np.bincount(owner[new], minlength=part.num_rows), np.diff(np.append(new, len(owner)))
            made = [part.column("__id"), part.column("__y"), pa.array(sizes), list_array(hashes[new].view(np.int64), counts, pa.int64()), list_array(times, counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, ["id", "y", "words", "terms", "times"]).filter(pa.array(sizes > 0))

    id_type = rows.schema["__id"].dataType.simpleString()
    # written: a second Python step in the stage would take a second worker for each core, and executors give idle workers their turn, so all of them would hold the index
    held = written(rows.mapInArrow(lean(words_of), f"id {id_type}, y int, words long, terms array<long>, times array<int>"), "toxic-words")
    terms = Terms(held.select(F.explode("terms").alias("h")).distinct().toArrow().column("h").to_numpy(), strong)
    seen, total = _document_counts(docs, text, terms), docs.count()
    idf = np.log((1 + total) / (1 + seen)) + 1
    unknown_idf = float(np.log(1 + total) + 1)
    sent = docs.sparkSession.sparkContext.broadcast(Index.build(terms, idf, [], [], [], prior, unknown_idf))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in _in_rows(batches):
            lists = part.column("terms")
            sizes = pc.list_value_length(lists).to_numpy()
            at = np.searchsorted(own.terms.hashes, lists.flatten().to_numpy().view(np.uint64))
            times, ends = part.column("times").flatten().to_numpy().astype(np.float64), np.cumsum(sizes)
            weights = np.delete(own.vectors(at, times, sizes, part.column("words").to_numpy(), np.zeros(len(sizes)))[1], ends + np.arange(len(ends)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), list_array(at, sizes, pa.int32()), list_array(weights.astype(np.float32), sizes, pa.float32())], ["id", "y", "terms", "weights"])

    made = held.mapInArrow(lean(vectors), f"id {id_type}, y int, terms array<int>, weights array<float>").toArrow()
    flat = lambda c: pa.chunked_array([x.flatten() for x in made.column(c).chunks], made.schema.field(c).type.value_type).to_numpy()
    sizes = pc.list_value_length(made.column("terms")).to_numpy()
    parts = [flat("terms"), flat("weights"), sizes, made.column("y").to_pylist(), made.column("id").to_pylist()]
    sent.destroy()
    del made
    hand_back()
    index = Index.of_arrays(terms, idf, *parts, prior, unknown_idf)
    del parts
    hand_back()
    if toxic and clean:
        index.line = _calibrated(index, held)
    forget(rows, held)
    return index


def _end_to_end(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.float64)))


def _calibrated(index: Index, held: DataFrame) -> tuple[float, float]:
    """The line fitted over the labelled rows: each as a text that isn't known (itself left out) and as a copy of itself."""
    sent = held.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        number = {x: k for k, x in enumerate(own.ids)}
        for part in _in_rows(batches):
            lists, words = part.column("terms"), part.column("words").to_numpy()
            term = own.terms.find(lists.flatten().to_numpy().view(np.uint64))
            made = own.vectors(term, part.column("times").flatten().to_numpy().astype(np.float64), pc.list_value_length(lists).to_numpy(), words, np.zeros(len(words)))
            found = []
            for own_id, (best, cosines) in zip(part.column("id").to_pylist(), own.all_nearest(*made, NEIGHBOURS + 1), strict=True):
                other = best != number[own_id]
                found += [(best[other][:NEIGHBOURS], cosines[other][:NEIGHBOURS]), (best[:NEIGHBOURS], cosines[:NEIGHBOURS])]
            best, cosines = _end_to_end(found)
            votes = own.vote(cosines, best, np.array([len(x) for x, _ in found], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(votes), pa.array(np.repeat(part.column("y").to_numpy(), 2))], ["vote", "y"])

    found = held.mapInArrow(lean(run), "vote double, y int").toArrow()
    sent.destroy()
    return fitted_line(found.column("vote").to_numpy(), found.column("y").to_numpy())


# ---------------------------------------------------------------- scoring
def score(docs: DataFrame, index: Index, text: str = "text", name: str = "score", evidence: str = "evidence", neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with ``name`` (double) and ``evidence`` (array of id, cosine and label of the neighbours, the nearest first).

    One scan without a shuffle; columns of these names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [f for f in docs.schema.fields if f.name not in (name, evidence)]
    names = [f.name for f in kept]
    sent = spark.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in slices(batches, text, SCORED_BYTES):
            owner, term, times, words, unknown = own.terms.in_texts(part.column(text))
            scores, counts = np.full(part.num_rows, own.prior), np.zeros(part.num_rows, np.int64)
            held = np.bincount(owner, minlength=part.num_rows)
            some = np.flatnonzero(held)
            found = own.all_nearest(*own.vectors(term, times.astype(np.float64), held[some], words[some], unknown[some]), neighbours)
            best, cosines = _end_to_end(found)
            counts[some] = [len(x) for x, _ in found]
            scores[some] = own.score(cosines, best, counts[some])
            flat = pa.StructArray.from_arrays([own.numbers.take(pa.array(best)), pa.array(cosines), pa.array(own.labels[best].astype(np.int32))], fields=list(kind.value_type))
            shown = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores), shown], [*names, name, evidence])

    shape = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    return docs.mapInArrow(lean(run), T.StructType([*kept, T.StructField(name, T.DoubleType()), T.StructField(evidence, shape)]))
