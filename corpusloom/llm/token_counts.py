"""Byte-level BPE token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; the distinct unseen ones of a batch become one
ragged array of symbols. In every round each sequence finds its pair of lowest
rank, and all sequences merge theirs at once; what survives is counted. Long pre-tokens merge rank by
rank in the same way, but look only at places that change. Counts of
seen chunks are kept by a task in a bounded memo.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows with null or
repeated ids are counted like any other; extra columns are ignored; an empty table
gives an empty result. Texts are never cut and pre-tokens of any length are exact.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Codes, lean, slices

#: Fixed value: the pre-token pattern of the public 50k byte-level vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A memo is emptied when it holds so many chunks, or so many characters.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 16 << 20
#: Of longer pre-tokens only the places that change are looked at again, which keeps their cost near n log n.
LONG_SYMBOLS = 1024
_NONE = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The printable letter of every byte in byte-level vocabularies, by its public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pre_token_pattern(model: dict) -> str:
    """The pre-token pattern that a tokenizer file states; an error if it cuts texts in a way that isn't built here."""
    cut = model.get("pre_tokenizer") or {}
    if model.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError("only byte-level files without a normalizer or a blank put first are counted")
    return PRE_TOKEN


class PairTable:
    """Merge rules as a sorted key array: (left, right) to rank and to the merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        letters = _byte_letters()
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into[order]
        self.specials = [t["content"] for t in model.get("added_tokens", [])]
        self.pattern = pre_token_pattern(model)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``_NONE`` where there is no rule) and merged ids of pairs."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at] == wanted
        return np.where(found, self.ranks[at], _NONE), self.into[at]


def merge_all(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> np.ndarray:
    """How many symbols of each sequence survive. ``symbols`` holds the sequences end to end."""
    out = lengths.astype(np.int64).copy()
    live = np.flatnonzero(out > 1)
    keep = np.repeat(out > 1, out)
    symbols, lengths = symbols[keep], out[live]
    while len(live):
        starts = np.cumsum(lengths) - lengths
        ranks = np.full(len(symbols), _NONE)
        found, into = pairs.find(symbols[:-1], symbols[1:])
        ranks[:-1] = found
        ranks[starts + lengths - 1] = _NONE  # no pair reaches into the next sequence
        lowest = np.minimum.reduceat(ranks, starts)
        done = lowest == _NONE
        out[live[done]] = lengths[done]
        hit = (ranks == np.repeat(lowest, lengths)) & (ranks != _NONE)
        # of hits that overlap (a run of one symbol) every second one merges, from the left
        first = hit.copy()
        first[1:] &= ~hit[:-1]
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(first, place, 0))
        hit &= (place - run) % 2 == 0
        at = np.flatnonzero(hit)
        symbols = symbols.copy()
        symbols[at] = into[at]
        survives = np.ones(len(symbols), bool)
        survives[at + 1] = False
        survives &= np.repeat(~done, lengths)
        kept = np.add.reduceat(survives.astype(np.int64), starts)
        symbols, lengths, live = symbols[survives], kept[~done], live[~done]
        short = lengths == 1
        if short.any():
            out[live[short]] = 1
            symbols = symbols[np.repeat(~short, lengths)]
            lengths, live = lengths[~short], live[~short]
    return out


def merge_ranked(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> np.ndarray:
    """What ``merge_all`` gives, where only pairs that can merge are touched again: for sequences of many symbols.

    Sequences merge together rank by rank, as their pairs don't meet; all places of a rank merge at once, and only
    their neighbours are looked up anew. Arrays link each symbol to the one before and after it.
    """
    n = len(symbols)
    ids, owner = symbols.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(lengths)[lengths > 0]
    after[ends - 1] = -1
    before[(ends - lengths[lengths > 0])] = -1
    ranks, into = np.full(n, _NONE), np.zeros(n, np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def offer(at: np.ndarray) -> None:
        last = after[at] < 0
        ranks[at[last]] = _NONE
        at = at[~last]
        ranks[at], into[at] = pairs.find(ids[at], ids[after[at]])
        at = at[ranks[at] != _NONE]
        if not len(at):
            return
        at = at[np.argsort(ranks[at], kind="stable")]
        heads = np.flatnonzero(np.diff(ranks[at], prepend=-1))
        for rank, own in zip(ranks[at[heads]].tolist(), np.split(at, heads[1:]), strict=True):
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(order, rank)
            waiting[rank].append(own)

    if n:
        offer(np.arange(n))
    counts = lengths.astype(np.int64).copy()
    while order:
        rank = heapq.heappop(order)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[ranks[at] == rank]
        if not len(at):
            continue
        # in a run of one symbol every second pair merges, from the left
        place = np.arange(len(at))
        first = np.concatenate([[True], after[at[:-1]] != at[1:]])
        left = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
        right = after[left]
        ids[left], ranks[right] = into[left], _NONE
        after[left] = after[right]
        next_ones = after[left]
        before[next_ones[next_ones >= 0]] = left[next_ones >= 0]
        counts -= np.bincount(owner[right], minlength=len(counts))
        near = before[left]
        offer(np.unique(np.concatenate([left, near[near >= 0]])))
    return counts


class Counter:
    """Counts tokens of batches of texts for one vocabulary file."""

    def __init__(self, path: str):
        self.pairs = _pairs(path)
        self.pattern = regex.compile(self.pairs.pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(self.pairs.specials, key=len, reverse=True)))) if self.pairs.specials else None
        # a blank between two characters that are surely not white space starts a pre-token
        self.cut = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
        self.rare = re.compile(r"[^\S \n]|[\x1c-\x1f]")
        self.memo, self.chars = Codes(), 0
        self.totals = np.zeros(1 << 12, np.int32)

    def chunks(self, text: str) -> list[str]:
        """Pieces whose pre-tokens add up to the text's; all but the first stand for a blank and themselves."""
        plain = not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or self.rare.search(text))
        return text.split(" ") if plain else self.cut.split(text)

    def learn(self, keys: list, at: int) -> None:
        """Count new chunks, which have the codes from ``at`` on: their pre-tokens in one ragged array."""
        chunks = [x[0] if isinstance(x, tuple) else " " + x for x in keys]
        blobs = Codes()
        ids: list[int] = []
        sizes = np.empty(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            found = self.pattern.findall(chunk)
            ids += map(blobs.__getitem__, found)
            sizes[k] = len(found)
        tokens = self.merged([x.encode() for x in blobs])
        totals = np.bincount(np.repeat(np.arange(len(chunks)), sizes), tokens[ids] if ids else None, len(chunks))
        while len(self.totals) < at + len(chunks):
            self.totals = np.concatenate([self.totals, np.zeros_like(self.totals)])
        self.totals[at : at + len(chunks)] = totals

    def merged(self, blobs: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
        counts = np.zeros(len(blobs), np.int64)
        for merge, own in ((merge_all, np.flatnonzero(lengths <= LONG_SYMBOLS)), (merge_ranked, np.flatnonzero(lengths > LONG_SYMBOLS))):
            if len(own):
                symbols = self.pairs.byte_ids[np.frombuffer(b"".join([blobs[k] for k in own.tolist()]), np.uint8)]
                counts[own] = merge(symbols, lengths[own], self.pairs)
        return counts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; strings of special tokens count as one."""
        words: list = []
        specials = np.zeros(len(texts), np.int64)
        ends = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = self.special.split(text) if self.special else [text]
            specials[k] = len(pieces) - 1
            for piece in pieces:
                if piece:
                    own = self.chunks(piece)
                    own[0] = (own[0],)  # no blank before it
                    words += own
            ends[k] = len(words)
        if len(self.memo) > MEMO_ENTRIES or self.chars > MEMO_CHARS:
            self.memo, self.chars = Codes(), 0
        known = len(self.memo)
        codes = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if new := self.memo.take_new():
            self.chars += sum(len(x[0]) if isinstance(x, tuple) else len(x) for x in new)
            self.learn(new, known)
        sums = np.zeros(len(words) + 1, np.int64)
        np.cumsum(self.totals[codes], out=sums[1:])
        return specials + np.diff(sums[ends], prepend=0)


@lru_cache(2)
def _pairs(path: str) -> PairTable:
    """All that a worker keeps beyond a task: the vocabulary. The memo is a task's own."""
    return PairTable(path)


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", keep: str = "doc_id", limit: int = 512) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``tokenizer`` is the path of a byte-level BPE ``.json`` file on every machine.
    The plan is one scan without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for part in slices(batches, text):
            texts = [x or "" for x in part.column(text).to_pylist()]
            tokens = counter.count(texts)
            sizes = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(keep), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                [keep, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(keep, text).mapInArrow(lean(run), f"{keep} {df.schema[keep].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
