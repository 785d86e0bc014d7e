"""SentencePiece encoding and decoding with a streaming Viterbi over piece boundaries.

The lattice has a node at every character boundary and an edge for every piece.
For a BPE model the best path is the one on which every two neighbouring pieces are
their own BPE encoding; a prefix has exactly one such path, so each node keeps one
backpointer. (Maximising summed piece scores instead, as for a unigram model, does not give
a BPE model's ids.) Only nodes within the longest piece of the front can be extended:
the encoder keeps that window, and whenever the backpointer paths of all its
nodes meet in one boundary, it commits the ids before it and forgets them.

No piece spans from a character to a later blank, so all paths meet there; text is
cut at these boundaries, and a task keeps the ids of seen cuts in a bounded memo.

Defined results: a null or empty text has no ids and decodes to an empty text; rows
with null or repeated ids are encoded like any other; extra columns are kept; an
empty table gives an empty result; texts of any length are encoded whole within a
bounded window. U+2581 in a text counts as a blank, as the format has it.
"""

from __future__ import annotations

import copy
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Codes, lean, list_array, slices, small_batches

BLANK = "▁"
#: A task's memo is emptied when it holds so many cuts (or half as many pairs), or so many characters.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 16 << 20
#: Texts of about so many bytes are encoded together: new cuts share the lattices of common beginnings.
SLICE_BYTES = 4 << 20
#: Numbers of pieces take so many bits: those of a model file and all characters.
NUMBER_BITS = 22
#: Characters of a common beginning that are looked for.
PREFIX = 16
_NO_PAIR = float("-inf")


class Pieces:
    """The pieces of a BPE model file, with byte fallback for other characters."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        # what each id stands for, as bytes
        blobs = [b""] * size
        for i in plain:
            blobs[i] = names[i].replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            if i != self.unknown:
                blobs[i] = bytes([b])
        blobs[self.unknown] = " ⁇ ".encode()
        self.byte_lengths = np.fromiter(map(len, blobs), np.int64, size)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.bytes = np.frombuffer(b"".join(blobs), np.uint8)
        #: The pieces by number: those of the file by id, then characters outside of it as they are met.
        self.names = [*names]
        self.numbers = dict(self.ids)
        #: By its last three characters (two at a text's start), the lengths of pieces that may end there, the longest first.
        ends: dict[str, set[int]] = {}
        for name in self.ids:
            if len(name) > 2:
                ends.setdefault(name[-3:], set()).add(len(name))
        self.short = {name: (2, 1) for name in self.ids if len(name) == 2}
        self.tails = {k: (*sorted(v, reverse=True), *self.short.get(k[1:], (1,))) for k, v in ends.items()}
        self.known_joins: dict[int, bool] = {}

    def with_own_memo(self) -> Pieces:
        """The same tables with an empty memo of joins and of characters."""
        out = copy.copy(self)
        out.known_joins = {}
        out.names, out.numbers = [*self.names], dict(self.ids)
        return out

    def number(self, character: str) -> int:
        """The number of a character outside of the file."""
        self.numbers[character] = number = len(self.names)
        self.names.append(character)
        return number

    def joins(self, left: int, right: int) -> bool:
        """Whether two pieces, by number, may stand next to each other, that is, encode to themselves.

        Plain BPE of both together, the best-scored neighbours first and the leftmost of
        equals; a merge across their border says no.
        """
        if len(self.known_joins) > MEMO_ENTRIES // 2:
            self.known_joins.clear()
        name = self.names[left]
        get, parts, border = self.scores.get, [*name, *self.names[right]], len(name)
        scores = [get(a + b, _NO_PAIR) for a, b in zip(parts, parts[1:], strict=False)]
        while (best := max(scores, default=_NO_PAIR)) > _NO_PAIR:
            k = scores.index(best)
            if k == border - 1:
                break
            border -= k < border
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], _NO_PAIR)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], _NO_PAIR)
        known = self.known_joins[left << NUMBER_BITS | right] = best == _NO_PAIR and border == 1 and len(parts) == 2
        return known

    def extend(self, text: str, ends: list[int], last: list[int], before: int = -1) -> None:
        """For every new boundary of ``text``, find the one piece that ends its path.

        ``ends`` holds the length of that piece for the boundaries done so far, ``last`` its number; ``before`` is that of the piece before the text.
        """
        numbers, tails, short, known = self.numbers, self.tails, self.short, self.known_joins
        for i in range(len(ends), len(text) + 1):
            for n in tails.get(text[i - 3 : i]) or short.get(text[i - 2 : i], (1,)) if i > 2 else (2, 1)[2 - i :]:
                at = i - n
                if at < 0:
                    continue
                piece = numbers.get(text[at:i])
                if n == 1:  # the only one that is left
                    if piece is None:
                        piece = self.number(text[at])
                    break
                if piece is None:
                    continue
                left = last[at] if at else before
                if left < 0:
                    break
                if (joined := known.get(left << NUMBER_BITS | piece)) is None:
                    joined = self.joins(left, piece)
                if joined:
                    break
            ends.append(n)
            last.append(piece)

    def spell(self, number: int) -> list[int]:
        """The ids of a piece: its own, or those of its bytes."""
        if number < len(self.byte_lengths):
            return [number]
        return [self.byte_ids[b] for b in self.names[number].encode()]


class StreamEncoder:
    """Encodes a string that arrives in parts; ``feed`` and ``end`` return the ids that are settled."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # from the last committed boundary on
        self.ends: list[int] = [0]  # at boundary i the length of the last piece of its only path
        self.last: list[int] = [-1]  # and its number
        self.before = -1  # that of the last committed piece

    def feed(self, text: str) -> list[int]:
        """Extend the lattice by ``text``; ids of what it settles."""
        out: list[int] = []
        step = 4 * self.pieces.longest
        for at in range(0, len(text), step):
            self.text += text[at : at + step]
            self.pieces.extend(self.text, self.ends, self.last, self.before)
            if len(self.text) > step:
                out += self._commit(len(self.text))
        return out

    def _commit(self, i: int) -> list[int]:
        """Commit the ids before the boundary in which all paths of the window meet."""
        live = set(range(i - self.pieces.longest + 1, i + 1))
        while len(live) > 1:  # the path furthest ahead takes a step back
            k = max(live)
            live.discard(k)
            live.add(k - self.ends[k])
        boundary = live.pop()
        return self._take(boundary) if boundary else []

    def _take(self, boundary: int) -> list[int]:
        cuts, k = [], boundary
        while k:
            cuts.append(self.last[k])
            k -= self.ends[k]
        self.before = cuts[0]
        self.text, self.ends, self.last = self.text[boundary:], [0, *self.ends[boundary + 1 :]], [-1, *self.last[boundary + 1 :]]
        return [x for piece in reversed(cuts) for x in self.pieces.spell(piece)]

    def end(self) -> list[int]:
        return self._take(len(self.text)) if self.text else []


def _shared(cuts: list[str], order: list[int]) -> list[int]:
    """How many characters each cut, in ``order``, has in common with the one before, up to ``PREFIX``; a shorter cut counts as filled up with U+0000."""
    if not cuts:
        return []
    heads = np.array([cuts[k] for k in order], f"U{PREFIX}").view(np.uint32).reshape(len(cuts), PREFIX)
    other = np.ones((len(cuts), PREFIX + 1), bool)
    other[1:, :PREFIX] = heads[1:] != heads[:-1]
    return other.argmax(axis=1).tolist()


class Codec:
    """Encodes and decodes batches of texts for one model file."""

    def __init__(self, path: str):
        self.pieces = _pieces(path).with_own_memo()
        self._forget()

    def _forget(self) -> None:
        self.memo = Codes()
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.chars = 0

    def cuts(self, text: str) -> list[str]:
        """The text cut before every blank that follows another character; each cut begins with one blank less."""
        words = text.replace(BLANK, " ").split(" ")
        if "" not in words:
            return words
        out: list[str] = []
        blanks = 0
        for word in words:
            if word:
                out.append(BLANK * blanks + word)
                blanks = 0
            else:
                blanks += 1
        if blanks:
            out.append(BLANK * (blanks - 1))
        return out

    def encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of cuts end to end, in sorted order; and for each cut where its ids begin and how many they are.

        In sorted order a cut keeps the lattice of the beginning it shares with the one before.
        """
        pieces, flat, room = self.pieces, array("i"), 4 * self.pieces.longest - 1
        extend, known, add = pieces.extend, len(pieces.byte_lengths), flat.extend
        order = sorted(range(len(cuts)), key=cuts.__getitem__)
        stops = []
        before, ends, last = "", [0], [-1]
        for k, same in zip(order, _shared(cuts, order), strict=True):
            cut = cuts[k]
            if len(cut) > room:
                encoder = StreamEncoder(pieces)
                add(encoder.feed(BLANK + cut))
                add(encoder.end())
                stops.append(len(flat))
                continue
            same = min(same, len(ends) - 2, len(cut)) + 2 if cut.startswith(before[:same]) else 1
            del ends[same:], last[same:]
            text = BLANK + cut
            extend(text, ends, last)
            before, at, own = cut, len(text), []
            while at:
                own.append(last[at])
                at -= ends[at]
            own.reverse()
            if max(own) >= known:
                own = [y for x in own for y in pieces.spell(x)]
            add(own)
            stops.append(len(flat))
        upto = np.array([0, *stops], np.int64)
        starts, sizes = np.empty(len(cuts), np.int64), np.empty(len(cuts), np.int64)
        starts[order], sizes[order] = upto[:-1], np.diff(upto)
        return np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), starts, sizes

    def _learn(self, new: list[str], at: int) -> None:
        ids, starts, sizes = self.encode_cuts(new)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.sizes) < at + len(new):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[at : at + len(new)] = sizes
        self.starts[at : at + len(new)] = self.used + starts
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of each text's. Cuts are numbered text by text, so none is held beside the memo."""
        if len(self.memo) > MEMO_ENTRIES or self.chars > MEMO_CHARS:
            self._forget()
        known, number = len(self.memo), self.memo.__getitem__
        codes = [np.fromiter(map(number, cuts := self.cuts(text)), np.int32, len(cuts)) if text else np.zeros(0, np.int32) for text in texts]
        if new := self.memo.take_new():
            self.chars += sum(map(len, new))
            self._learn(new, known)
        counts, out = np.zeros(len(texts), np.int64), []
        for lo, hi in _runs(np.fromiter(map(len, codes), np.int64, len(codes))):
            own = np.concatenate(codes[lo:hi])
            sizes = self.sizes[own]
            sums = np.zeros(len(own) + 1, np.int64)
            np.cumsum(sizes, out=sums[1:])
            at = np.arange(sums[-1]) + np.repeat(self.starts[own] - sums[:-1], sizes)
            counts[lo:hi] = np.diff(sums[np.cumsum([len(x) for x in codes[lo:hi]])], prepend=0)
            out.append(self.flat[at])
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become U+FFFD; the blank put before each text goes."""
        out: list[str] = []
        ends = np.cumsum(counts)
        for lo, hi in _runs(counts):
            first = int(ends[lo] - counts[lo])
            own = ids[first : int(ends[hi - 1])]
            lengths = self.pieces.byte_lengths[own]
            sums = np.zeros(len(own) + 1, np.int64)
            np.cumsum(lengths, out=sums[1:])
            at = np.arange(sums[-1]) + np.repeat(self.pieces.byte_starts[own] - sums[:-1], lengths)
            data = self.pieces.bytes[at].tobytes()
            begin, end = sums[ends[lo:hi] - counts[lo:hi] - first], sums[ends[lo:hi] - first]
            out += [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        return out


def _runs(sizes: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Cut rows of ``sizes`` parts each into runs of about ``most`` parts (one row at least): arrays over parts stay small."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")), at + 1)
        yield at, end
        at = end


@lru_cache(2)
def _pieces(path: str) -> Pieces:
    """All that a worker keeps beyond a task: the model's tables. Memos are a task's own."""
    return Pieces(path)


def encode_texts(df: DataFrame, model: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with an array<int> column of ids. One scan without a shuffle.

    ``model`` is the path of a BPE ``.model`` file on every machine. A column named
    like ``ids`` is replaced.
    """
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != ids]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for part in slices(batches, text, SLICE_BYTES):
            found, counts = codec.encode([x or "" for x in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), list_array(found, counts, pa.int32())], [*names, ids])

    return df.mapInArrow(lean(run), T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def encode_checked(df: DataFrame, model: str, text: str = "text", ids: str = "token_ids", exact: str = "round_trip") -> DataFrame:
    """``encode_texts`` with a boolean column besides: whether the ids decode to the text (a null text counts as empty).

    Both ways share one pass and one worker; decoded texts don't leave it.
    """
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (ids, exact)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for part in slices(batches, text, SLICE_BYTES):
            texts = [x or "" for x in part.column(text).to_pylist()]
            found, counts = codec.encode(texts)
            same = [a == b for a, b in zip(codec.decode(found, counts), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), list_array(found, counts, pa.int32()), pa.array(same, pa.bool_())], [*names, ids, exact])

    return df.mapInArrow(lean(run), T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(exact, T.BooleanType())]))


def decode_ids(df: DataFrame, model: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with a string column of what the ids stand for; null ids are empty."""
    kept = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(ids).fill_null(pa.scalar([], part.column(ids).type))
                counts = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                texts = codec.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], [*names, text])

    return df.mapInArrow(lean(run), T.StructType([*kept, T.StructField(text, T.StringType())]))
