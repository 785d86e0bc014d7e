"""Chat formatting at the token level.

Each part of a turn (role, text) is encoded on its own, and reserved ids, which no text can
produce, are spliced in between. Masks come from prefix sums over +1 where a part
begins and -1 where it ends. Control strings that occur in a role or text are escaped first, so
that the formatted text, too, can be read back:

    <s>[ROLE]user[/ROLE]text</s><s>[ROLE]assistant[/ROLE]text</s>...

Escaping puts U+241B after the first character of a control string, and writes U+241B itself
as U+241B 0; it is undone exactly by ``unescape``.

A conversation is written as blocks of turns in order. Rows are dealt by ranges of
(conversation, turn), so that a conversation of any length is formatted by many
tasks; only digests of a whole conversation are taken in one pass over its blocks.

Defined results: a null role or text is empty; rows with no conversation id form one
conversation of their own (its id stays null); equal (conversation, turn) pairs are ordered by role, then
text, and repeated rows all stay; extra columns are ignored; an empty table gives
no blocks. Texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array

#: The template's control strings; each has a reserved id after the vocabulary's own.
OPEN, ROLE, TEXT, CLOSE = "<s>", "[ROLE]", "[/ROLE]", "</s>"
TEMPLATE = (OPEN, ROLE, TEXT, CLOSE)
#: Control strings of common chat templates, which are escaped as well.
FOREIGN = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
CONTROL = (*TEMPLATE, *FOREIGN)
MARK = "␛"
#: Turns, and characters of text, after which a block is closed.
BLOCK_TURNS = 64
BLOCK_CHARS = 1 << 20
#: Characters, and ids, that a task works on at once (one block at least).
SLICE_CHARS = 1 << 20
SLICE_IDS = 1 << 19

_ESCAPE = re.compile("|".join(map(re.escape, (MARK, *CONTROL))))
_FIRST = {x[0] for x in (MARK, *CONTROL)}
_UNESCAPE = re.compile(f"{MARK}(0|1)")


def escape(text: str) -> str:
    """The text without control strings; ``unescape`` gives it back."""
    if not any(c in text for c in _FIRST):
        return text
    return _ESCAPE.sub(lambda m: MARK + "0" if m[0] == MARK else m[0][0] + MARK + "1" + m[0][1:], text)


def unescape(text: str) -> str:
    return text if MARK not in text else _UNESCAPE.sub(lambda m: MARK if m[1] == "0" else "", text)


class Assembler:
    """Turns into token ids and masks, and back."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.reserved = {s: first + k for k, s in enumerate(TEMPLATE)}
        self.open, self.role, self.text, self.close = self.reserved.values()
        # the bytes of each id, end to end; reserved ids have none
        blobs = [b""] * (first + len(TEMPLATE))
        for blob, i in ranks.items():
            blobs[i] = blob
        self.byte_lengths = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.bytes = np.frombuffer(b"".join(blobs), np.uint8)

    def ids_of(self, text: str) -> np.ndarray:
        """Ids of a part."""
        return self.encoding.encode_to_numpy(escape(text), disallowed_special=())

    def assembled(self, roles: list[str], texts: list[str], trained: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of turns end to end, the loss mask (one on the text of turns whose role is ``trained``), and each turn's number of ids."""
        known = {r: self.ids_of(r) for r in set(roles)}
        parts = [y for r, t in zip(roles, texts, strict=True) for y in (known[r], self.ids_of(t))]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, 2)
        counts = sizes.sum(1) + 4
        begins = np.cumsum(counts) - counts
        total = int(counts.sum())
        ids = np.empty(total, np.int32)
        free = np.ones(total, bool)
        text_begins = begins + 3 + sizes[:, 0]
        for at, mark in ((begins, self.open), (begins + 1, self.role), (text_begins - 1, self.text), (text_begins + sizes[:, 1], self.close)):
            ids[at] = mark
            free[at] = False
        ids[free] = np.concatenate(parts)
        edges = np.zeros(total + 1, np.int32)
        learned = np.fromiter((r == trained for r in roles), bool, len(roles))
        np.add.at(edges, text_begins[learned], 1)
        np.add.at(edges, (text_begins + sizes[:, 1])[learned], -1)
        return ids, np.cumsum(edges[:-1]).astype(np.int8), counts

    def decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids in one string, and where each id's begin and the last one's end."""
        lengths = self.byte_lengths[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.byte_starts[ids] - ends[:-1], lengths)].tobytes(), ends

    def turns(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, bool, int]]:
        """(role, text, under the mask, formatted characters) of each turn, read back from ids."""
        begins, cuts = np.flatnonzero(ids == self.open), np.flatnonzero(ids == self.text)
        ends = np.append(begins[1:], len(ids)) - 1
        if len(cuts) != len(begins) or (cuts <= begins).any() or (cuts >= ends).any() or (ids[begins + 1] != self.role).any() or (ids[ends] != self.close).any():
            raise ValueError("a turn isn't framed by reserved ids")
        covered = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        inside, around = covered[ends] - covered[cuts + 1], covered[ends + 1] - covered[begins]
        if (around != inside).any() or ((inside != 0) & (inside != ends - cuts - 1)).any():
            raise ValueError("a mask doesn't end at a part's borders")
        data, at = self.decoded(ids)
        frame = sum(map(len, TEMPLATE))
        known: dict[bytes, str] = {}
        for a, b, c, d, under in zip(at[begins + 2].tolist(), at[cuts].tolist(), at[cuts + 1].tolist(), at[ends].tolist(), (inside > 0).tolist(), strict=True):
            blob, text = data[a:b], data[c:d].decode()
            role = known.get(blob)
            if role is None:
                role = known[blob] = blob.decode()
            yield unescape(role), unescape(text), under, len(role) + len(text) + frame

    def formatted(self, ids: np.ndarray) -> str:
        """The formatted text of ids."""
        names = {v: k for k, v in self.reserved.items()}
        out, run = [], []
        for i in ids.tolist():
            if i in names:
                out += [self.encoding.decode_bytes(run).decode(), names[i]]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.encoding.decode_bytes(run).decode()])


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_IDS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of blocks with about ``most`` ids (one row at least), their ids and their masks end to end."""
    for batch in batches:
        sizes = np.cumsum(batch.column("token_ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")), at + 1)
            part = batch.slice(at, end - at)
            yield part, part.column("token_ids").flatten().to_numpy(), part.column("loss_mask").flatten().to_numpy()
            at = end


@lru_cache(2)
def _assembler(ranks_path: str, pattern: str) -> Assembler:
    return Assembler(ranks_path, pattern)


def format_turns(turns: DataFrame, ranks_path: str, pattern: str, trained: str = "assistant", block_turns: int = BLOCK_TURNS, block_chars: int = BLOCK_CHARS,
                 conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, block (orders a conversation's blocks), n_turns, token_ids and loss_mask of every block.

    ``ranks_path`` is a ``.tiktoken`` file on every machine, ``pattern`` its pre-token pattern.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _assembler(ranks_path, pattern)
        number = TaskContext.get().partitionId() << 32  # ranges are numbered in order
        held: list[tuple] = []
        starts: list[int] = []  # where each block held begins
        chars = own = 0  # characters held, and those of the last block

        def flush() -> pa.RecordBatch:
            """The blocks held: one call assembles them all."""
            nonlocal number, chars
            ids, mask, counts = made.assembled([x[1] for x in held], [x[2] for x in held], trained)
            sizes = np.add.reduceat(counts, starts)
            out = pa.RecordBatch.from_arrays(
                [pa.array([held[k][0] for k in starts], pa.int64()), pa.array(range(number, number + len(starts)), pa.int64()), pa.array(np.diff([*starts, len(held)])),
                 list_array(ids, sizes, pa.int32()), list_array(mask, sizes, pa.int8())],
                ["conv_id", "block", "n_turns", "token_ids", "loss_mask"])
            number, chars = number + len(starts), 0
            held.clear()
            starts.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not held or held[-1][0] != row[0] or len(held) - starts[-1] >= block_turns or own >= block_chars:
                    if chars >= SLICE_CHARS:
                        yield flush()
                    starts.append(len(held))
                    own = 0
                held.append(row)
                own += len(row[2])
                chars += len(row[1]) + len(row[2])
        if held:
            yield flush()

    return dealt.mapInArrow(run, "conv_id long, block long, n_turns long, token_ids array<int>, loss_mask array<tinyint>")


def read_turns(blocks: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """conv_id, block, place, role, text, learned and formatted_chars of every turn, from ids and masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _assembler(ranks_path, pattern)
        for part, ids, mask in _slices(batches):
            found = list(made.turns(ids, mask))
            counts = part.column("n_turns").to_numpy()
            owner = pa.array(np.repeat(np.arange(part.num_rows), counts))
            place = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id").take(owner), part.column("block").take(owner), pa.array(place, pa.int32()),
                 *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64())))],
                ["conv_id", "block", "place", "role", "text", "learned", "formatted_chars"])

    return blocks.mapInArrow(run, "conv_id long, block long, place int, role string, text string, learned boolean, formatted_chars long")


def conversation_digests(blocks: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per conversation: turns, characters and digests of what its blocks hold, read in order.

    A digest is sequential, the one reason why a conversation's blocks meet in one task; they stream through
    it in sorted order, and a slice of them at a time is held.
    """
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _assembler(ranks_path, pattern)
        started, conv, n, loss, chars = False, None, 0, 0, 0
        whole, learned = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names)
            done.clear()
            return out

        for part, ids, mask in _slices(batches):
            turns = made.turns(ids, mask)
            for now, count in zip(part.column("conv_id").to_pylist(), part.column("n_turns").to_pylist(), strict=True):
                if started and now != conv:
                    done.append((conv, n, whole.hexdigest(), loss, learned.hexdigest(), chars))
                if not started or now != conv:
                    started, conv, n, loss, chars = True, now, 0, 0, 0
                    whole, learned = hashlib.sha256(), hashlib.sha256()
                for role, text, under, size in islice(turns, count):
                    whole.update(f"{role}\n{text}\n".encode())
                    n, chars = n + 1, chars + size
                    if under:
                        learned.update(text.encode())
                        loss += len(text)
            if next(turns, None) is not None:
                raise ValueError("a block holds more turns than it says")
            if done:
                yield rows()
        if started:
            done.append((conv, n, whole.hexdigest(), loss, learned.hexdigest(), chars))
            yield rows()

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
