"""Greedy packing of paragraphs: texts jump from end to end over sums of lengths, so a text's cost grows with its size."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PARAGRAPH, WHITE

_JOINT = "\n\n"
_KIND = pa.list_(pa.list_(pa.struct([("text", pa.string()), ("before", pa.int32())])))


def packed(text: str, room: int, overlap: int = 0, extra: int = 0) -> list[tuple[str, int]]:
    """(text, lines before it) of each pack; see ``packs``."""
    pieces = re.split(PARAGRAPH, text)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + len(_JOINT)) - len(_JOINT)
    joined = _JOINT.join(pieces)
    out, now, line, at = [], "", 0, 0
    while at < len(pieces):
        piece = pieces[at]
        if now and len(now) + len(piece) + extra > room:
            out.append((now, line))
            line += now.count("\n") + 2
            now = now[-overlap:] + _JOINT + piece if overlap else piece
        elif overlap and not now:
            now = piece  # the first piece keeps its leading white space where texts overlap
        else:
            now = (now + _JOINT + piece).lstrip(WHITE)
        at += 1
        if now and now[0] not in WHITE:  # nothing is taken off any more: all that fits is one slice
            fit = int(np.searchsorted(ends, room - extra + len(_JOINT) - len(now) + ends[at - 1], side="right"))
            if fit > at:
                now += joined[ends[at - 1] : ends[fit - 1]]
                at = fit
    return [*out, (now, line)] if now.strip(WHITE) else out


def packs(texts: Column, room: int, overlap: int = 0, joint_counts: bool = False) -> Column:
    """The paragraphs of each of ``texts`` (an array) packed greedily into texts of about ``room`` characters; a null gives a null.

    A text is closed when it isn't empty and the next paragraph would lift it over ``room`` (with ``joint_counts`` the blank line counts, too). The next
    one begins with the last ``overlap`` characters of the closed one. Paragraphs longer than ``room`` stay whole. Entries are (text, before): the text, and
    how many lines lie before it when every closed text is followed by a blank line.
    """
    extra = len(_JOINT) if joint_counts else 0

    def run(batch: pa.Array) -> pa.Array:
        made = [None if own is None else [None if t is None else [{"text": x, "before": n} for x, n in packed(t, room, overlap, extra)] for t in own] for own in batch.to_pylist()]
        return pa.array(made, _KIND)

    return F.arrow_udf(run, "array<array<struct<text:string,before:int>>>")(texts)
