"""Where blocks of braces end: all declarations of a batch of texts at once, over arrays of code points.

Quoted text is passed over from a block's opening brace on, so a quote in a comment before it doesn't count. Each step takes every open block to its next
quote: whether its depth falls to zero before is one search in the braces sorted by depth, and where the quoted text ends is one search
in the quotes of its kind that aren't escaped.
"""

from __future__ import annotations

import numpy as np

_QUOTES = [ord(c) for c in "\"'`"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points end to end, a 0 after each, and where each text begins (and the last one ends)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def block_ends(points: np.ndarray, braces_at: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The end of each block that opens at ``braces_at``, in a text that ends at its ``limits``; where it stays open or a quote isn't closed, that limit."""
    braces = np.flatnonzero((points == 0x7B) | (points == 0x7D))
    depth = np.zeros(len(braces) + 1, np.int64)
    np.cumsum(np.where(points[braces] == 0x7B, 1, -1), out=depth[1:])
    lowest, width = depth.min(initial=0), len(braces) + 1
    by_depth = np.sort((depth[1:] - lowest) * width + np.arange(len(braces)))
    quotes = np.flatnonzero(np.isin(points, _QUOTES))
    plain = np.maximum.accumulate(np.where(points != 0x5C, np.arange(len(points)), -1)) if len(points) else np.zeros(0, np.int64)
    free = (quotes - 1 - np.where(quotes > 0, plain[quotes - 1], -1)) % 2 == 0  # an even number of backslashes before
    closing = np.full(len(quotes) + 1, len(points))
    for kind in _QUOTES:
        own = points[quotes] == kind
        ends = np.append(quotes[own & free], len(points))
        closing[:-1][own] = ends[np.searchsorted(ends[:-1], quotes[own], "right")]
    quotes = np.append(quotes, len(points))

    out, at, level, live = limits.copy(), braces_at.copy(), np.zeros(len(limits), np.int64), np.arange(len(limits))
    while len(live):
        here, limit = at[live], limits[live]
        quote = np.searchsorted(quotes, here)
        until = np.minimum(quotes[quote], limit)
        first, last = np.searchsorted(braces, here), np.searchsorted(braces, until)
        wanted = depth[first] - level[live]
        found = np.searchsorted(by_depth, (wanted - lowest) * width + first)
        key = np.append(by_depth, -1)[found]
        brace = np.append(braces, len(points))[np.where((wanted >= lowest) & (key // width == wanted - lowest) & (key >= 0), key % width, len(braces))]
        done = brace < until
        out[live[done]] = brace[done] + 1
        level[live] += depth[last] - depth[first]
        at[live] = closing[quote] + 1
        live = live[~done & (until < limit) & (closing[quote] < limit)]
    return out
