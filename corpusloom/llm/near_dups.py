"""Near-duplicate groups by one-permutation MinHash with exact confirmation.

1. Each text becomes its set of hashed word shingles. One permutation splits the hash range
   into bins; a bin's sketch is its smallest hash. Empty bins borrow from a bin that a
   hash of (bin, attempt) picks until one is filled (optimal densification).
2. Texts with the same set are one class from here on.
3. Bands of sketches are bucket keys. In each bucket one class is the centre, and
   candidate edges form a star around it, so a bucket of k classes gives k - 1 pairs.
4. Candidates are confirmed on whole sets; confirmed links are contracted to components.
5. Buckets that still hold several components are searched whole, without a cap: their classes are dealt into
   blocks, and every two blocks of different components meet in a task that multiplies
   the sets' common columns and returns a forest of links, never pairs. After it no bucket holds a link
   that isn't in the components, so nothing is left to repeat.

A pair at similarity s shares a bucket with probability 1 - (1 - s^ROWS)^BANDS: at 0.85
a pair is missed once in 80,000, and pairs above it less often. Lower thresholds get wider
banding (``banding``): at 0.80 a pair is missed less than once in 1,000,000.

Defined results: words are split and A-Z lower-cased as the contract of the query says; a
text with fewer words than a shingle is one shingle; a null text or one without words has an
empty set, its component is its own id and it is kept; rows without an id have a null component and
are kept; rows that share an id are one document with all their sets (a link of one is a link of
all), and each row is returned; extra columns don't matter; an empty table gives an empty result. Texts
are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, list_array, mix, sized, slices, unused, word_hashes, written

SHINGLE = 5
BANDS, ROWS = 24, 6
BINS = BANDS * ROWS
#: Weight of a block of sets (elements, and so many more for each set): two blocks fit a task in some tens of MB.
BLOCK_WEIGHT, CLASS_WEIGHT = 1 << 19, 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


# ---------------------------------------------------------------- sets and sketches
def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and the size of each set."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - bounds[:-1][owner]
    size = np.minimum(counts, width)  # a short text is one shingle of all its words
    heads = np.flatnonzero(place <= (counts - size)[owner])
    h = size[owner[heads]].astype(np.uint64)
    for k in range(width):
        some = k < size[owner[heads]]
        if some.all():
            h = mix(h + words[heads + k] * _ODD[k % len(_ODD)])
        else:
            h[some] = mix(h[some] + words[heads[some] + k] * _ODD[k % len(_ODD)])
    owner = owner[heads]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)


def sketches(sets: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation sketches with optimal densification: a row of ``bins`` minima per set."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(sets ^ np.uint64(0x2545F4914F6CDD1D))
    cell = owner * bins + ((spread >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    out = np.full(len(sizes) * bins, np.iinfo(np.uint64).max, np.uint64)
    order = np.lexsort((spread, cell))
    cell, spread = cell[order], spread[order]
    head = np.ones(len(cell), bool)
    head[1:] = cell[1:] != cell[:-1]
    out[cell[head]] = spread[head]
    out = out.reshape(len(sizes), bins)
    filled = np.zeros(len(sizes) * bins, bool)
    filled[cell[head]] = True
    filled = filled.reshape(len(sizes), bins)
    rows, cols = np.nonzero(~filled & (sizes > 0)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        picked = (mix(cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        good = filled[rows, picked]
        out[rows[good], cols[good]] = out[rows[good], picked[good]]
        rows, cols = rows[~good], cols[~good]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows for a threshold: at it a pair is missed once in 80,000 at most."""
    if percent >= 85:
        return BANDS, ROWS
    rows = 5 if percent >= 80 else 3
    share = max(percent, 1) / 100
    return max(36, int(np.ceil(np.log(1 / 80_000) / np.log1p(-(share**rows))))), rows


def set_marks(sets: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each whole set, as signed integers."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(seed)))])
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def sketch_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (128 bits of the set) and bands (array<long>; null for empty sets)."""
    number, rows_each = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            sets, sizes = shingle_sets(part.column(text), width)
            keys = band_keys(sketches(sets, sizes, number * rows_each), number, rows_each)
            marks = [set_marks(sets, sizes, c) for c in (1, 2)]
            bands = list_array(keys.reshape(-1), np.full(len(sizes), number), pa.int64())
            empty = pa.array(sizes == 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(marks[0]), pa.array(marks[1]), pc.if_else(empty, pa.scalar(None, bands.type), bands)],
                ["doc_id", "n_shingles", "s1", "s2", "bands"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text))
    return rows.mapInArrow(lean(run), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _sets_of(docs: DataFrame, text: str, width: int) -> DataFrame:
    """doc_id, s1 and the set as array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            sets, sizes = shingle_sets(part.column(text), width)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(set_marks(sets, sizes, 1)), list_array(sets.view(np.int64), sizes, pa.int64())], ["doc_id", "s1", "set"])

    return docs.select("doc_id", text).mapInArrow(lean(run), "doc_id long, s1 long, set array<long>")


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(v, c) with the smallest vertex of each vertex's component, for edges (a, b) of longs.

    Labels spread along edges and are followed one step per round, so a path of n
    edges takes about log n rounds. Each round is written, which cuts lineage.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("c")), "cc-labels")
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("m"))
        spread = labels.join(heard, labels["v"] == heard["a"]).select("v", F.least("c", "m").alias("n"), F.col("c").alias("was"))
        of = labels.select(F.col("v").alias("w"), F.col("c").alias("cw"))
        nxt = written(spread.join(of, spread["n"] == of["w"], "left").select("v", F.least("n", F.coalesce("cw", "n")).alias("c"), "was"), "cc-labels")
        forget(labels)
        labels = nxt
        if not nxt.filter("c <> was").limit(1).count():
            forget(both)
            out = nxt.drop("was")
            out.scratch_path = nxt.scratch_path
            return out


def extended(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Labels (v, c) after links ``fresh`` (a, b) were added: only components that a link joins are labelled anew."""
    if labels is None:
        return components(fresh)
    ends = fresh.select(F.col("a").alias("v")).unionByName(fresh.select(F.col("b").alias("v"))).distinct()
    known = written(ends.join(labels, "v", "full_outer").select("v", F.coalesce("c", "v").alias("c")), "cc-known")
    one, two = known.select(F.col("v").alias("a"), F.col("c").alias("ca")), known.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    joined = fresh.join(one, "a").join(two, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    found = components(joined)
    into = found.select(F.col("v").alias("c"), F.col("c").alias("root"))
    out = written(known.join(into, "c", "left").select("v", F.coalesce("root", "c").alias("c")), "cc-labels")
    forget(labels, known, found)
    return out


# ---------------------------------------------------------------- linking
def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b").distinct()


def linked_in_block(reps: np.ndarray, parts: np.ndarray, values: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of different ``parts``: of all that there are, as many as connect the same sets.

    ``values`` holds the sets end to end. Only elements that two sets share can count; their
    columns are multiplied a chunk at a time, so memory is the square of the number of sets.
    """
    m = len(sizes)
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    common = times > 1
    column = (np.cumsum(common) - 1)[at]
    used = common[at]
    owner, column = owner[used], column[used]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((m, m), np.float32)
    total, step = int(common.sum()), max(64, (4 << 20) // max(m, 1))
    for first in range(0, total, step):
        lo, hi = np.searchsorted(column, [first, first + step])
        held = np.zeros((m, min(step, total - first)), np.float32)
        held[owner[lo:hi], column[lo:hi] - first] = 1
        shared += held @ held.T
    both = shared.astype(np.float64)
    linked = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (parts[:, None] != parts[None, :])
    left, right = [], []
    unseen = linked.any(1)
    for start in np.flatnonzero(unseen).tolist():  # a walk over each connected group gives its tree
        if not unseen[start]:
            continue
        unseen[start] = False
        ahead = [start]
        while ahead:
            k = ahead.pop()
            new = np.flatnonzero(linked[k] & unseen)
            unseen[new] = False
            left += [k] * len(new)
            right += new.tolist()
            ahead += new.tolist()
    return reps[np.array(left, np.int64)], reps[np.array(right, np.int64)]


def _rest(mixed: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Links (a, b) between components that share a bucket. ``mixed``: key, rep, n and component c.

    A bucket's classes are dealt into blocks of about ``most`` weight (elements and
    ``CLASS_WEIGHT`` for each class): a large component has blocks of its own, the others share
    some. Every two blocks that don't belong to one component meet in a task, which holds
    two blocks and returns a forest of links, however large the bucket is.
    """
    weight = F.col("n") + CLASS_WEIGHT
    parts = mixed.groupBy("key", "c").agg(F.sum(weight).alias("w")).withColumn("own", F.col("w") >= most)
    parts = parts.withColumn("g", F.when(F.col("own"), F.col("c")).otherwise(F.lit(0).cast("long")))
    room = parts.groupBy("key", "own", "g").agg(F.ceil(F.sum("w") / most).cast("int").alias("blocks"))
    parts = parts.select("key", "c", "own", "g")
    room = written(room, "nd-room")
    several = room.groupBy("key").agg(F.sum("blocks").alias("all")).filter("all > 1").select("key")
    blocks = room.join(several, "key").select("key", "own", "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"))
    one = blocks.select("key", F.struct("own", "g", "p").alias("x"))
    meet = one.join(one.withColumnRenamed("x", "y"), "key").filter("x <= y AND NOT (x.own AND y.own AND x.g = y.g)")
    meet = meet.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("z")).select("key", "x", "y", "z.own", "z.g", "z.p")
    place = mixed.join(parts, ["key", "c"]).join(room, ["key", "own", "g"]).withColumn("p", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    alone = F.struct(F.lit(False).alias("own"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("p"))
    single = place.join(several, "key", "left_anti").select("key", alone.alias("x"), alone.alias("y"), "rep", "c")
    more = place.join(meet, ["key", "own", "g", "p"]).select("key", "x", "y", "rep", "c")
    held = single.unionByName(more).join(sets.select(F.col("doc_id").alias("rep"), "set"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        lists = table.column("set").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = linked_in_block(table.column("rep").to_numpy(), table.column("c").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False), sizes, percent)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return held.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def link(classes: DataFrame, docs: DataFrame, text: str, percent: int, width: int, block: int = BLOCK_WEIGHT) -> DataFrame:
    """(v, c): the component of every class that is linked to another. ``classes``: rep, n, bands."""
    members = classes.select("rep", "n", F.explode("bands").alias("key"))
    # the centre of a bucket is the class with the largest hash: groups that meet in many buckets mostly get one
    top = F.max(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("rep0"), F.col("n").alias("n0")))
    crowded = sized(members.groupBy("key").agg(F.count("*").alias("k"), top.alias("top")).filter("k > 1").select("key", "k", "top.rep0", "top.n0"), "nd-crowded")
    members = written(members.join(crowded, "key"), "nd-buckets")
    wanted = sized(members.select(F.col("rep").alias("doc_id")).distinct(), "nd-wanted")
    sets = written(_sets_of(docs.join(wanted, "doc_id", "left_semi"), text, width).dropDuplicates(["doc_id", "s1"]).drop("s1"), "nd-sets")

    fits = 100 * F.least("n", "n0") >= percent * F.greatest("n", "n0")  # sizes alone don't rule it out
    star = members.filter((F.col("rep") != F.col("rep0")) & fits)
    pairs = star.select(F.least("rep", "rep0").alias("a"), F.greatest("rep", "rep0").alias("b")).distinct()
    links = written(_confirmed(pairs, sets, percent), "nd-links")
    labels = components(links) if links.limit(1).count() else None

    # buckets of more than a star that still hold several components; of equal buckets one
    large = members.filter("k > 2").select("key", "rep", "n")
    if labels is None:
        large = large.withColumn("c", F.col("rep"))
    else:
        large = large.join(labels, large["rep"] == labels["v"], "left").select("key", "rep", "n", F.coalesce("c", "rep").alias("c"))
    large = written(large, "nd-large")
    same = large.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("rep")).alias("h1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("h2"))
    open_keys = sized(same.filter("lo <> hi").groupBy("k", "h1", "h2").agg(F.min("key").alias("key")).select("key"), "nd-open")
    more = written(_rest(written(large.join(open_keys, "key", "left_semi"), "nd-mixed"), sets, percent, block), "nd-links")
    if more.limit(1).count():
        labels = extended(labels, more)
    return labels if labels is not None else classes.select(F.col("rep").alias("v"), F.col("rep").alias("c")).limit(0)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept of every row."""
    sketched = written(sketch_documents(df, doc_id, text, width, percent), "nd-sketches")
    # one class per distinct set; its representative is the smallest id
    full = sketched.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(full.groupBy("s1", "s2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nd-classes")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias(text))
    labels = link(classes, docs, text, percent, width)
    roots = classes.join(labels, classes["rep"] == labels["v"], "left").select(
        "s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("c", "rep").alias("root"))
    return (
        sketched.drop("bands").join(roots, ["s1", "s2", "n_shingles"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def keep_one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``df`` that ``near_duplicates`` keeps, with all their columns; of rows that share both id and text one stays."""
    own, = unused(df.columns, "kept_id")
    found = near_duplicates(df, doc_id, text, percent).filter("doc_id IS NOT NULL")
    found = written(found.groupBy(F.col("doc_id").alias(own)).agg(F.bool_and("kept").alias("stays"), F.count("*").alias("times")), "nd-found")
    same = F.col(doc_id).cast("long") == F.col(own)
    gone = sized(found.filter("NOT stays").select(own), "nd-gone")
    out = df.join(gone, same, "left_anti")
    again = found.filter("stays AND times > 1").select(own)
    if again.limit(1).count():
        again = sized(again, "nd-again")
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([doc_id, text]))
    return out
