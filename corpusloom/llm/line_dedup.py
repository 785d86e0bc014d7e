"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

State is two tables in a folder that all machines share:

* ``counts``: for each 128-bit key of a line, in how many documents it occurs. Adding
  documents adds to it, deleting documents takes away; keys at zero go. It is exact.
* ``filters``: for each shard of the key space a cuckoo filter with the keys that reach
  the threshold. A filter takes insertions and deletions, so a batch of documents only
  touches the keys that cross the threshold, one way or the other.

A line is dropped if its shard's filter knows it and the exact table confirms it, at every
size: keys meet filters first, and only those that a filter passes are shuffled to the exact table.

Defined results: a null or empty text is one empty line and stays empty; every row is a
document of its own, so repeated rows (and rows that share an id, or have none) count one each; extra
columns are kept by ``drop_lines``; an empty table gives an empty result. Texts
are never cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, mix, slices, unused, written

#: Keys of frequent lines that one shard's filter is sized for.
SHARD_KEYS = 1 << 18
#: Filters go to every task in groups of at most this many bytes (some 14 million keys).
BROADCAST_BYTES = 32 << 20
_SLOTS = 4
_KICKS = 500


# ---------------------------------------------------------------- keys
def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def key_hashes(lines: list[bytes]) -> np.ndarray:
    """128-bit hashes of keys, as rows of two signed 64-bit integers."""
    blob = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in lines)
    return np.frombuffer(blob, "<i8").reshape(-1, 2)


def _distinct_keys(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct keys, and how many each text has."""
    out: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = {x.strip(WHITE) for x in text.lower().split(b"\n")}
        own = [x for x in own if len(x) >= least and (least < 2 or len(x.decode()) >= least)]
        counts[k] = len(own)
        out += own
    return key_hashes(out), counts


def line_keys(df: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """One row (h1, h2) for every distinct key of at least ``least`` code points of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            hashes, _ = _distinct_keys(part.column(text).fill_null("").cast(pa.binary()).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], ["h1", "h2"])

    return df.select(text).mapInArrow(run, "h1 long, h2 long")


# ---------------------------------------------------------------- cuckoo filter
class CuckooFilter:
    """A cuckoo filter of 16-bit fingerprints in buckets of four, with partial-key hashing."""

    def __init__(self, buckets: int, table: bytes | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, _SLOTS).copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, math.ceil(math.log2(max(keys, 1) / (_SLOTS * 0.85)))))

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            mark = (mix(h2.astype(np.uint64)) >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        first = h1.astype(np.uint64).astype(np.int64) & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray | int, mark: np.ndarray | int):
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Add keys, one entry each; a full filter doubles the caller's size by raising ``OverflowError``.

        Keys go to free slots of their first and then their second bucket all at once; only the
        others push entries on, one after the other.
        """
        marks, *places = self._places(h1, h2)
        left = np.arange(len(marks))
        for place in places:
            order = left[np.argsort(place[left], kind="stable")]
            bucket = place[order]
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            turn = np.arange(len(bucket)) - np.repeat(heads, np.diff(np.append(heads, len(bucket))))
            full = self.table[bucket] != 0
            fits = turn < _SLOTS - full.sum(1)
            slots = np.argsort(full, axis=1, kind="stable")  # free ones first
            self.table[bucket[fits], slots[fits, turn[fits]]] = marks[order[fits]]
            left = order[~fits]
        for mark, at in zip(marks[left].tolist(), places[1][left].tolist(), strict=True):
            for kick in range(_KICKS):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    break
                slot = kick % _SLOTS
                mark, self.table[at, slot] = int(self.table[at, slot]), mark
                at = self._other(at, mark)
            else:
                raise OverflowError("cuckoo filter is full")

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out one entry of each key that was inserted before."""
        marks, firsts, seconds = (x.tolist() for x in self._places(h1, h2))
        for mark, a, b in zip(marks, firsts, seconds, strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == mark)
                if len(found):
                    self.table[at, found[0]] = 0
                    break

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """No inserted key is missed; about one other key in ten thousand is let through."""
        marks, firsts, seconds = self._places(h1, h2)
        marks = marks[:, None].astype(np.uint16)
        return (self.table[firsts] == marks).any(1) | (self.table[seconds] == marks).any(1)


# ---------------------------------------------------------------- state
class LineIndex:
    """Reference counts of line keys, with cuckoo filters over the frequent ones.

    The object holds DataFrames only; ``add`` and ``remove`` give a new index, the
    old one stays valid.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, min_docs: int, min_chars: int, shards: int):
        self.counts, self.filters = counts, filters
        self.min_docs, self.min_chars, self.shards = min_docs, min_chars, shards

    @classmethod
    def build(cls, docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, shards: int | None = None) -> LineIndex:
        """An index over ``docs``; the number of shards follows the number of frequent keys."""
        counts = written(_grouped(line_keys(docs, text, min_chars).withColumn("refs", F.lit(1).cast("long"))), "line-counts")
        frequent = counts.filter(F.col("refs") >= min_docs)
        if shards is None:
            shards = 1 << max(0, math.ceil(math.log2(max(frequent.count(), 1) / SHARD_KEYS)))
        return cls(counts, written(_filters(frequent, shards), "line-filters"), min_docs, min_chars, shards)

    def add(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(docs, text, 1)

    def remove(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take documents out again that were added before, with the texts they had then."""
        return self._changed(docs, text, -1)

    def _changed(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        change = _grouped(line_keys(docs, text, self.min_chars).withColumn("refs", F.lit(sign).cast("long"))).withColumnRenamed("refs", "change")
        both = self.counts.join(change, ["h1", "h2"], "full_outer").select(
            "h1", "h2", F.coalesce("refs", F.lit(0)).alias("was"), (F.coalesce("refs", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("refs"))
        both = written(both, "line-change")
        wrong = both.filter("refs < 0").limit(1).count()
        if wrong:
            raise ValueError("documents were removed that had not been added")
        counts = both.filter("refs > 0").select("h1", "h2", "refs")
        crossed = both.filter((F.col("was") >= self.min_docs) != (F.col("refs") >= self.min_docs)).select(
            "h1", "h2", (F.col("refs") >= self.min_docs).alias("enters"))
        frequent = counts.filter(F.col("refs") >= self.min_docs).select("h1", "h2")
        return LineIndex(counts, written(_updated(self.filters, crossed, frequent, self.shards), "line-filters"), self.min_docs, self.min_chars, self.shards)

    def frequent(self) -> DataFrame:
        """The keys that lose their lines."""
        return self.counts.filter(F.col("refs") >= self.min_docs).select("h1", "h2")


def _grouped(keys: DataFrame) -> DataFrame:
    return keys.groupBy("h1", "h2").agg(F.sum("refs").alias("refs"))


def _shard(shards: int):
    return F.pmod(F.shiftright("h1", 40), F.lit(shards)).cast("int")


_FILTER = "shard int, buckets long, entries long, table binary"


def _filters(frequent: DataFrame, shards: int) -> DataFrame:
    """One filter row for each shard that has frequent keys; a shard's keys are bounded by its share."""

    def build(key, table):
        h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
        return _row(key[0].as_py(), _filled(h1, h2), len(h1))

    return frequent.select(_shard(shards).alias("shard"), "h1", "h2").groupBy("shard").applyInArrow(build, _FILTER)


def _filled(h1: np.ndarray, h2: np.ndarray, room: int = 0) -> CuckooFilter:
    made = CuckooFilter.sized(max(len(h1), room))
    while True:
        try:
            made.insert(h1, h2)
            return made
        except OverflowError:
            made = CuckooFilter(made.buckets * 2)


def _row(shard: int, made: CuckooFilter, entries: int) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": [made.buckets], "entries": [entries], "table": pa.array([made.table.tobytes()], pa.binary())})


def _updated(filters: DataFrame, crossed: DataFrame, frequent: DataFrame, shards: int) -> DataFrame:
    """Filters after keys entered or left; a shard that no key crosses is passed on, one that overflows is built anew."""

    def change(key, table, keys):
        shard = key[0].as_py()
        part = lambda kind: [keys.filter(pc.equal(keys.column("kind"), kind)).column(c).to_numpy() for c in ("h1", "h2")]
        entering, leaving, all_keys = part(1), part(-1), part(0)
        if table.num_rows:
            made = CuckooFilter(table.column("buckets")[0].as_py(), table.column("table")[0].as_py())
            try:
                made.delete(*leaving)
                made.insert(*entering)
                return _row(shard, made, len(all_keys[0]))
            except OverflowError:
                pass
        return _row(shard, _filled(*all_keys), len(all_keys[0]))

    keys = crossed.select(_shard(shards).alias("shard"), "h1", "h2", F.when(F.col("enters"), 1).otherwise(-1).alias("kind"))
    touched = keys.select("shard").distinct()
    keys = keys.unionByName(frequent.select(_shard(shards).alias("shard"), "h1", "h2", F.lit(0).alias("kind")).join(touched, "shard", "left_semi"))
    same = filters.join(touched, "shard", "left_anti")
    return same.unionByName(filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(change, _FILTER))


# ---------------------------------------------------------------- dropping
class Probe:
    """Filters of some shards, and keys that they know wrongly, as a task holds them."""

    def __init__(self, filters: list[tuple[int, int, bytes]], shards: int, wrong: np.ndarray | None = None):
        self.shards = shards
        self.filters = {s: CuckooFilter(b, t) for s, b, t in filters}
        self.wrong = set() if wrong is None else {x.tobytes() for x in wrong}

    def flags(self, hashes: np.ndarray) -> np.ndarray:
        """Which keys the filters know, without those they are known to know wrongly."""
        out = np.zeros(len(hashes), bool)
        shard = (hashes[:, 0] >> 40) % self.shards
        for s, one in self.filters.items():
            at = np.flatnonzero(shard == s)
            out[at] = one.contains(hashes[at, 0], hashes[at, 1])
        if self.wrong:
            for k in np.flatnonzero(out):
                out[k] = hashes[k].tobytes() not in self.wrong
        return out


def _cleaned(texts: list[bytes], dropped, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts without the lines whose keys ``dropped(hashes, owners)`` flags, and line counts."""
    lines = [x.split(b"\n") for x in texts]
    total = np.fromiter(map(len, lines), np.int64, len(lines))
    owners = np.repeat(np.arange(len(lines)), total)
    keys = [line_key(x) for own in lines for x in own]
    counted = np.fromiter((len(x) >= least and (least < 2 or len(x.decode()) >= least) for x in keys), bool, len(keys))
    flags = np.zeros(len(keys), bool)
    at = np.flatnonzero(counted)
    if len(at):
        flags[at] = dropped(key_hashes([keys[k] for k in at]), owners[at])
    gone = np.bincount(owners[flags], minlength=len(lines)) if len(lines) else np.zeros(0, np.int64)
    starts = np.cumsum(total) - total
    out = []
    for k, own in enumerate(lines):
        if gone[k]:
            keep = ~flags[starts[k] : starts[k] + total[k]]
            own = [x for x, y in zip(own, keep.tolist(), strict=True) if y]
            out.append(b"\n".join(own).decode())
        else:
            out.append(texts[k].decode())
    return out, total, gone.astype(np.int64)


def _groups(index: LineIndex, most: int) -> list[list[int]]:
    """Shards in groups whose filters take about ``most`` bytes together (one shard at least)."""
    out: list[list[int]] = [[]]
    room = most
    for r in index.filters.select("shard", "buckets").orderBy("shard").collect():
        if out[-1] and r["buckets"] * 2 * _SLOTS > room:
            out.append([])
            room = most
        out[-1].append(r["shard"])
        room -= r["buckets"] * 2 * _SLOTS
    return out


def _sent(index: LineIndex, shards: list[int], wrong: np.ndarray | None = None):
    """The filters of some shards, broadcast."""
    rows = index.filters.filter(F.col("shard").isin(*shards)).collect() if shards else []
    return index.counts.sparkSession.sparkContext.broadcast(([(r["shard"], r["buckets"], bytes(r["table"])) for r in rows], index.shards, wrong))


def drop_lines(df: DataFrame, index: LineIndex, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
               n_lines: str = "__n_lines", n_dropped: str = "__n_dropped") -> DataFrame:
    """``df`` with frequent lines taken out of ``text``, and ``n_lines``, ``n_dropped`` (long) besides.

    Rows keep all other columns; columns of the two names are replaced. The filters decide which keys may go and
    the exact table confirms those keys alone: nothing else of a document's lines is shuffled. Filters
    are sent in groups of at most ``broadcast_bytes``. If there is one group, documents are probed as they are read,
    and a second scan drops lines by the filters and the few keys that they know wrongly. If there are more, keys are written once, dealt
    by group, each group's keys meet its filters only, and confirmed keys come back to their rows by a number.
    """
    least, kept = index.min_chars, [f for f in df.schema.fields if f.name not in (n_lines, n_dropped)]
    schema = T.StructType([*kept, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    names = [f.name for f in kept]
    groups = _groups(index, broadcast_bytes)
    confirmed = index.frequent()

    def rebuilt(part: pa.RecordBatch, dropped) -> pa.RecordBatch:
        texts, total, gone = _cleaned(part.column(text).fill_null("").cast(pa.binary()).to_pylist(), dropped, least)
        columns = [pa.array(texts, pa.string()) if n == text else part.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(gone)], [*names, n_lines, n_dropped])

    if len(groups) == 1:
        probing = _sent(index, groups[0])

        def flagged_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = Probe(*probing.value)
            for part in slices(batches, text):
                hashes, _ = _distinct_keys(part.column(text).fill_null("").cast(pa.binary()).to_pylist(), least)
                hashes = np.unique(hashes[probe.flags(hashes)], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], ["h1", "h2"])

        flagged = df.select(text).mapInArrow(flagged_keys, "h1 long, h2 long").distinct()
        wrong = written(flagged.join(confirmed, ["h1", "h2"], "left_anti"), "line-wrong")
        if wrong.count() * 100 <= broadcast_bytes:
            shared = _sent(index, groups[0], np.array(wrong.toArrow().to_pandas().to_numpy(), np.int64).reshape(-1, 2))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                probe = Probe(*shared.value)
                for part in slices(batches, text):
                    yield rebuilt(part, lambda hashes, _: probe.flags(hashes))

            return df.select(*names).mapInArrow(run, schema)

    row, own_keys, group = unused(df.columns, "row", "keys", "shard_group")
    rows = written(df.select(*names).withColumn(row, F.monotonically_increasing_id()), "line-rows")
    group_of = np.zeros(index.shards, np.int32)
    for k, shards in enumerate(groups):
        group_of[shards] = k

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            hashes, counts = _distinct_keys(part.column(text).fill_null("").cast(pa.binary()).to_pylist(), least)
            held = group_of[(hashes[:, 0] >> 40) % index_shards]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(row).to_numpy(), counts)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(held)], [row, "h1", "h2", group])

    index_shards = index.shards
    dealt = written(rows.select(row, text).mapInArrow(keys, f"{row} long, h1 long, h2 long, {group} int"), "line-keys", group)
    flagged = None
    for k, shards in enumerate(groups):
        found = dealt.filter(F.col(group) == k).select(row, "h1", "h2").mapInArrow(_probing(_sent(index, shards)), f"{row} long, h1 long, h2 long")
        flagged = found if flagged is None else flagged.unionByName(found)
    flagged = flagged.join(confirmed, ["h1", "h2"], "left_semi").groupBy(row).agg(F.collect_list(F.struct("h1", "h2")).alias(own_keys))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            known = [None if x is None else {np.array([y["h1"], y["h2"]], "<i8").tobytes() for y in x} for x in part.column(own_keys).to_pylist()]
            yield rebuilt(part, lambda hashes, owners: np.fromiter(
                (bool(known[o]) and h.tobytes() in known[o] for h, o in zip(hashes, owners, strict=True)), bool, len(hashes)))

    return rows.join(flagged, row, "left").drop(row).mapInArrow(drop, schema)


def _probing(sent):
    """Of rows with keys (h1, h2) those that the filters of ``sent`` know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(*sent.value)
        for part in batches:
            yield part.filter(pa.array(probe.flags(np.stack([part.column(c).to_numpy() for c in ("h1", "h2")], 1))))

    return run


def keep_first_of_long(df: DataFrame, more_than: int = 50, doc_id: str = "doc_id", text: str = "text", n_dropped: str = "__n_dropped") -> DataFrame:
    """``df`` where a line of more than ``more_than`` words that several rows hold stays only where it is first, and ``n_dropped`` (long).

    First is the smallest id (rows without one come last) and place. Lines are compared by
    their keys; texts are only joined with the places of the lines they lose.
    """
    white = r"[\x20\x09-\x0D]+"
    number, gone_at = unused([*df.columns, n_dropped], "row", "gone")
    kept = [c for c in df.columns if c != n_dropped]
    rows = written(df.select(*kept).withColumn(number, F.monotonically_increasing_id()), "long-rows")
    lines = rows.select(F.col(number).alias("row"), F.col(doc_id).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    key = F.translate(F.regexp_replace("line", f"^{white}|{white}$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = lines.withColumn("line", key).filter(F.size(F.split("line", white)) > more_than)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    lines = written(lines.select(F.sha2("line", 256).alias("key"), place.alias("place")), "long-lines")
    first = lines.groupBy("key").agg(F.min("place").alias("first"), F.min("place.row").alias("lo"), F.max("place.row").alias("hi")).filter("lo <> hi")
    gone = lines.join(first, "key").filter("NOT place <=> first").groupBy(F.col("place.row").alias(number)).agg(F.collect_set("place.at").alias(gone_at))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, at: ~F.array_contains(gone_at, at)), "\n")
    out = rows.join(gone, number, "left").withColumn(n_dropped, F.greatest(F.coalesce(F.size(gone_at), F.lit(0)), F.lit(0)).cast("long"))
    out = out.withColumn(text, F.when(F.col(gone_at).isNotNull(), left).otherwise(F.col(text)))
    return out.select(*kept, n_dropped)
