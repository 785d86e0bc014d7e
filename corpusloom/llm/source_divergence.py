"""How far the sources of a language differ: a round-robin tournament between their term vectors.

A group is a (lang, source); its vector holds a smoothed share of each kept term. Terms are dealt into shards
of about ``TERMS`` by a hash, and the groups of a language into blocks of about ``GROUPS``, so a vector comes in pieces
of bounded size and a task holds one block of them. The blocks of a shard stay where they are while compressed pieces
circulate: in round r the blocks i and j = r - i (modulo their number) meet, in one of the two places, so after as many rounds as blocks
every two have met once. A meeting gives each pair's part of the distance for both directions; parts are
summed over shards. While pieces are made, a heap per piece keeps its ``most`` terms that stand out, which are ranked once more over shards.

Shares are integers, ``1 + floor(10**9 * (count + 5) / (N + 5 * V))`` by long division, so all sums are exact.

Defined results: a null text, lang or source is an empty one; a group without kept terms takes part with equal shares; where a
language keeps no term, all its pairs have the value 0; a language with one source has no pairs; rows with null or repeated ids are documents
like others; ties go by the item's bytes; an empty table gives an empty result; other columns aren't read. Texts are never cut.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, joined_bytes, lean, sized, slices, span_texts, word_spans, written

SCALE, SMOOTH = 10**9, 5
MIN_DOCS, MOST = 30, 50
#: Terms of a shard and groups of a block, about (their sizes spread as those of hash buckets): a block takes some 4 MB.
TERMS, GROUPS = 32_768, 16
#: Rounds that one job plays; a block is sent once for each.
WAVE = 16
#: Bytes of text that are counted at once.
SLICE = 8 << 20

_OF_TERM = np.zeros(256, bool)
_OF_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PIECE = "lang string, source string, shard int, block int, blocks int, size int, floor long, places binary, extra binary, best array<struct<item:string,value:long>>"


# ---------------------------------------------------------------- counts
def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of each slice; a group also has a row without a term."""
    for part in slices(batches, 0, SLICE):
        data, offsets = joined_bytes(part.column(0))
        data = data.lower()
        starts, ends, bounds = word_spans(data, offsets, _OF_TERM)
        found = span_texts(data, starts, ends).dictionary_encode()
        code, names = found.indices.to_numpy(), found.dictionary
        lang, source = (part.column(k).dictionary_encode() for k in (1, 2))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        width = max(len(names), 1)
        of_doc, times = np.unique(np.repeat(np.arange(part.num_rows), np.diff(bounds)) * width + code, return_counts=True)
        of_group, at = np.unique(group[of_doc // width] * width + of_doc % width, return_inverse=True)
        n, docs = np.bincount(at, times, len(of_group)).astype(np.int64), np.bincount(at, minlength=len(of_group))
        alone = np.unique(group)
        where = np.concatenate([of_group // width, alone])
        zero = np.zeros(len(alone), np.int64)
        yield pa.RecordBatch.from_arrays([
            lang.dictionary.take(pa.array(where // len(source.dictionary))), source.dictionary.take(pa.array(where % len(source.dictionary))),
            pa.concat_arrays([names.take(pa.array(of_group % width)).cast(pa.string()), pa.array([""] * len(alone), pa.string())]),
            pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs, zero]))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it); the empty term stands for the group itself."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    found = read.mapInArrow(lean(_counting), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The integer shares of counts; the division goes by three digits of base 1,000, so nothing passes 64 bits."""
    left, whole = count.astype(np.int64) + SMOOTH, total + SMOOTH * terms
    out = np.zeros(len(left), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


# ---------------------------------------------------------------- pieces
def _piece(most: int):
    """One row of a group's counts in a shard: its shares above the smallest, packed, and the terms that stand out."""

    def made(table: pa.Table) -> pa.Table:
        first = {n: table.column(n)[0].as_py() for n in ("lang", "source", "shard", "block", "blocks", "size", "total", "terms", "lang_total")}
        table = table.filter(table.column("id").is_valid()).sort_by("id")
        ids, n, all_n = (table.column(c).to_numpy() for c in ("id", "n", "lang_n"))
        some = first["terms"] > 0
        floor = int(shares(np.zeros(1, np.int64), first["total"], first["terms"])[0]) if some else 0
        own = shares(n, first["total"], first["terms"]) if some else np.zeros(0, np.int64)
        over = own - shares(all_n, first["lang_total"], first["terms"]) if some else own
        up = np.flatnonzero(over > 0)
        if len(up) > most:  # those below the last of the best can't be among them
            up = up[over[up] >= np.partition(over[up], len(up) - most)[len(up) - most]]
        names = table.column("term").take(pa.array(up)).to_pylist()
        best = heapq.nsmallest(most, ((-v, x.encode()) for v, x in zip(over[up].tolist(), names, strict=True)))
        packed = [zlib.compress(x.tobytes(), 1) for x in (np.diff(ids.astype(np.int32), prepend=np.int32(0)), own - floor)]
        row = {n: [first[n]] for n in ("lang", "source", "shard", "block", "blocks", "size")}
        row |= {"floor": [floor], "places": [packed[0]], "extra": [packed[1]], "best": [[{"item": x.decode(), "value": -v} for v, x in best]]}
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(row.items(), kinds, strict=True)})

    return made


def _shares_of(size: int, floor: int, places: bytes, extra: bytes) -> np.ndarray:
    """A piece as the shares of all its shard's terms."""
    out = np.full(size, floor, np.int64)
    out[np.cumsum(np.frombuffer(zlib.decompress(places), np.int32))] += np.frombuffer(zlib.decompress(extra), np.int64)
    return out


def pieces(counts: DataFrame, min_docs: int, most: int) -> DataFrame:
    """A row of ``_PIECE`` for every group and shard of its language, written."""
    real = counts.filter("term <> ''")
    by_term = written(real.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs"), "kept")
    groups = counts.filter("term = ''").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("members")).join(by_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    up = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("int")
    langs = sized(langs.select(
        "lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        up("members", GROUPS).alias("blocks"), F.coalesce(up("terms", TERMS), F.lit(1)).alias("shards")), "langs")
    dealt = by_term.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    ids = (F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1).alias("id")
    kept = written(dealt.select("lang", "term", "shard", "lang_n", ids), "terms")
    sizes = sized(kept.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("size")), "sizes")
    own = written(real.join(kept, ["lang", "term"]).select("lang", "source", "shard", "id", "n", "lang_n", "term"), "counts")
    members = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")
    members = members.withColumns({"total": F.coalesce("total", F.lit(0)), "block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")})
    each = members.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(sizes, ["lang", "shard"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    facts = sized(each.select("lang", "source", "shard", "block", "blocks", "size", "total", "terms", "lang_total"), "groups")
    nothing = {"id": "int", "n": "long", "lang_n": "long", "term": "string"}
    rows = own.join(facts, ["lang", "source", "shard"]).unionByName(facts.withColumns({n: F.lit(None).cast(t) for n, t in nothing.items()}))
    return written(rows.groupBy("lang", "source", "shard").applyInArrow(_piece(most), _PIECE), "pieces")


# ---------------------------------------------------------------- meetings
def _meeting(home: pa.Table, guests: pa.Table) -> pa.Table:
    """Parts of the distances between a resident block and the pieces that visit it, both ways; a block that meets itself counts each pair once."""
    read = lambda t: zip(*(t.column(c).to_pylist() for c in ("source", "block", "size", "floor", "places", "extra")), strict=True)
    own = list(read(home))
    names = [x[0] for x in own]
    block = np.stack([_shares_of(*x[2:]) for x in own]) if own else None
    lang, found = home.column("lang")[0].as_py() if own else None, []
    for source, of, *piece in read(guests) if own else ():  # a block may have no group
        apart = np.abs(block - _shares_of(*piece)).sum(axis=1).tolist()
        for name, value in zip(names, apart, strict=True):
            if of != own[0][1]:
                found += [(name, source, value), (source, name, value)]
            elif name != source:
                found.append((name, source, value))
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "source": pa.array(columns[0], pa.string()), "item": pa.array(columns[1], pa.string()), "value": pa.array(columns[2], pa.int64())})


def distances(made: DataFrame) -> DataFrame:
    """lang, source, item and value of every ordered pair of a language's groups, from ``pieces``."""
    spark = made.sparkSession
    home = made.drop("best").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "shard", "block").persist()
    rounds = made.agg(F.max("blocks")).first()[0] or 0
    played = []
    for begin in range(0, rounds, WAVE):
        turn = F.explode(F.sequence(F.lit(begin), F.least(F.lit(begin + WAVE), F.col("blocks")) - 1)).alias("turn")
        guests = made.drop("best").filter(F.col("blocks") > begin).select("*", turn).withColumn("place", F.pmod(F.col("turn") - F.col("block"), F.col("blocks")))
        # of the two blocks that meet, the lower one stays at home where the sum of their numbers is even, the higher one where it is odd
        visits = guests.filter((F.col("place") == F.col("block")) | ((F.col("place") < F.col("block")) == ((F.col("place") + F.col("block")) % 2 == 0)))
        met = home.groupBy("lang", "shard", "block").cogroup(visits.groupBy("lang", "shard", "place"))
        played.append(written(met.applyInArrow(_meeting, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "meetings"))
    home.unpersist()
    if not played:
        return spark.createDataFrame([], "lang string, source string, item string, value long")
    every = played[0]
    for more in played[1:]:
        every = every.unionByName(more)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, most: int = MOST, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: of every group the distance to each other source of its language (``pair``), and up to ``most`` terms whose share is above the language's (``term``)."""
    counts = written(term_counts(docs, lang, source, text), "term-counts")
    made = pieces(counts, min_docs, most)
    forget(counts)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = made.select("lang", "source", F.explode("best").alias("b")).select("lang", "source", "b.item", "b.value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    pairs = distances(made).withColumn("rank", F.row_number().over(order))
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(pairs, "pair").unionByName(shown(best, "term"))
