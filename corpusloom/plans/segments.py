"""An index in segments: files are added and taken out by writing what is new and a list of what is gone.

A part never changes once it is written. A segment holds the chunks, imports and clustered postings of the files that came together, how many of its chunks
hold each term, and how many chunks and words it has. A list of gone chunks names them by segment, with the counts to be taken off. Statistics
of the whole are sums over parts, so scores equal those of an index that is built at once. A part of links holds what imports lead to since a change: all imports of files that came,
and those of others with a candidate among the paths that came or went; of several rows for an import the last part's counts. A version of the index is the list of its parts, an entry in the log of saves.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..functions.text import words
from ..operators import links
from ..operators.ranking import BROADCAST_TERMS, ROW_GROUP, Bm25, clustered, weighted
from ..sources.index_store import Conflict, IndexStore
from .index import Index

#: Parts of a version beyond which they are merged into one segment.
MOST_PARTS = 24


class Parts(NamedTuple):
    """What a version is made of: segments, lists of gone chunks, links in the order they were made, and the last batch of each stream (``b<stream>:<number>``)."""

    version: str | None
    segments: list[str]
    lists: list[str]
    links: list[str]
    marks: list[str]


class SegmentStore(IndexStore):
    """Indexes in segments below ``root``: ``tables/repo_id=X/version=P`` holds a part P, and an entry of the log names a version and its parts."""

    def _read(self, repo_id: str, part: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/tables/repo_id={repo_id}/version={part}/{table}")

    def _write(self, repo_id: str, part: str, table: str, df: DataFrame, **options: object) -> None:
        df.write.options(**options).parquet(f"{self.root}/tables/repo_id={repo_id}/version={part}/{table}")

    def parts(self, repo_id: str) -> tuple[str | None, list[str], list[str]]:
        """The newest version, its segments, and its lists of gone chunks."""
        return self._now(repo_id)[:3]

    def _now(self, repo_id: str) -> Parts:
        entries = self._entries(repo_id)
        version, *names = entries[-1][1] if entries else [None]
        return Parts(version, *([n for n in names if n.startswith(kind)] for kind in "sglb"))

    def _commit(self, repo_id: str, replaces: str | None, names: list[str]) -> str:
        made, entries = uuid.uuid4().hex, self._entries(repo_id)
        newest = entries[-1][1][0] if entries else None
        if newest != replaces or not self._put(repo_id, entries[-1][0] + 1 if entries else 1, [made, *names]):
            raise Conflict(f"{repo_id} was saved by another writer after {replaces}")
        self.expire(repo_id)
        return made

    def expire(self, repo_id: str) -> list[str]:
        """Delete entries that were replaced longer than ``grace`` ago, then parts of that age that no entry names; the parts that went."""
        limit, fs, entries, gone = 1000 * (time.time() - self.grace), self._fs(), self._entries(repo_id), []
        touched = lambda *parts: fs.getFileStatus(self._at(*parts)).getModificationTime()
        kept = set(entries[-1][1][1:]) if entries else set()
        for (number, names), (later, _) in zip(entries, entries[1:], strict=False):
            if touched("log", f"repo_id={repo_id}", f"{later:012d}") < limit:
                fs.delete(self._at("log", f"repo_id={repo_id}", f"{number:012d}"), False)
            else:
                kept |= set(names[1:])
        for name in self._children("tables", f"repo_id={repo_id}"):
            if name.removeprefix("version=") not in kept and touched("tables", f"repo_id={repo_id}", name) < limit:
                fs.delete(self._at("tables", f"repo_id={repo_id}", name), True)
                gone.append(name.removeprefix("version="))
        return gone

    # ---------------------------------------------------------------- changes
    def _segment(self, repo_id: str, paths: DataFrame, chunks: DataFrame, imports: DataFrame, postings: DataFrame) -> str:
        part = f"s{uuid.uuid4().hex}"
        self._write(repo_id, part, "paths", paths.select("path").distinct())
        self._write(repo_id, part, "chunks", chunks)
        self._write(repo_id, part, "imports", imports)
        dealt, options = links.clustered_tries(written(links.tries(imports), "tries"))  # ranges are sampled, so a table first
        self._write(repo_id, part, "tries", dealt, **options)
        dealt, options = clustered(postings, ROW_GROUP)
        self._write(repo_id, part, "postings", dealt, **options)
        postings = self._read(repo_id, part, "postings")
        self._write(repo_id, part, "frequencies", postings.groupBy("term").agg(F.count("*").alias("df")))
        self._write(repo_id, part, "sums", chunks.agg(F.count("*").alias("n")).crossJoin(postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))))
        return part

    def _gone(self, repo_id: str, segments: list[str], lists: list[str], paths: DataFrame) -> str | None:
        """A list of the files of ``paths`` that are in ``segments`` and of their chunks, with their counts below zero; None if there are none."""
        if not segments:
            return None
        paths = _narrow(written(paths, "leaving"))
        leaving = lambda table, *names: written(
            reduce(DataFrame.unionByName, [self._live(repo_id, s, lists, table).join(paths, "path", "left_semi").select(F.lit(s).alias("segment"), *names) for s in segments]), "gone")
        files = leaving("paths", "path")
        if files.isEmpty():
            return None
        gone, part = leaving("chunks", "path", "chunk_id"), f"g{uuid.uuid4().hex}"
        self._write(repo_id, part, "paths", files)
        self._write(repo_id, part, "chunks", gone)
        held = [self._read(repo_id, s, "postings").join(_narrow(gone.filter(F.col("segment") == s).select("chunk_id")), "chunk_id", "left_semi") for s in segments]
        held = written(reduce(DataFrame.unionByName, held), "gone-postings")
        self._write(repo_id, part, "frequencies", held.groupBy("term").agg((-F.count("*")).alias("df")))
        self._write(repo_id, part, "sums", gone.agg((-F.count("*")).alias("n")).crossJoin(held.agg((-F.coalesce(F.sum("tf"), F.lit(0))).alias("words"))))
        return part

    def _relinked(self, repo_id: str, was: Parts, made: str | None, gone: str | None) -> str:
        """Links since ``was``: of the files of segment ``made``, of files that list ``gone`` names, and of imports that those lead or led to."""
        none = self.spark.createDataFrame([], "path string")
        came = self._read(repo_id, made, "paths") if made else none
        went = self._read(repo_id, gone, "paths").select("path") if gone else none
        lists = [*was.lists, *filter(None, [gone])]
        differ = came.join(went, "path", "left_anti").unionByName(went.join(came, "path", "left_anti"))
        changed = written(differ.select(F.explode(links.keys_of(F.col("path"))).alias("key")).distinct(), "changed")
        none = self.spark.createDataFrame([], "src string, language string, raw string")
        again = self._read(repo_id, made, "imports").select(*none.columns) if made else none
        if was.segments:
            tries = reduce(DataFrame.unionByName, [self._live(repo_id, s, lists, "tries") for s in was.segments])
            again = again.unionByName(links.touched(tries, changed))
        left = _narrow(written(went.select(F.col("path").alias("src")).distinct(), "went")) if gone else None
        out = [self._read(repo_id, s, "imports").join(left, "src", "left_semi").select(*none.columns) for s in was.segments] if gone else []
        paths = self._whole(repo_id, [*was.segments, *filter(None, [made])], lists, "paths")
        part = f"l{uuid.uuid4().hex}"
        self._write(repo_id, part, "links", links.relinked(again, reduce(DataFrame.unionByName, out, none), paths, written))
        return part

    def append(self, repo_id: str, files: DataFrame, model: Callable[[], object] | None = None) -> str:
        """Add ``files``; those of a path that is there already take its place. Only they are parsed, embedded and written, and only imports that their paths concern are resolved."""
        was, files = self._now(repo_id), written(files, "files")
        made, gone = self._built(repo_id, files, model), self._gone(repo_id, was.segments, was.lists, files.select("path").distinct())
        return self._changed(repo_id, was, made, gone, model)

    def _built(self, repo_id: str, files: DataFrame, model: Callable[[], object] | None) -> str:
        more = Index.build(files, model)
        return self._segment(repo_id, files, more.chunks, more.imports, more.bm25.postings)

    def applied(self, repo_id: str, stream: str) -> int:
        """The last batch of ``stream`` that was applied, -1 if none was."""
        return max((int(m.rpartition(":")[2]) for m in self._now(repo_id).marks if m.startswith(f"b{stream}:")), default=-1)

    def apply(self, repo_id: str, changes: DataFrame, batch: tuple[str, int], model: Callable[[], object] | None = None) -> str | None:
        """Add the files of ``changes`` (path, content, raw_url, file_type; a row for each path) and take out those whose content is null, all in one version.

        ``changes`` is read several times, so it should be a written table. ``batch`` names a stream and the number of these changes in it. They are applied once: a number that isn't larger than the stream's last one changes nothing.
        """
        was = self._now(repo_id)
        if self.applied(repo_id, batch[0]) >= batch[1]:
            return was.version
        files = changes.select("path", "content", "raw_url", "file_type").filter("content IS NOT NULL")
        made = None if files.isEmpty() else self._built(repo_id, files, model)
        gone = self._gone(repo_id, was.segments, was.lists, changes.select("path"))
        marks = [*(m for m in was.marks if not m.startswith(f"b{batch[0]}:")), f"b{batch[0]}:{batch[1]}"]
        if made or gone:
            return self._changed(repo_id, was, made, gone, model, marks)
        return self._commit(repo_id, was.version, [*was.segments, *was.lists, *was.links, *marks])

    def remove(self, repo_id: str, paths: DataFrame, model: Callable[[], object] | None = None) -> str | None:
        """Take the files of ``paths`` (path) out; the version in use, None if there is none."""
        was = self._now(repo_id)
        gone = self._gone(repo_id, was.segments, was.lists, paths.select("path").distinct())
        return self._changed(repo_id, was, None, gone, model) if gone else was.version

    def _changed(self, repo_id: str, was: Parts, made: str | None, gone: str | None, model: Callable[[], object] | None, marks: list[str] | None = None) -> str:
        since = self._relinked(repo_id, was, made, gone)
        segments, lists, found = [*was.segments, *filter(None, [made])], [*was.lists, *filter(None, [gone])], [*was.links, since]
        done = self._commit(repo_id, was.version, [*segments, *lists, *found, *(was.marks if marks is None else marks)])
        return self.compact(repo_id, model) if max(len(segments) + len(lists), len(found)) > MOST_PARTS else done

    def compact(self, repo_id: str, model: Callable[[], object] | None = None) -> str:
        """Merge all parts into one segment without gone chunks, and one part of links."""
        was, now = self._now(repo_id), self.open(repo_id, model)
        made = self._segment(repo_id, self._whole(repo_id, was.segments, was.lists, "paths"), now.chunks, now.imports, now.bm25.postings)
        part = f"l{uuid.uuid4().hex}"
        self._write(repo_id, part, "links", self._links(repo_id, was))
        return self._commit(repo_id, was.version, [made, part, *was.marks])

    # ---------------------------------------------------------------- reading
    def _live(self, repo_id: str, segment: str, lists: list[str], table: str) -> DataFrame:
        """Rows of a segment's table that no list names: chunks and postings by their chunk, others by their file."""
        rows, by_chunk = self._read(repo_id, segment, table), table == "postings"
        if not lists:
            return rows
        key = "chunk_id" if by_chunk else "src" if table in ("imports", "tries") else "path"
        gone = reduce(DataFrame.unionByName, [self._read(repo_id, g, "chunks" if by_chunk else "paths").select("segment", "chunk_id" if by_chunk else "path") for g in lists])
        gone = _narrow(gone.filter(F.col("segment") == segment).select(F.col("chunk_id" if by_chunk else "path").alias(key)).distinct())
        return rows.join(gone, key, "left_anti").select(*rows.columns)

    def _whole(self, repo_id: str, segments: list[str], lists: list[str], table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._live(repo_id, s, lists, table) for s in segments])

    def _links(self, repo_id: str, now: Parts) -> DataFrame:
        return links.newest([self._read(repo_id, p, "links") for p in now.links])

    def open(self, repo_id: str, model: Callable[[], object] | None = None) -> Index:
        """The index as last saved. Its edges are those of the parts of links; no import is resolved."""
        now = self._now(repo_id)
        if not now.segments:
            raise ValueError(f"{repo_id} isn't indexed")
        chunks, imports, postings = (self._whole(repo_id, now.segments, now.lists, table) for table in ("chunks", "imports", "postings"))
        summed = lambda table: reduce(DataFrame.unionByName, [self._read(repo_id, p, table) for p in (*now.segments, *now.lists)])
        sums = summed("sums").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
        totals = written(sums.select("n", F.coalesce(F.try_divide("words", "n"), F.lit(0.0)).alias("avgdl")), "totals")
        counts = summed("frequencies").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        lengths = chunks.select("chunk_id", F.size(words(F.col("text"))).cast("long").alias("dl"))
        return Index(chunks, imports, links.edges_of(self._links(repo_id, now)), Bm25(postings, lengths, weighted(counts, totals), totals), model)


def _narrow(ids: DataFrame) -> DataFrame:
    """Ids to join with: broadcast while they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_TERMS else ids
