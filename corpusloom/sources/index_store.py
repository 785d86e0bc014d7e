"""An index on disk: versions of Parquet tables for each repository."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import edge_lists, from_edge_lists

TABLES = ("chunks", "imports", "edges", "postings", "lengths", "terms", "totals")
#: Seconds for which a version that was replaced, or that its writer hasn't finished, stays.
GRACE = 24 * 3600.0


class Conflict(RuntimeError):
    """Another save came first."""


class IndexStore:
    """Versions of repositories' tables below ``root``, which lies in a store that all machines share.

    ``tables/repo_id=X/version=V`` holds a version's tables; ``log/repo_id=X`` has a small file for each save, numbered in order, that names its
    version and tables. A save writes its tables first, then its entry under another name, and moves that to the next number, which fails where another writer has been
    (in one step on a distributed file system). Nothing that is in use is written over: the newest entry is the version that readers get, an older one can be
    read by name, and versions go only when they have been replaced, or left without an entry, for ``grace`` seconds.
    """

    def __init__(self, spark: SparkSession, root: str, grace: float = GRACE):
        self.spark, self.root, self.grace = spark, root.rstrip("/"), grace

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, *parts: str) -> list[str]:
        where = self._at(*parts)
        return sorted(x.getPath().getName() for x in self._fs().listStatus(where)) if self._fs().exists(where) else []

    # ---------------------------------------------------------------- the log
    def _entries(self, repo_id: str) -> list[tuple[int, list[str]]]:
        """(number, [version, *tables]) of each save."""
        names = [n for n in self._children("log", f"repo_id={repo_id}") if n.isdigit()]
        if not names:
            return []
        rows = self.spark.read.text([f"{self.root}/log/repo_id={repo_id}/{n}" for n in names]).select("value", F.input_file_name().alias("name")).collect()
        return sorted((int(r["name"].rpartition("/")[2]), r["value"].split()) for r in rows)

    def _put(self, repo_id: str, number: int, words: list[str]) -> bool:
        """Whether this writer got ``number``."""
        jvm, at = self.spark._jvm, self._at("log", f"repo_id={repo_id}", f"_{uuid.uuid4().hex}")
        out = self._fs().create(at, True)
        out.write(bytearray(" ".join(words).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().makeQualified(at).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(at, self._at("log", f"repo_id={repo_id}", f"{number:012d}"), self.spark._sc._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Py4JJavaError as error:
            self._fs().delete(at, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def versions(self, repo_id: str) -> list[str]:
        """The versions that were saved, the newest last."""
        return [words[0] for _, words in self._entries(repo_id)]

    def version(self, repo_id: str) -> str | None:
        """The version in use; None if the repository isn't indexed."""
        return (self.versions(repo_id) or [None])[-1]

    def has(self, repo_id: str) -> bool:
        return self.version(repo_id) is not None

    # ---------------------------------------------------------------- tables
    def save(self, repo_id: str, tables: dict[str, DataFrame], options: Mapping[str, Mapping[str, object]] | None = None, replaces: str | None = None) -> str:
        """Make ``tables`` a repository's and return the version; readers see them only once all are written.

        With ``replaces`` (the version that the tables were made from) a save that another one overtook is a ``Conflict``; its tables go.
        Otherwise the save that ends last is the one in use. ``options`` are the Parquet writer's for a table.
        """
        made = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.options(**(options or {}).get(name, {})).parquet(f"{self.root}/tables/repo_id={repo_id}/version={made}/{name}")
        while True:
            entries = self._entries(repo_id)
            newest = entries[-1][1][0] if entries else None
            if replaces is not None and newest != replaces:
                self._fs().delete(self._at("tables", f"repo_id={repo_id}", f"version={made}"), True)
                raise Conflict(f"{repo_id} was saved as {newest} after {replaces}")
            if self._put(repo_id, entries[-1][0] + 1 if entries else 1, [made, *tables]):
                break
        self.expire(repo_id)
        return made

    def expire(self, repo_id: str) -> list[str]:
        """Delete versions that were replaced, or left without an entry, longer than ``grace`` ago, and return them."""
        limit, fs, gone = 1000 * (time.time() - self.grace), self._fs(), []
        entries, own = self._entries(repo_id), ("tables", f"repo_id={repo_id}")
        touched = lambda *parts: fs.getFileStatus(self._at(*parts)).getModificationTime()
        replaced = {words[0]: touched("log", f"repo_id={repo_id}", f"{later:012d}") for (_, words), (later, _) in zip(entries, entries[1:], strict=False)}
        newest = entries[-1][1][0] if entries else None
        for name in self._children(*own):
            version = name.removeprefix("version=")
            if version == newest:
                continue
            since = replaced[version] if version in replaced else max([touched(*own, name), *(touched(*own, name, x) for x in self._children(*own, name))])
            if since < limit:
                fs.delete(self._at(*own, name), True)
                gone.append(version)
        for number, words in entries:
            if words[0] in gone:
                fs.delete(self._at("log", f"repo_id={repo_id}", f"{number:012d}"), False)
        return gone

    def load(self, repo_id: str, version: str | None = None) -> dict[str, DataFrame] | None:
        """A repository's tables, of the newest version or of that given; None if there is none."""
        words = next((w for _, w in reversed(self._entries(repo_id)) if version in (None, w[0])), None)
        return words and {n: self.spark.read.parquet(f"{self.root}/tables/repo_id={repo_id}/version={words[0]}/{n}") for n in words[1:]}

    def size(self, repo_id: str, version: str) -> int:
        """Bytes of a version's files."""
        return self._fs().getContentSummary(self._at("tables", f"repo_id={repo_id}", f"version={version}")).getLength()

    def clear(self, repo_id: str) -> None:
        for top in ("log", "tables"):
            self._fs().delete(self._at(top, f"repo_id={repo_id}"), True)

    def repositories(self) -> list[str]:
        return [x.removeprefix("repo_id=") for x in self._children("log") if x.startswith("repo_id=")]

    def retain_only(self, repo_id: str) -> None:
        """Drop every other repository's tables."""
        for other in self.repositories():
            if other != repo_id:
                self.clear(other)

    def write_graph_json(self, repo_id: str, edges: DataFrame) -> str:
        """The graph as JSON lines (path, imports, imported_by); the folder it lies in."""
        edge_lists(edges).orderBy("path").write.mode("overwrite").json(path := f"{self.root}/graph_json/{repo_id}")
        return path

    def read_graph_json(self, repo_id: str) -> DataFrame:
        """The edges that ``write_graph_json`` wrote."""
        return from_edge_lists(self.spark.read.schema("path string, imports array<string>, imported_by array<string>").json(f"{self.root}/graph_json/{repo_id}"))


def checked_join(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their ``embedding`` from (chunk_id, embedding); an error if a chunk has none, or a vector no chunk."""
    lone = chunks.select("chunk_id").join(vectors.select("chunk_id", F.lit(1).alias("v")), "chunk_id", "full_outer")
    counts = chunks.agg(F.count("*")).first()[0], vectors.agg(F.count("*")).first()[0], lone.filter("v IS NULL").limit(1).count()
    if counts[0] != counts[1] or counts[2]:
        raise ValueError(f"{counts[0]} chunks and {counts[1]} vectors don't fit together")
    return chunks.join(vectors, "chunk_id")


class IndexCache:
    """Loaded indexes as persisted tables, of ``most`` bytes of files together: the least recently used ones go first, and a new version takes an old one's place."""

    def __init__(self, store: IndexStore, most: int):
        self.store, self.most = store, most
        self._held: OrderedDict[str, tuple[str, int, dict[str, DataFrame]]] = OrderedDict()

    def _drop(self, repo_id: str) -> None:
        for df in self._held.pop(repo_id)[2].values():
            df.unpersist()

    def get(self, repo_id: str) -> dict[str, DataFrame] | None:
        """A repository's tables as last saved; None if it isn't indexed. An index larger than ``most`` is read without being kept."""
        version = self.store.version(repo_id)
        if repo_id in self._held and self._held[repo_id][0] != version:
            self._drop(repo_id)
        if version is None:
            return None
        if repo_id not in self._held:
            tables, size = self.store.load(repo_id, version), self.store.size(repo_id, version)
            if size > self.most:
                return tables
            while self._held and size + sum(n for _, n, _ in self._held.values()) > self.most:
                self._drop(next(iter(self._held)))
            self._held[repo_id] = (version, size, {n: d.persist() for n, d in tables.items()})
        self._held.move_to_end(repo_id)
        return self._held[repo_id][2]

    def clear(self) -> None:
        for repo_id in list(self._held):
            self._drop(repo_id)
