"""Repositories as a data source: ``spark.read.format("repository").load(address)``, and as a stream of the changes between commits.

Rows are (path, content, raw_url, file_type, seq), which ``streaming.ingest.index_stream`` takes. A batch has the wanted files of a branch, with ``seq`` 0. A stream
starts with all of them; then each commit that the branch is found at gives what differs from the one before: new and changed files, and a row with null ``content`` for each that went.

Options: ``most`` (files of a listing; 0 for all), ``partitions`` (how many tasks fetch at once), ``api``, ``raw``, ``token``, ``attempts``, ``pause``.
"""

from __future__ import annotations

import logging
import re
import time
import urllib.error
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..session import ship
from .repository import ADDRESS, FILES, MOST_FILES, HttpHost, keeps

Row = tuple[str, str | None, str, str, int]


def register(spark: SparkSession) -> None:
    """Make the format ``repository`` known to a session, with its filters on ``path``."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)


@dataclass
class Files(InputPartition):
    """Files of a task: (path, address), and those that went."""

    found: list[tuple[str, str]]
    gone: list[tuple[str, str]]
    seq: int = 0


def _dealt(found: list[tuple[str, str]], gone: list[tuple[str, str]], n: int, seq: int) -> list[Files]:
    """At most ``n`` partitions of nearly equal numbers of files; one, without any, if there are none."""
    n = max(1, min(n, max(len(found), len(gone))))
    return [Files(found[k::n], gone[k::n], seq) for k in range(n)]


class _Where:
    """A branch of a repository and its host, from a source's options."""

    def __init__(self, options: dict[str, str]):
        address = re.search(ADDRESS, options.get("path", "").strip().rstrip("/"))
        if not address:
            raise ValueError(f"not a repository address: {options.get('path')}")
        own = {k: options[k] for k in ("api", "raw", "token") if k in options}
        self.host = HttpHost(**own, attempts=int(options.get("attempts", 4)), pause=float(options.get("pause", 1.0)))
        self.owner, self.repo, self.ref = address.groups()
        self.most, self.partitions = int(options.get("most", MOST_FILES)) or None, int(options.get("partitions", 15))

    def branch(self) -> str:
        self.ref = self.ref or self.host.default_branch(self.owner, self.repo)
        return self.ref

    def url(self, ref: str, path: str) -> str:
        return self.host.raw_url(self.owner, self.repo, ref, path)

    def row(self, path: str, url: str, seq: int, content: str | None) -> Row:
        return path, content, url, path.rpartition(".")[2].lower(), seq


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return f"{FILES}, seq long"

    def reader(self, schema: object) -> FilesReader:
        return FilesReader(_Where(dict(self.options)))

    def streamReader(self, schema: object) -> ChangesReader:  # noqa: N802
        return ChangesReader(_Where(dict(self.options)))


class FilesReader(DataSourceReader):
    """The wanted files of a branch. Filters on ``path`` drop entries of the listing, so what they reject isn't fetched.

    A file that the host doesn't have is left out with a warning; any other failure that lasts fails its task, which Spark runs again by itself.
    """

    def __init__(self, where: _Where):
        self.where, self.filters = where, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def _passes(self, path: str) -> bool:
        return all(path.startswith(f.value) if isinstance(f, StringStartsWith) else path in f.value if isinstance(f, In) else path == f.value for f in self.filters)

    def partitions(self) -> list[Files]:
        w, ref = self.where, self.where.branch()
        kept = [path for path, kind, size, _ in w.host.listing(w.owner, w.repo, ref) if keeps(path, kind, size)][: w.most]
        return _dealt([(p, w.url(ref, p)) for p in kept if self._passes(p)], [], w.partitions, 0)

    def read(self, partition: Files) -> Iterator[Row]:
        for path, url in partition.found:
            try:
                content = self.where.host.content(url)
            except urllib.error.HTTPError as error:
                if error.code not in (404, 410):
                    raise
                logging.getLogger(__name__).warning("%s can't be fetched: %s", path, error)
                continue
            yield self.where.row(path, url, 0, content)


class ChangesReader(DataSourceStreamReader):
    """Changes between commits. An offset names a commit and, in microseconds, when the branch was first found there, which orders versions.

    Addresses name the commit, so a batch that is read again gives the same rows whatever has been pushed since.
    """

    def __init__(self, where: _Where):
        self.where, self.last = where, {"commit": "", "seq": 0}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": "", "seq": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        w = self.where
        commit = w.host.head(w.owner, w.repo, w.branch())
        if commit != self.last["commit"]:
            self.last = {"commit": commit, "seq": max(time.time_ns() // 1000, self.last["seq"] + 1)}
        return self.last

    def _digests(self, commit: str) -> dict[str, str]:
        if not commit:
            return {}
        w = self.where
        return dict([(path, digest) for path, kind, size, digest in w.host.digests(w.owner, w.repo, commit) if keeps(path, kind, size)][: w.most])

    def partitions(self, start: dict, end: dict) -> list[Files]:
        w, before, after = self.where, self._digests(start["commit"]), self._digests(end["commit"])
        found = [(p, w.url(end["commit"], p)) for p, digest in after.items() if before.get(p) != digest]
        return _dealt(found, [(p, w.url(end["commit"], p)) for p in before if p not in after], w.partitions, end["seq"])

    def read(self, partition: Files) -> Iterator[Row]:
        for path, url in partition.found:
            yield self.where.row(path, url, partition.seq, self.where.host.content(url))
        for path, url in partition.gone:
            yield self.where.row(path, url, partition.seq, None)
