"""Repositories as tables of files: addresses, the file filter, and readers.

``entries`` is (path, type, size, pos), the listing of a repository in its own order;
``files`` is (path, content, raw_url, file_type). Listings and contents come from a
directory that Spark can read (``load_directory``), from Parquet, or over HTTP (``fetch_repository``).
"""

from __future__ import annotations

import json
import logging
import os
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, file_type
from ..functions.text import strip

log = logging.getLogger(__name__)

#: Fixed value: what a repository's address looks like.
ADDRESS = r"github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+?)(?:\.git)?(?:/tree/([^/\s]+))?(?:/|$)"

# Fixed values of the file filter.
KEPT_EXTENSIONS = (
    "md", "mdx", "mmd", "txt", "rst", "adoc", "py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "rs", "java",
    "kt", "kts", "scala", "groovy", "c", "h", "cpp", "cc", "cxx", "hpp", "cs", "rb", "php", "swift", "dart", "sh",
    "bash", "zsh", "ps1", "json", "yaml", "yml", "toml", "ini", "cfg", "sql", "html", "svelte", "vue", "css", "scss",
    "sass", "less",
)
KEPT_NAMES = ("Makefile", "Dockerfile", "Jenkinsfile", "Procfile", "Rakefile", "Gemfile")
SKIPPED = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock",
    "/node_modules/", "/vendor/", "/dist/", "/build/", "/.next/", "/target/", "/__pycache__/", "/.cache/", "/venv/", "/.venv/",
    ".min.js", ".min.css", ".pyc", ".pyo",
)
LEAST_BYTES, MOST_BYTES, MOST_FILES = 10, 200_000, 400

FILES = "path string, content string, raw_url string, file_type string"


# ---------------------------------------------------------------- addresses
def parse_address(url: Column) -> Column:
    """struct(owner, repo, branch) of a repository's address; null if it is none. A branch ends at its first slash."""
    plain = F.rtrim(strip(url), F.lit("/"))
    part = lambda k: F.nullif(F.regexp_extract(plain, ADDRESS, k), F.lit(""))
    return F.when(plain.rlike(ADDRESS), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("branch")))


def require_address(url: Column) -> Column:
    """``parse_address``, or an error."""
    return F.coalesce(parse_address(url), F.raise_error(F.concat(F.lit("not a repository address: "), F.coalesce(url, F.lit("null")))).cast("struct<owner:string,repo:string,branch:string>"))


def repo_id(owner: Column, repo: Column) -> Column:
    return F.concat_ws("__", owner, repo)


# ---------------------------------------------------------------- filter
def is_wanted(path: Column, kind: Column, size: Column) -> Column:
    """Whether an entry is a file of a fitting size whose path isn't skipped and whose extension or name is known."""
    named = F.when(path.contains("."), file_type(path).isin(*KEPT_EXTENSIONS)).otherwise(F.lit(False)) | basename(path).isin(*KEPT_NAMES)
    skipped = F.lit(False)
    for pattern in SKIPPED:
        skipped = skipped | path.contains(pattern)
    return (kind == "blob") & F.coalesce(size, F.lit(0)).between(LEAST_BYTES, MOST_BYTES) & ~skipped & named


def keeps(path: str, kind: str, size: int) -> bool:
    """``is_wanted`` for one entry, where a listing is read without a session."""
    name = path.rpartition("/")[2]
    named = name in KEPT_NAMES or "." in path and path.rpartition(".")[2].lower() in KEPT_EXTENSIONS
    return kind == "blob" and LEAST_BYTES <= size <= MOST_BYTES and named and not any(x in path for x in SKIPPED)


def wanted(entries: DataFrame, most: int | None = MOST_FILES) -> DataFrame:
    """The wanted entries; with ``most``, the first so many in listing order."""
    kept = entries.filter(is_wanted(F.col("path"), F.col("type"), F.col("size")))
    return kept if most is None else kept.orderBy("pos").limit(most)


# ---------------------------------------------------------------- readers
def _any_case(name: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def _qualified(spark: SparkSession, root: str) -> str:
    """A folder's address as its store names it, which the addresses of files below it begin with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def load_directory(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Files below a folder of any store that Spark reads; with ``most``, the first so many by path.

    Names of other kinds aren't listed, and files of an unfitting size are passed over by their listed length: the contents of neither are read.
    """
    names = ",".join([*(f"*.{_any_case(e)}" for e in KEPT_EXTENSIONS), *KEPT_NAMES])
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{names}}}").load(root)
    raw = raw.filter(F.col("length").between(LEAST_BYTES, MOST_BYTES))
    base = _qualified(spark, root)
    below = F.col("path").startswith(base.rstrip("/") + "/")
    path = F.when(below, F.substr(F.col("path"), F.lit(len(base.rstrip("/")) + 2))).otherwise(F.element_at(F.split("path", "/"), -1))
    entries = raw.select(path.alias("path"), F.lit("blob").alias("type"), F.col("length").alias("size"), F.col("path").alias("raw_url"), "content").withColumn("pos", F.col("path"))
    return wanted(entries, most).select("path", F.decode("content", "UTF-8").alias("content"), "raw_url", file_type(F.col("path")).alias("file_type"))


@dataclass(frozen=True)
class Address:
    owner: str
    repo: str
    ref: str
    repo_id: str


def _pause(error: OSError, usual: float) -> float | None:
    """Seconds to wait before a request is made again; None if that can't help."""
    if not isinstance(error, urllib.error.HTTPError):
        return usual
    after, reset = error.headers.get("Retry-After", ""), error.headers.get("X-RateLimit-Reset", "")
    if error.code == 429 or error.code == 403 and (after or error.headers.get("X-RateLimit-Remaining") == "0"):
        return float(after) if after.isdigit() else max(usual, int(reset) - time.time()) if reset.isdigit() else usual
    return usual if error.code >= 500 else None


class HttpHost:
    """A repository host's web API. ``api`` and ``raw`` are its roots; ``token`` raises the rate limit.

    A request that fails for a while (no connection, an error of the host, a rate limit) is made up to ``attempts`` times: after the pause that the host
    asks for, if that is at most ``longest`` seconds, or else ``pause`` seconds, doubled each time.
    """

    def __init__(
        self, api: str = "https://api.github.com", raw: str = "https://raw.githubusercontent.com", token: str | None = None,
        attempts: int = 4, pause: float = 1.0, longest: float = 120.0,
    ):
        self.api, self.raw = api.rstrip("/"), raw.rstrip("/")
        self.token = token or os.environ.get("GITHUB_TOKEN")
        self.attempts, self.pause, self.longest = attempts, pause, longest

    def _get(self, url: str, timeout: float) -> bytes:
        for k in range(self.attempts):
            try:
                return self._once(url, timeout)
            except OSError as error:
                wait = _pause(error, self.pause * 2**k)
                if wait is None or wait > self.longest or k + 1 == self.attempts:
                    raise
                time.sleep(wait * random.uniform(1.0, 1.25))
        raise ValueError("attempts has to be 1 or more")

    def _once(self, url: str, timeout: float) -> bytes:
        headers = {"Accept": "application/vnd.github+json", "User-Agent": "corpusloom"}
        if self.token:
            headers["Authorization"] = f"Bearer {self.token}"
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return answer.read()

    def default_branch(self, owner: str, repo: str) -> str:
        return json.loads(self._get(f"{self.api}/repos/{owner}/{repo}", 15))["default_branch"]

    def head(self, owner: str, repo: str, ref: str) -> str:
        """The commit that a branch is at."""
        return json.loads(self._get(f"{self.api}/repos/{owner}/{repo}/commits/{urllib.parse.quote(ref, safe='')}", 15))["sha"]

    def _tree(self, owner: str, repo: str, ref: str) -> tuple[list[dict], bool]:
        """All entries, one bounded answer of the host, and whether it cut them short."""
        try:
            answer = json.loads(self._get(f"{self.api}/repos/{owner}/{repo}/git/trees/{urllib.parse.quote(ref, safe='')}?recursive=1", 30))
        except urllib.error.HTTPError as error:
            if error.code == 409:
                raise ValueError("the repository is empty") from error
            raise
        return answer.get("tree", []), bool(answer.get("truncated"))

    def listing(self, owner: str, repo: str, ref: str) -> list[tuple[str, str, int, int]]:
        """(path, type, size, pos) of all entries."""
        entries, cut = self._tree(owner, repo, ref)
        if cut:
            log.warning("the host cut the listing short; only a part of the repository is read")
        return [(x["path"], x["type"], int(x.get("size") or 0), k) for k, x in enumerate(entries)]

    def digests(self, owner: str, repo: str, ref: str) -> list[tuple[str, str, int, str]]:
        """(path, type, size, digest) of all entries; an error if the host cut them short, since what is missing would look deleted."""
        entries, cut = self._tree(owner, repo, ref)
        if cut:
            raise ValueError("the host cut the listing short")
        return [(x["path"], x["type"], int(x.get("size") or 0), x["sha"]) for x in entries]

    def raw_url(self, owner: str, repo: str, ref: str, path: str) -> str:
        return f"{self.raw}/{owner}/{repo}/{ref}/{path}"

    def content(self, url: str) -> str:
        return self._get(url, 20).decode("utf-8", "replace")


def fetch_contents(entries: DataFrame, content: Callable[[str], str]) -> DataFrame:
    """``files`` of entries (path, raw_url); those that can't be fetched are left out with a warning.

    Each partition fetches its own files, so the number of partitions is the number of connections.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, url in zip(batch.column("path").to_pylist(), batch.column("raw_url").to_pylist(), strict=True):
                try:
                    text = content(url)
                except (OSError, ValueError) as error:
                    logging.getLogger(__name__).warning("%s can't be fetched: %s", path, error)
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text]), pa.array([url])], ["path", "content", "raw_url"])

    got = entries.select("path", "raw_url").mapInArrow(run, "path string, content string, raw_url string")
    return got.withColumn("file_type", file_type(F.col("path")))


def fetch_repository(spark: SparkSession, url: str, host: HttpHost | None = None, connections: int = 15, most: int | None = MOST_FILES) -> tuple[DataFrame, Address]:
    """``files`` of a repository over HTTP, ordered by path, and its address."""
    host = host or HttpHost()
    found = spark.range(1).select(require_address(F.lit(url)).alias("a")).select("a.*").first()
    ref = found["branch"] or host.default_branch(found["owner"], found["repo"])
    entries = wanted(spark.createDataFrame(host.listing(found["owner"], found["repo"], ref), "path string, type string, size long, pos long"), most)
    if entries.isEmpty():
        raise ValueError("the repository holds no file that can be indexed")
    prefix = host.raw_url(found["owner"], found["repo"], ref, "")
    files = fetch_contents(entries.withColumn("raw_url", F.concat(F.lit(prefix), "path")).repartition(connections, "path"), host.content)
    return files.orderBy("path"), Address(found["owner"], found["repo"], ref, f"{found['owner']}__{found['repo']}")
