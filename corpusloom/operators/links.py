"""Links kept over changes of files: only imports whose candidates touch a path that came or went are resolved again.

Tables: ``imports`` (src, language, raw), ``tries`` (key, src, language, raw): a row for each file name an import could lead to,
``links`` (src, raw, dst): what each import leads to, dst null where that is nothing (any longer). A file has one language.

An import's result depends on nothing but which of its keys exist, so one whose keys neither came nor went keeps its link. A path that
comes may be a better candidate than the one in use and a path that goes leaves the next best: both are found by resolving the touched imports
anew among the paths under their keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import go_stem, js_candidates, python_candidates, resolve
from .ranking import BROADCAST_TERMS, PUSHED_TERMS, ROW_GROUP, any_of

_IMPORT = ("src", "language", "raw")


# ---------------------------------------------------------------- keys
def keys_of(path: Column) -> Column:
    """What imports can reach a file by: its path, and the stem of a Go file below a directory."""
    stem = go_stem(path)
    return F.when(stem != "", F.array(F.concat(F.lit("path:"), path), F.concat(F.lit("stem:"), stem))).otherwise(F.array(F.concat(F.lit("path:"), path)))


def tries(imports: DataFrame) -> DataFrame:
    """(key, src, language, raw) of ``imports``; languages without a rule have none."""
    src, raw, language = F.col("src"), F.col("raw"), F.col("language")
    paths = F.when(language == "python", python_candidates(src, raw)).when(language.isin("javascript", "typescript"), js_candidates(src, raw))
    keys = F.when(language == "go", F.array(F.concat(F.lit("stem:"), F.substring_index(raw, "/", -1)))).otherwise(F.transform(paths, lambda x: F.concat(F.lit("path:"), x["path"])))
    return imports.select(*_IMPORT).distinct().select(F.explode(F.array_distinct(keys)).alias("key"), *_IMPORT).filter(F.col("key").isNotNull())


def clustered_tries(rows: DataFrame, row_group: int = ROW_GROUP) -> tuple[DataFrame, dict[str, object]]:
    """``tries`` dealt by ranges of (key, src) and sorted, and the options to write them with: a file that all import spreads over ranges of its importers."""
    return rows.repartitionByRange("key", "src").sortWithinPartitions("key", "src"), {"parquet.block.size": row_group}


def _under(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in ``keys`` (a stored table): few keys reach the scan's statistics, more are broadcast up to ``BROADCAST_TERMS`` and joined beyond."""
    few = [r["key"] for r in keys.limit(PUSHED_TERMS + 1).collect()]
    if len(few) <= PUSHED_TERMS:
        return rows.filter(any_of("key", sorted(few)))
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_TERMS else keys, "key", "left_semi")


# ---------------------------------------------------------------- links
def all_links(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Links of all imports, those that lead nowhere left out."""
    return resolve(imports, paths).select("src", "raw", "dst")


def touched(index: DataFrame, changed: DataFrame) -> DataFrame:
    """Imports (src, language, raw) of ``index`` (tries) with a key of ``changed`` (key, distinct and stored)."""
    return _under(index, changed).select(*_IMPORT).distinct()


def relinked(again: DataFrame, dropped: DataFrame, paths: DataFrame, stored) -> DataFrame:
    """Links of the imports ``again`` among ``paths`` (path, all there are now), and null ones of ``dropped`` imports that aren't among them.

    ``stored`` writes a table (df, label) and reads it back. Of ``paths`` only those under a key of ``again`` meet its candidates.
    """
    again = stored(again.select(*_IMPORT).distinct(), "again")
    keys = stored(tries(again).select("key").distinct(), "keys")
    near = _under(paths.select("path", F.explode(keys_of(F.col("path"))).alias("key")), keys).select("path").distinct()
    found = all_links(again, near)
    asked = again.select("src", "raw").unionByName(dropped.select("src", "raw")).distinct()
    return asked.join(found, ["src", "raw"], "left").select("src", "raw", "dst")


def newest(parts: list[DataFrame]) -> DataFrame:
    """The links in force: of each import the row of the last of ``parts`` that has one, null ones left out."""
    if len(parts) == 1:
        return parts[0].filter(F.col("dst").isNotNull())
    numbered = reduce(DataFrame.unionByName, [p.select("src", "raw", F.struct(F.lit(n).alias("part"), "dst").alias("at")) for n, p in enumerate(parts)])
    return numbered.groupBy("src", "raw").agg(F.max("at").alias("at")).select("src", "raw", F.col("at.dst").alias("dst")).filter("dst IS NOT NULL")


def edges_of(links: DataFrame) -> DataFrame:
    """Distinct (src, dst) without loops."""
    return links.filter("dst <> src").select("src", "dst").distinct()
