"""Files that arrive over time become chunks, or an index in segments.

``changes`` is a stream of (path, content, raw_url, file_type, seq): a version of a file, or its end where ``content`` is null. Versions of a path count in the order
of ``seq``, whenever they arrive; of one ``seq`` a file goes before its end, and of two files the one of the larger digest. Rows without a path or ``seq`` are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scratch import written
from ..operators.chunking import chunk_files, routed
from ..operators.embedding import embed
from ..operators.parsing import parse_files
from ..plans.segments import SegmentStore
from ..sources.index_store import Conflict
from ..sources.repository import FILES

CHANGES = f"{FILES}, seq long"
#: Times that a batch is applied anew after another writer came first.
ATTEMPTS = 4


def chunk_stream(files: DataFrame, chunks_path: str, checkpoint: str, model: Callable[[], object] | None = None, available_now: bool = True) -> StreamingQuery:
    """Write chunks of a stream of ``files`` (path, content, raw_url, file_type) below ``chunks_path``.

    A batch is written under its own number, so one that is run again after a failure replaces what it had written.
    """

    def take(batch: DataFrame, number: int) -> None:
        units, parsed = parse_files(routed(batch).filter("route = 'code'").select("path", "content"))
        made = embed(chunk_files(batch, units, parsed), model=model)
        made.write.mode("overwrite").parquet(f"{chunks_path}/batch={number}")

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(chunks: DataFrame) -> DataFrame:
    """Of chunks of several batches, those of each file's last one."""
    newest = chunks.groupBy("path").agg(F.max("batch").alias("batch"))
    return chunks.join(newest, ["path", "batch"], "left_semi")


def _digest(*parts: object) -> str:
    """Of a file (content, raw_url, file_type), hex digits; of its end, nothing, so that a file comes after it in order."""
    known = [x if isinstance(x, str) else None for x in parts]
    return "" if known[0] is None else hashlib.sha256(repr(known).encode("utf-8", "surrogatepass")).hexdigest()


def _newest_here(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each path's rows in a slice, the newest, with its digest: a path with many versions is thinned before it is dealt."""
    for part in parts:
        best: dict[str, tuple[int, str, int]] = {}
        for k, (path, content, url, kind, seq) in enumerate(zip(*(part[c] for c in ("path", "content", "raw_url", "file_type", "seq")), strict=True)):
            this = int(seq), _digest(content, url, kind), k
            if path not in best or this[:2] > best[path][:2]:
                best[path] = this
        yield part.iloc[[k for _, _, k in best.values()]].assign(digest=[d for _, d, _ in best.values()])


def _newer(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    was = state.get if state.exists else None
    now, best = was, None
    for part in parts:
        for k, this in enumerate(zip(part["seq"].astype(int), part["digest"], strict=True)):
            if now is None or this > now:
                now, best = this, part.iloc[[k]]
    if best is not None:
        state.update((int(now[0]), now[1]))
        if now[1] != (was[1] if was else ""):
            yield best[["path", "content", "raw_url", "file_type", "seq"]]


def newest_changes(changes: DataFrame) -> DataFrame:
    """Of a stream of ``changes``, at most one row for each path and batch: its newest version if that differs from the one before.

    A path's state is its last ``seq`` and a digest of that version, never a text, and stays after the file's end, so that a late version
    doesn't bring it back. Repeated rows and versions that come late give nothing.
    """
    known = changes.select("path", "content", "raw_url", "file_type", F.col("seq").cast("long").alias("seq")).filter("path IS NOT NULL AND seq IS NOT NULL")
    return known.mapInPandas(_newest_here, f"{CHANGES}, digest string").groupBy("path").applyInPandasWithState(_newer, CHANGES, "seq long, digest string", "update", GroupStateTimeout.NoTimeout)


def index_stream(changes: DataFrame, store: SegmentStore, repo_id: str, checkpoint: str, model: Callable[[], object] | None = None, available_now: bool = True) -> StreamingQuery:
    """Keep ``repo_id`` of ``store`` equal to an index of the newest versions of all files in a stream of ``changes``.

    A batch is one commit, whose entry in the log names the stream and the batch: chunks, terms and links of replaced files go as those of new ones come, and a
    batch that is run again after a failure, before or after its commit, counts once.
    """
    root, grace = store.root, store.grace

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = SegmentStore(spark, root, grace)
        found = written(batch, "changes")  # also for a batch that was applied, as only rows that are read commit their state
        for left in reversed(range(ATTEMPTS)):
            try:
                own.apply(repo_id, found, (stream, number), model)
                return
            except Conflict:
                if not left:
                    raise

    writer = newest_changes(changes).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
