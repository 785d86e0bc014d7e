"""A stream of changed files against an index that is built at once."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusloom.operators.links import edges_of
from corpusloom.plans.segments import SegmentStore
from corpusloom.streaming.ingest import CHANGES, index_stream, newest_changes
from test_segments import same, written_files


def put(spark, folder, changes, k):
    rows = [(p, c, f"u/{p}", "py", q) for p, c, q in changes]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{folder}/{k:03d}")


def stream(spark, folder):
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def newest(changes):
    """The files that are there after all changes, whatever the order in which they come."""
    last = {}
    for path, content, seq in changes:
        if path is not None and seq is not None and (path not in last or (seq, content is not None) > last[path][:2]):
            last[path] = (seq, content is not None, content)
    return {p: c for p, (_, _, c) in last.items() if c is not None}


def test_a_stream_with_replays_late_versions_and_ends_equals_a_build(spark, tmp_path):
    first, second, r = written_files(6, words=5), written_files(6, seed=3, words=5, about="changed"), random.Random(5)
    one = [(p, c, 1) for p, c in first.items()]
    two = [("lib/m0.py", second["lib/m0.py"], 3), ("lib/m1.py", None, 3), ("lib/m2.py", second["lib/m2.py"], 2), ("lib/m2.py", None, 4), (None, "x = 1", 9), ("lib/none.py", "x = 1", None)]
    three = [("lib/m1.py", second["lib/m1.py"], 2), ("lib/m0.py", first["lib/m0.py"], 2), ("lib/m2.py", second["lib/m2.py"], 5), ("lib/m3.py", None, 6), ("lib/never.py", None, 1), *one]
    batches = [one, two, three, two]
    for b in batches:
        r.shuffle(b)
    store, folder, done = SegmentStore(spark, str(tmp_path / "s")), tmp_path / "in", []
    for k, changes in enumerate(batches):
        put(spark, folder, changes, k)
        index_stream(stream(spark, folder), store, "a", str(tmp_path / "ck")).awaitTermination()
        done += changes
    now = newest(done)
    assert sorted(now) == ["lib/m0.py", "lib/m2.py", "lib/m4.py", "lib/m5.py"]
    same(spark, store.open("a"), now)
    assert edges_of(store._links("a", store._now("a"))).filter("src = 'lib/m1.py' OR src = 'lib/m3.py'").isEmpty()
    store.compact("a")
    (mark,) = store._now("a").marks
    version, name = store.version("a"), mark[1:].rpartition(":")[0]
    again = spark.createDataFrame([("lib/m4.py", None, "u", "py")], "path string, content string, raw_url string, file_type string")
    assert store.apply("a", again, (name, store.applied("a", name))) == version == store.version("a")


def test_a_batch_that_fails_after_its_commit_counts_once(spark, tmp_path, monkeypatch):
    """The first run commits to the index, but dies before the stream notes its batch; the next one runs the batch again."""
    store, files = SegmentStore(spark, str(tmp_path / "s")), written_files(3, words=3)
    put(spark, tmp_path / "in", [(p, c, 1) for p, c in files.items()], 0)
    plain = SegmentStore.apply

    deaths = []

    def dies(self, *args):
        plain(self, *args)
        deaths.append(args)
        raise RuntimeError("lost")

    monkeypatch.setattr(SegmentStore, "apply", dies)
    with pytest.raises(StreamingQueryException):
        index_stream(stream(spark, tmp_path / "in"), store, "a", str(tmp_path / "ck")).awaitTermination()
    version = store.version("a")
    assert version and len(deaths) == 1
    monkeypatch.setattr(SegmentStore, "apply", plain)
    index_stream(stream(spark, tmp_path / "in"), store, "a", str(tmp_path / "ck")).awaitTermination()
    assert store.version("a") == version and len(store.versions("a")) == 1
    same(spark, store.open("a"), files)


def test_newest_changes_pass_over_repeats(spark, tmp_path):
    """Repeated rows, ties, a batch of nothing but rows that don't count, and empty input."""
    put(spark, tmp_path / "in", [("a", "1", 1), ("a", "1", 1), ("b", None, 2), ("b", "x", 2), ("c", "", 1)], 0)
    put(spark, tmp_path / "in", [("a", "1", 2), ("b", None, 2), ("c", None, 2), ("c", "late", 1), (None, None, None)], 1)
    put(spark, tmp_path / "in", [], 2)
    seen = []
    made = newest_changes(stream(spark, tmp_path / "in"))
    made.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(x) for x in df.select("path", "content", "seq", F.lit(n)).collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((x[:3] for x in seen), key=repr) == [("a", "1", 1), ("b", "x", 2), ("c", "", 1), ("c", None, 2)]
