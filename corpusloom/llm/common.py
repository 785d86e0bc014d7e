"""Helpers that the operators share: scratch tables, Arrow slicing, word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space of the text contracts: space and U+0009 to U+000D.
WHITE = b" \t\n\x0b\x0c\r"
#: Symbols stand for blanks.
PLAIN = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False


# ---------------------------------------------------------------- scratch tables
def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a local one in local mode and an error on a cluster.

    The base library has its own helper of this kind, as it must work without this subpackage.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, label: str, *parts: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder (in folders by ``parts``) and read it back, which cuts its lineage.

    The files go when the driver's file system closes; a lost executor only costs
    the tasks that were running.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path) if parts else df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` made and that no later plan reads; others are left alone."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Ids are broadcast up to this number, which take some 60 MB; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame, label: str, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (a narrow table) written, and marked for a broadcast if it has no more than ``most`` rows.

    A join with it then doesn't shuffle the texts on its other side.
    """
    from pyspark.sql import functions as F

    ids = written(ids, label)
    return F.broadcast(ids) if ids.count() <= most else ids


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many more underscores as keep it apart from ``columns`` and from the others."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow batches
#: Spark gives its workers batches of about so many bytes. By default one may take 64 MB, which stands in the JVM and in the worker of each core at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, unless it has a bound of its own. Batches are no more than a way of transport: no result depends on them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)


def hand_back() -> None:
    """Give memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """``run`` (batches to batches) that hands unused memory back when its task ends, as workers live on beside later stages.

    It does so before, too: a broadcast of the stage before has gone only then.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return held


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        offsets = text_offsets(batch.column(column))
        at, rows = 0, batch.num_rows
        while at < rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), rows)
            yield batch.slice(at, end - at)
            at = end


def text_offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a string array; a null takes no bytes."""
    lengths = np.zeros(len(texts) + 1, np.int64)
    if len(texts):
        import pyarrow.compute as pc

        lengths[1:] = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return np.cumsum(lengths)


def joined_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts as one byte string, and the offsets of each (nulls are empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = text_offsets(texts)
    if not len(texts):
        return b"", offsets
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    first = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset]
    data = texts.buffers()[2]
    return (b"" if data is None else data.slice(int(first), int(offsets[-1])).to_pybytes()), offsets


# ---------------------------------------------------------------- hashing
def mix(h: np.ndarray) -> np.ndarray:
    """A finalising mixer over unsigned 64-bit integers (shift, multiply, shift)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of ``data``, eight bytes of each span at a time."""
    length = (ends - starts).astype(np.uint64)
    h = mix(length + np.uint64(0x9E3779B97F4A7C15))
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, step = np.arange(len(starts)), 0
    while len(live):
        left = length[live] - np.uint64(step)
        value = eight[starts[live] + step]
        short = left < 8
        value[short] &= (np.uint64(1) << (np.uint64(8) * left[short])) - np.uint64(1)
        h[live] = mix((h[live] ^ value) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1))
        step += 8
        live = live[length[live] > step]
    return h


def short_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """``span_hashes`` of the first ``size`` (under 8) bytes, given as little-endian integers."""
    h = mix(np.array([size], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return mix((h ^ (values & np.uint64((1 << (8 * size)) - 1))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def word_spans(data: bytes, offsets: np.ndarray, of_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and for each text the index of its first word; ``of_word`` tells the bytes of words."""
    if not data:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = of_word[np.frombuffer(data, np.uint8)]
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(word))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_texts(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of ``data`` (in order, none inside another) as strings."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    inside = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    own = np.frombuffer(data, np.uint8)[inside]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(own)])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts (A-Z lower-cased), and each text's bounds among them."""
    data, offsets = joined_bytes(texts)
    starts, ends, bounds = word_spans(data := data.lower(), offsets)
    return span_hashes(data, starts, ends), bounds


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class Codes(dict):
    """Numbers keys in order of first sight; ``take_new`` hands over those seen since it was last called."""

    def __init__(self) -> None:
        self._new: list = []

    def __missing__(self, key):
        self[key] = code = len(self)
        self._new.append(key)
        return code

    def take_new(self) -> list:
        new, self._new = self._new, []
        return new


# ---------------------------------------------------------------- labelled rows
def labelled_sample(labels: DataFrame, label: str, usable, most: int, doc_id: str = "doc_id") -> DataFrame:
    """(__id, __y) of at most about ``most`` labelled documents, picked by a hash of their id.

    ``usable`` is a column that is true for rows that may be learned from. Rows without
    an id or label are left out; of several labels of an id the largest counts.
    """
    from pyspark.sql import functions as F

    rows = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & usable).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    total = rows.count()
    if total > most:
        rows = rows.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * most / total))
    return rows
