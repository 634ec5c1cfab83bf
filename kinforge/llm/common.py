"""Shared plumbing: the cluster's shared folder, written-and-reread tables, Arrow text batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside keys; results show null again.
NULL_ID = -(2**63)
#: Whether a query's shuffle files go when it ends; by default they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_llm_shared_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark._llm_shared_dir = tempfile.mkdtemp(prefix="llm-shared-")
    return found.rstrip("/")


def written(df: DataFrame, label: str, options: dict | None = None, release: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors. release: the shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    if release:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    finally:
        if release and was is None:
            spark.conf.unset(CLEANUP)
        elif release:
            spark.conf.set(CLEANUP, was)
    spark.__dict__.setdefault("_llm_written", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(spark: SparkSession) -> int:
    """Deletes the tables that this session has written, once no result that reads them is wanted any more; their number."""
    paths = spark.__dict__.pop("_llm_written", [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_text(docs: DataFrame) -> DataFrame:
    """(doc_id, salt, text): a key that is never null, text null as empty. salt, the text's 64-bit hash, tells rows of one doc_id with different texts apart; rows equal in both are treated alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("salt"), text.alias("text"))


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, with underscores after it as long as a column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shown_id() -> Column:
    return F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id")


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array, one after another, and the n + 1 offsets; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def row_texts(column: pa.Array) -> list[bytes]:
    """Each row's text as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What this worker keeps under a name from task to task; what it kept under another is let go, so a worker holds one thing at a time."""
    if name not in _held:
        released()
        _held[name] = make()
    return _held[name]


def released() -> None:
    """Lets go of what this worker remembers, and gives freed memory back to the system: for operators that remember nothing."""
    if _held:
        _held.clear()
        gc.collect()
        trimmed()


def trimmed() -> None:
    """Gives freed memory back to the system: an executor has more workers than tasks at times, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A mapInArrow function of one that maps a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch)
            if out is not None and out.num_rows:
                yield out

    return run


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text, in one aggregate."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def lowered_ascii() -> np.ndarray:
    """Byte table: A-Z to a-z, all else kept."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def id_crc32(text: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
