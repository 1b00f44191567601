"""What the training-data operators share: input columns, Arrow batches and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.functions.cluster import shared_dir, ship

#: White space of the query contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: A word of the query contracts.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of an Arrow batch. Documents can be very long, so a batch holds few of them.
BATCH_ROWS = 256
#: Stands for a null doc_id inside operators, which never return it.
NO_ID = -(2**63)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder, through Spark's reader whatever store the folder is in."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of this session at `rows` rows or fewer, so that long texts fit into a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return what a finished task has freed to the system. Workers live on from task to task, and their allocators keep
    freed memory, so that an executor would hold the largest task that each worker ever had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches, after which a worker gives its memory back."""
    small_batches(df.sparkSession)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


_space: ContextVar[str | None] = ContextVar("workspace", default=None)
#: Paths that stay after their operator has ended.
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, or in the workspace that is open; whoever asks for it writes it."""
    path = f"{_space.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _space.get():
        _made.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all that the operators of this process have left in the shared folder, and say how many paths that were. Results that
    are read from them can't be read any more."""
    n = 0
    while _made:
        n += delete(spark, _made.pop())
    return n


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file, whatever store it is in; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A folder for what an operator writes on its way, which goes at the end. Yields a function that writes a result
    outside of it, to stay; anything else that was read from it can't be read afterwards."""
    path = scratch(spark, name)
    token = _space.set(path)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _space.set(None)
        try:
            return written(df, name)
        finally:
            _space.reset(inside)

    try:
        yield keep
    finally:
        _space.reset(token)
        delete(spark, path)


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there, and it is computed once.

    batch_rows is the size of Arrow batches meanwhile, for rows that are known to be small.
    """
    path = scratch(df.sparkSession, name)
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    usual = conf.get(key)
    try:
        if batch_rows:
            conf.set(key, str(batch_rows))
        df.write.parquet(path)
    finally:
        conf.set(key, usual)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes, from its files; it only ever sizes partitions."""
    with contextlib.suppress(Exception):
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    return 0


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """How many partitions the rows of `df` should be dealt to: its size decides, and the session's setting is the least."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, min(size // bytes_each + 1, 1_000_000)) if size < 2**62 else least


def parts_of(spark: SparkSession, size: int, bytes_each: int) -> int:
    """How many partitions `size` bytes of rows should be dealt to: no more than they fill, but one a core at least."""
    return max(spark.sparkContext.defaultParallelism, min(size // bytes_each + 1, 1_000_000))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of `df` has, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def filesystem(uri: str):
    """(file system, path) of a URI: local, HDFS or an object store, by the scheme. Hadoop's names of S3 mean S3."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def fold(doc_id: Column) -> Column:
    """doc_id, or NO_ID for null, so that joins and groups keep such rows."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def unfold(doc_id: Column) -> Column:
    """The inverse of fold()."""
    return F.when(doc_id == NO_ID, F.lit(None).cast("long")).otherwise(doc_id)


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    """Whether the unsigned crc32 of doc_id's decimal text leaves no rest by `folds`. A null doc_id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def held_out_col(doc_id: Column, folds: int = 5) -> Column:
    """held_out() as a column."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def worker_env() -> None:
    """Keep the libraries of a Python worker to one thread: the executors' cores are all in use."""
    for key, value in (("TOKENIZERS_PARALLELISM", "false"), ("RAYON_NUM_THREADS", "1"), ("OMP_NUM_THREADS", "1"), ("OPENBLAS_NUM_THREADS", "1")):
        os.environ.setdefault(key, value)


def grouped(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """(first column, texts of the second column with "" for null) of batches together up to about `chars` characters."""
    ids: list = []
    texts: list[str] = []
    total = 0
    for batch in batches:
        new = [t or "" for t in batch.column(1).to_pylist()]
        ids += batch.column(0).to_pylist()
        texts += new
        total += sum(map(len, new))
        if total >= chars:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def chunks(items: list, weights: Iterable[int], most: int) -> Iterator[list]:
    """Runs of items whose weights add up to `most` or less, or single items above that."""
    run, total = [], 0
    for item, weight in zip(items, weights, strict=True):
        if run and total + weight > most:
            yield run
            run, total = [], 0
        run.append(item)
        total += weight
    if run:
        yield run
