"""Windows and features on disk, for training outside Spark: random access, batches and workers without a Spark job.

A dataset is written once: samples in ranges of their index, each worker's by themselves, and a manifest of the files. It is then read with
Arrow: one sample is one row group of one file, and a worker opens its own files only.
"""

from __future__ import annotations

import bisect
import json
import queue
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.functions.cluster import filesystem, shared_dir
from barlane.operators import blocks

#: Samples of a file and of a row group in it.
FILE_ROWS, GROUP_ROWS = 1 << 15, 256
MANIFEST = "samples.json"


def write(samples: DataFrame, folder: str, workers: int = 1, file_rows: int = FILE_ROWS) -> None:
    """Write `samples` (sample_idx, dense from 0, and array columns) to a new folder for that many workers; sample i is of worker i % workers.

    Files hold ranges of one worker's samples, in order. What the driver keeps of them is four numbers and a name a file.
    """
    spark, names = samples.sparkSession, [c for c in samples.columns if c != "sample_idx"]
    turn, place = F.pmod("sample_idx", F.lit(workers)), F.floor(F.col("sample_idx") / workers)
    rows = samples.select("sample_idx", *names, turn.cast("int").alias("worker"), F.floor(place / file_rows).alias("range"))
    # Samples of a range come together by its hash; how many ranges there are follows from the data.
    rows = rows.repartition("worker", "range").sortWithinPartitions("worker", "range", "sample_idx")
    rows.write.partitionBy("worker", "range").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(folder)
    found = spark.read.parquet(folder).groupBy("worker", F.input_file_name().alias("path")).agg(F.min("sample_idx").alias("first"), F.max("sample_idx").alias("last"), F.count(F.lit(1)).alias("n"))
    files = [r.asDict() for r in found.orderBy("worker", "first").collect()]
    for f in files:
        f["path"] = "/".join(f["path"].rsplit("/", 3)[1:])
    fs, root = filesystem(folder)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps({"workers": workers, "columns": names, "files": files}).encode())


class Samples:
    """A written dataset; `samples[i]` is (X, y): the input rows as a matrix of `columns`, and the targets. It may be opened in any process."""

    def __init__(self, folder: str) -> None:
        self.folder, (self.fs, self.root) = folder, filesystem(folder)
        with self.fs.open_input_stream(f"{self.root}/{MANIFEST}") as f:
            manifest = json.loads(f.read())
        self.workers = manifest["workers"]
        self.columns = [c for c in manifest["columns"] if c not in ("series_id", "start", "y")]
        self.files = {w: [f for f in manifest["files"] if f["worker"] == w] for w in range(self.workers)}
        self.bytes_read = 0
        self._group: tuple[tuple[str, int] | None, list] = (None, [])

    def __len__(self) -> int:
        return sum(f["n"] for files in self.files.values() for f in files)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        files = self.files[i % self.workers]
        f = files[bisect.bisect_right(files, i, key=lambda f: f["first"]) - 1]
        place = (i - f["first"]) // self.workers
        for k, n, read in self._groups(f):
            if place < n:
                if self._group[0] != (f["path"], k):
                    self._group = ((f["path"], k), list(self._pairs(read())))
                return self._group[1][place][1:]
            place -= n
        raise IndexError(i)

    def _groups(self, f: dict) -> Iterator[tuple[int, int, Callable[[], pa.Table]]]:
        """(number, rows, reader) of a file's row groups."""
        file = pq.ParquetFile(self.fs.open_input_file(f"{self.root}/{f['path']}"))
        with file:
            for k in range(file.num_row_groups):
                info = file.metadata.row_group(k)

                def read(k: int = k, size: int = info.total_byte_size) -> pa.Table:
                    self.bytes_read += size
                    return file.read_row_group(k, columns=["sample_idx", *self.columns, "y"])

                yield k, info.num_rows, read

    def _pairs(self, table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        wide = lambda c: np.stack([np.array(v.values.to_numpy(zero_copy_only=False), float) for v in table.column(c)])
        x = np.stack([wide(c) for c in self.columns], 2)
        yield from zip(table.column("sample_idx").to_pylist(), x, wide("y"), strict=True)

    def each(self, worker: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(sample_idx, X, y) of one worker's samples in order, from its own files; of all workers' one after another for None."""
        for w in range(self.workers) if worker is None else (worker,):
            for f in self.files[w]:
                for _, _, read in self._groups(f):
                    yield from self._pairs(read())

    def batches(self, size: int, worker: int | None = None, prefetch: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(X, y) of `size` samples stacked, the last of fewer; `prefetch` of them are read ahead by a thread."""
        ready: queue.Queue = queue.Queue(prefetch)
        stop = threading.Event()

        def put(item) -> bool:
            while not stop.is_set():
                try:
                    ready.put(item, timeout=0.1)
                    return True
                except queue.Full:
                    continue
            return False

        def fill() -> None:
            part = []
            try:
                for _, x, y in self.each(worker):
                    part.append((x, y))
                    if len(part) == size:
                        if not put(part):
                            return
                        part = []
                put(part) and part and put([])
            except BaseException as e:  # told to whoever reads
                put(e)

        threading.Thread(target=fill, daemon=True).start()
        try:
            while True:
                part = ready.get()
                if isinstance(part, BaseException):
                    raise part
                if not part:
                    return
                yield tuple(np.stack(a) for a in zip(*part, strict=True))
        finally:
            stop.set()


def _bars(source: DataFrame | str, spark: SparkSession | None) -> DataFrame:
    if isinstance(source, str):
        from barlane.sources.io import read_train

        return read_train(spark or SparkSession.active(), source)
    return source


class FeatureDataset(Samples):
    """Input windows with the features of a pipeline and their targets, written to the shared folder (or `folder`) and opened; a path is read as
    a training file. Without a pipeline the columns are close and volume. `max_samples` takes the first windows by series and start."""

    def __init__(self, source: DataFrame | str, pipeline=None, materialize: bool = True, rolling: bool = True, step_size: int | None = 1, spark: SparkSession | None = None, workers: int = 1, max_samples: int | None = None, folder: str | None = None) -> None:
        if not materialize:
            raise ValueError("random access needs materialize=True; use lazy_features() for one pass")
        samples = blocks.features(_bars(source, spark), pipeline, rolling, step_size)
        if max_samples is not None:
            samples = samples.where(F.col("sample_idx") < max_samples)
        moments = {f.name for f in samples.schema.fields if f.dataType.simpleString() == "double"}
        folder = folder or f"{shared_dir(samples.sparkSession)}/samples-{uuid.uuid4().hex}"
        write(samples.drop("series_id", "start", *moments), folder, workers)
        super().__init__(folder)


class WindowDataset(FeatureDataset):
    """Windows as they are: X is close and volume."""

    def __init__(self, source: DataFrame | str, materialize: bool = True, **options) -> None:
        super().__init__(source, None, materialize, **options)


def lazy_features(source: DataFrame | str, pipeline=None, rolling: bool = True, step_size: int | None = 1, spark: SparkSession | None = None, worker: int = 0, workers: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One pass over the (X, y) of a worker's windows, of every window if there is one worker; nothing is kept. Windows are chosen by their
    number before they reach this process; a dataset that is written for workers spares making the others too."""
    got = blocks.features(_bars(source, spark), pipeline, rolling, step_size).where(F.col("sample_idx") % workers == worker)
    names = [f.name for f in got.schema.fields if f.dataType.simpleString() == "array<double>" and f.name != "y"]
    for row in got.select(*names, "y").toLocalIterator(prefetchPartitions=True):
        yield np.array([row[c] for c in names], float).T, np.array(row["y"], float)


def lazy_windows(source: DataFrame | str, spark: SparkSession | None = None, worker: int = 0, workers: int = 1, rolling: bool = True, step_size: int | None = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """lazy_features() without features: X is close and volume."""
    return lazy_features(source, None, rolling, step_size, spark, worker, workers)
