"""Readers and writers: Parquet for tables, JSON for the sidecar, pickles of pandas frames and nothing else."""

from __future__ import annotations

import json
import pickle
import warnings
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlane.functions.cluster import ship
from barlane.sources.schemas import SIDECAR, SUBMISSION, TRAIN, X_TEST, Y_TRUE, conform


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store its scheme names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: T.StructType, optional: Sequence[str] = ()) -> DataFrame:
    """A table with the columns of `schema`, of which the optional ones need not be there. A path ending in .pkl is a pandas pickle, and so are
    the files of a folder or pattern ending in /*.pkl; see read_pickles()."""
    if path.endswith((".pkl", ".pickle")):
        return conform(read_pickles(spark, path, schema, optional), schema, optional)
    return conform(spark.read.parquet(path), schema, optional)


def read_pickles(spark: SparkSession, path: str, schema: T.StructType, optional: Sequence[str] = ()) -> DataFrame:
    """The rows of many pickled pandas frames, each file read by a task, with the columns of `schema` that are there.

    `path` is a file, a folder or a pattern. Pickles can run any code when they are read, so only what frames are made of is let in
    (SAFE); a file that names anything else fails the job. Times may be strings or times. Every frame must have the columns that the first
    one has of the optional ones; others are null. A file is one task's work and must fit into it.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.p*kl*").load(path).select("content")
    first = files.limit(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"name": [str(c) for c in unpickled(x).columns]}) for b in batches for x in b.column(0).to_pylist()), "name string")
    there = {r["name"] for r in first.collect()}
    fields = [f for f in schema.fields if f.name in there or f.name not in optional]
    kinds = {f.name: "string" if isinstance(f.dataType, T.TimestampType) else f.dataType.simpleString() for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                yield as_batch(unpickled(content), kinds)

    return files.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def as_batch(frame, kinds: dict[str, str]) -> pa.RecordBatch:
    """The columns of a pandas frame by name, cast; times become strings in UTC, and columns that are not there null."""
    import pandas as pd

    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    out = []
    for name, kind in kinds.items():
        if name not in frame.columns:
            out.append(pa.nulls(len(frame), types[kind]))
            continue
        column = frame[name]
        if pd.api.types.is_datetime64_any_dtype(column):
            column = column.dt.tz_localize("UTC") if column.dt.tz is None else column.dt.tz_convert("UTC")
            column = column.dt.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        if kind == "string":
            column = [None if pd.isna(x) else str(x) for x in column]
        out.append(pa.Array.from_pandas(column, type=types[kind], safe=False))
    return pa.RecordBatch.from_arrays(out, list(kinds))


# What a pickled frame of numbers, strings and times is made of.
SAFE = {
    "builtins": ("slice", "list", "dict", "set", "tuple", "int", "float", "bool", "str", "bytes", "complex", "object"),
    "collections": ("OrderedDict",),
    "datetime": ("datetime", "date", "timedelta", "timezone"),
    "numpy": ("ndarray", "dtype", "datetime64", "timedelta64", "bool_", "int8", "int16", "int32", "int64", "float32", "float64", "object_", "str_"),
    "numpy.core.multiarray": ("_reconstruct", "scalar"),
    "numpy._core.multiarray": ("_reconstruct", "scalar"),
    "numpy.core.numeric": ("_frombuffer",),
    "numpy._core.numeric": ("_frombuffer",),
    "pandas": ("DataFrame", "Series", "Index", "RangeIndex", "Timestamp"),
    "pandas.core.frame": ("DataFrame",),
    "pandas.core.series": ("Series",),
    "pandas.core.internals.managers": ("BlockManager", "SingleBlockManager"),
    "pandas.core.internals.blocks": ("new_block",),
    "pandas._libs.internals": ("_unpickle_block", "BlockPlacement"),
    "pandas._libs.arrays": ("__pyx_unpickle_NDArrayBacked",),
    "pandas._libs.tslibs.timestamps": ("_unpickle_timestamp",),
    "pandas._libs.tslibs.nattype": ("_nat_unpickle",),
    "pandas.core.indexes.base": ("_new_Index", "Index"),
    "pandas.core.indexes.numeric": ("Int64Index", "Float64Index"),
    "pandas.core.indexes.range": ("RangeIndex",),
    "pandas.core.indexes.datetimes": ("_new_DatetimeIndex", "DatetimeIndex"),
    "pandas.core.arrays.datetimes": ("DatetimeArray",),
    "pandas.core.arrays.string_": ("StringArray", "StringDtype"),
    "pandas.core.arrays.integer": ("IntegerArray", "Int64Dtype", "Int32Dtype", "Int8Dtype"),
    "pandas.core.arrays.floating": ("FloatingArray", "Float64Dtype", "Float32Dtype"),
    "pandas.core.dtypes.dtypes": ("DatetimeTZDtype",),
    "pandas._libs.missing": ("NA",),
    "pytz": ("_UTC", "_p"),
}


def unpickled(content: bytes):
    """A pickled pandas frame; UnpicklingError if it names anything but SAFE, TypeError if it is something else."""
    import io

    import pandas as pd

    class Frames(pickle.Unpickler):
        def find_class(self, module: str, name: str):
            if name not in SAFE.get(module, ()):
                raise pickle.UnpicklingError(f"a pickled table can't hold {module}.{name}")
            return super().find_class(module, name)

    found = Frames(io.BytesIO(content)).load()
    if not isinstance(found, pd.DataFrame):
        raise TypeError("the pickle holds no table")
    return found


def read_train(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TRAIN)


def read_x_test(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, X_TEST)


def read_truth(spark: SparkSession, path: str) -> DataFrame | None:
    """The local truth, or None with a warning if the file is not there. Times that can't be read are null; without times or
    tokens the file has no such columns, and metrics by time are 0."""
    if not exists(spark, path):
        warnings.warn(f"{path} is not there; local evaluation is skipped", stacklevel=2)
        return None
    return read_table(spark, path, Y_TRUE, ("event_datetime", "token"))


def read_sidecar(spark: SparkSession, path: str) -> dict | None:
    """The four entries of a dataset's JSON description, or None if there is none."""
    if not exists(spark, path):
        return None
    df = spark.read.option("multiLine", True).json(path)
    row = df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in SIDECAR)).first()
    return row.asDict(recursive=True) if row else None


def literal_table(spark: SparkSession, columns: dict[str, Sequence], schema: T.StructType | str | None = None) -> DataFrame:
    """A small table from lists of equal length."""
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema or list(columns))


def spaced(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, time_step 0..n-1 and per column n evenly spaced numbers from the smallest to the largest it has in the rows of a
    key, of which there are n: linspace() by the bounds of a table. A key's rows are made a thousand at a time, in any task."""
    n, chunk = F.col("n"), 1000
    bounds = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{m} {c}") for c in columns for f, m in ((F.min, "low"), (F.max, "high"))))
    starts = F.sequence(F.lit(0).cast("long"), n - 1, F.lit(chunk).cast("long"))
    parts = bounds.withColumn("from", F.explode(starts)).repartition(*keys, "from")
    rows = parts.withColumn("time_step", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + chunk, n) - 1)))
    steps = F.greatest(n - 1, F.lit(1))
    at = lambda c: F.col(f"low {c}") + F.col("time_step") * ((F.col(f"high {c}") - F.col(f"low {c}")) / steps)
    return rows.select(*keys, "time_step", *(at(c).alias(c) for c in columns))


def linspace(spark: SparkSession, n: int, columns: dict[str, tuple[float, float]]) -> DataFrame:
    """time_step 0..n-1 and per column n evenly spaced numbers from its first to its last."""
    steps = max(1, n - 1)
    return spark.range(n).select(F.col("id").cast("int").alias("time_step"), *((F.lit(lo) + F.col("id") * F.lit((hi - lo) / steps)).alias(c) for c, (lo, hi) in columns.items()))


def write_submission(df: DataFrame, path: str) -> None:
    """Parquet; a path ending in .pkl gives a pandas pickle, collected on the driver."""
    out = conform(df, SUBMISSION)
    if path.endswith((".pkl", ".pickle")):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        out.toPandas().to_pickle(path)
    else:
        out.write.mode("overwrite").parquet(path)


def write_weights(config: dict, path: str) -> None:
    """A model's configuration: JSON, or a pickle for a path ending in .pkl. It is a small driver-side file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if path.endswith((".pkl", ".pickle")):
        Path(path).write_bytes(pickle.dumps({"config": config}))
    else:
        Path(path).write_text(json.dumps({"config": config}))


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, for code outside Spark."""
    return df.toLocalIterator(prefetchPartitions=True)


def to_arrow(df: DataFrame):
    """The whole of a bounded result as an Arrow table, for code outside Spark."""
    return df.toArrow()
