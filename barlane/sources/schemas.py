"""Table shapes of the engine and checks of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlane.functions.columns import nan_to_null, to_event_time

# Fixed values of the task: rows of a sampled window, its input and target parts.
WINDOW = 70
INPUT_LEN = 60
HORIZON = 10

_ID, _STEP, _REAL = T.LongType(), T.IntegerType(), T.DoubleType()


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TRAIN = _table(("series_id", _ID), ("time_step", _STEP), ("close", _REAL), ("volume", _REAL))
X_TEST = _table(("window_id", _ID), ("time_step", _STEP), ("close", _REAL), ("volume", _REAL))
Y_TRUE = _table(("window_id", _ID), ("time_step", _STEP), ("close", _REAL), ("event_datetime", T.TimestampType()), ("token", T.StringType()))
SUBMISSION = _table(("window_id", _ID), ("time_step", _STEP), ("pred_close", _REAL))
SIDECAR = ("features", "input_len", "horizon_len", "outputs")
#: Narrow types of the file formats, for columns that are there.
NARROW = {"window_id": "int", "time_step": "tinyint", "close": "float", "pred_close": "float"}


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df`, or ValueError if a named column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def conform(df: DataFrame, schema: T.StructType, optional: Iterable[str] = ()) -> DataFrame:
    """The columns of `schema`, cast, with NaN turned into null, and strings that are no time where one is due.

    Columns that are optional and not there are left out.
    """
    require_columns(df, set(schema.fieldNames()) - set(optional))
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType) and isinstance(df.schema[f.name].dataType, T.StringType):
            c = to_event_time(c)
        if isinstance(df.schema[f.name].dataType, (T.FloatType, T.DoubleType)):
            c = nan_to_null(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def narrow(df: DataFrame) -> DataFrame:
    """Cast the columns of NARROW that `df` has; leave the others."""
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in NARROW.items() if c in df.columns})
