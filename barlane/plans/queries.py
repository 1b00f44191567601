"""The engine's operators as queries over the driver's tables; numbers are rounded so that sums in another order agree."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlane.functions.cluster import shared_dir
from barlane.functions.columns import nan_to_null
from barlane.operators import blocks, features, forecast, metrics, returns, strategies, submission, windows
from barlane.plans import oracle
from barlane.sources import fixtures, io

#: Windows that a submission must hold in select_windows_union; the last is not there.
MUST = (1, 2, 9_000_000)
FIRST = 25
#: Added before rounding, so that exact halves always go up: ratios of prices often end in one, and engines differ by their last bit.
NUDGE = 1e-7
#: Files of a part of the stream, and of a batch of it, at most.
FILES = 64


def r(c, digits: int = 8, name: str | None = None):
    return F.round(F.col(c), digits).alias(name or c)


def _returns(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    t = fixtures.tables(spark, sf_dir)
    return returns.joined_returns(t.y_true, t.y_pred, t.x_test, mode)


def _series(spark: SparkSession, sf_dir: str, mode: str = "literal") -> DataFrame:
    return strategies.portfolio_series(_returns(spark, sf_dir, mode))


def _base(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _returns(spark, sf_dir, mode).select("window_id", "time_step", "event_datetime", r("close", 2), r("prev_price", 2), r("true_ret"), r("pred_ret"))

    return query


def _strategy(name: str, mode: str = "literal"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fixtures.tables(spark, sf_dir)
        return strategies.run_strategy(name, t.y_true, t.y_pred, t.x_test, mode=mode).select("event_datetime", r("ret", 7))

    return query


def mse(spark, sf_dir):
    t = fixtures.tables(spark, sf_dir)
    return metrics.mse(t.y_true, t.y_pred).select(r("mse", 2))


def mae(spark, sf_dir):
    t = fixtures.tables(spark, sf_dir)
    return metrics.mae(t.y_true, t.y_pred).select(r("mae", 5))


def sharpe(spark, sf_dir):
    return metrics.sharpe(_series(spark, sf_dir)).select("strategy", r("sharpe", 7))


def equity_curve(spark, sf_dir):
    # Curves are products of many returns: digits that count are relative.
    c = metrics.equity_curve(_series(spark, sf_dir))
    return c.select("event_datetime", "strategy", r("ret", 7), F.round(F.ln(F.abs("equity") + 1), 6).alias("log_equity"), F.round(F.ln(F.abs("peak") + 1), 6).alias("log_peak"))


def max_drawdown(spark, sf_dir):
    return metrics.max_drawdown(_series(spark, sf_dir)).select("strategy", r("mdd", 7))


def var_es(spark, sf_dir):
    return metrics.var_es(_series(spark, sf_dir)).select("strategy", r("var", 7), r("es", 7))


def ic_by_timestamp(spark, sf_dir):
    return metrics.ic_by_timestamp(_returns(spark, sf_dir, "literal")).select("event_datetime", "n", r("ic"))


def ic(spark, sf_dir):
    return metrics.ic_ir(metrics.ic_by_timestamp(_returns(spark, sf_dir, "literal"))).select(r("ic"))


def ir(spark, sf_dir):
    return metrics.ic_ir(metrics.ic_by_timestamp(_returns(spark, sf_dir, "literal"))).select(r("ir", 6))


DIGITS = {"MSE": 2, "MAE": 5, "IC": 8, "IR": 6, "SharpeRatio": 7, "MDD": 7, "VaR": 7, "ES": 7}


def _evaluate(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The metrics are computed by this call, for which the tables' bars are kept: line items are sorted once, not for each table.
        kept = fixtures.first_bars(spark, sf_dir).persist()
        try:
            t = fixtures.tables_of(kept)
            return metrics.evaluate_all_metrics(t.y_true, t.y_pred, t.x_test, mode=mode).select(*(r(c, d) for c, d in DIGITS.items()))
        finally:
            kept.unpersist()

    return query


def window_count(spark, sf_dir):
    return windows.window_count(fixtures.bars(spark, sf_dir))


def window_count_non_rolling(spark, sf_dir):
    return windows.window_count(fixtures.bars(spark, sf_dir), rolling=False, step_size=None)


def stride_none(spark, sf_dir):
    w = windows.window_arrays(fixtures.bars(spark, sf_dir), rolling=False, step_size=None)
    return w.select("series_id", "start", F.size("close").alias("n_rows"))


def window_samples_long(spark, sf_dir, rolling=False, step_size=None):
    # A bar is rounded once, not in each window that it is in.
    bars = fixtures.bars(spark, sf_dir).withColumns({c: r(c, 2) for c in ("close", "volume")})
    return windows.window_rows(bars, rolling, step_size, dense=True).select("series_id", "start", F.col("pos").cast("int").alias("pos"), "close", "volume")


def window_split_xy(spark, sf_dir):
    w = windows.sample_windows(fixtures.bars(spark, sf_dir))
    total = F.aggregate("x.volume", F.lit(0.0), lambda a, v: a + v)
    return w.select("series_id", "start", F.size("x.close").alias("n_x"), F.size("y").alias("n_y"), F.round(F.element_at("x.close", 1), 2).alias("x_first"), F.round(F.element_at("x.close", -1), 2).alias("x_last"), F.round(total, 2).alias("x_volume"), F.round(F.element_at("y", 1), 2).alias("y_first"), F.round(F.element_at("y", -1), 2).alias("y_last"))


def sample_cap(spark, sf_dir):
    w = windows.sample_cap(fixtures.bars(spark, sf_dir), 500)
    return w.select("series_id", "start", F.round(F.element_at("y", -1), 2).alias("y_last"))


def _long(spark, sf_dir, rolling=False, step_size=None):
    w = windows.long_windows(fixtures.bars(spark, sf_dir), rolling, step_size)
    return w.where(F.col("pos") < 60)


KEYED = ("series_id", "start")


def _features(*names: str, pipeline, inverse: bool = False, digits: int = 6, nudge: float = 0.0):
    """Features of whole windows end to end in long form, or of the rolling windows block by block; both as rows."""

    def query(spark: SparkSession, sf_dir: str, rolling: bool = False, step_size: int | None = None) -> DataFrame:
        if rolling:
            of = partial(blocks.rounded, digits=digits, nudge=nudge)
            return blocks.rows(fixtures.bars(spark, sf_dir), pipeline, names, rolling, step_size, inverse=inverse, of=of, dense=True)
        out = pipeline.apply(_long(spark, sf_dir, rolling, step_size))
        out = pipeline.invert(out) if inverse else out
        return out.select(*KEYED, F.col("pos").cast("int").alias("pos"), *(F.round(F.col(c) + nudge, digits).alias(c) for c in names))

    return query


basic = features.BasicFeatures()
scaled = features.Standardise(["log_ret", "vol_delta"])
chain = features.Pipeline([basic, scaled])
vwap_chain = features.Pipeline([features.VwapFeatures(noise_std=0.0), features.Standardise(["vwap"])])


def standardisation_check(spark, sf_dir, rolling=False, step_size=None):
    names = ["log_ret", "vol_delta"]
    if rolling:
        s = blocks.standardisation(fixtures.bars(spark, sf_dir), chain, names, rolling, step_size, dense=True)
    else:
        s = features.standardisation(chain.apply(_long(spark, sf_dir, rolling, step_size)), names)
    near = lambda c, v: F.abs(F.col(c) - v) <= 1e-3
    return s.select(*KEYED, near("log_ret_m", 0).alias("log_ret_mean_ok"), near("log_ret_s", 1).alias("log_ret_scale_ok"), near("vol_delta_m", 0).alias("vol_delta_mean_ok"), near("vol_delta_s", 1).alias("vol_delta_scale_ok"))


def _indexed(spark, sf_dir, rolling=False, step_size=None):
    return windows.sample_windows(fixtures.bars(spark, sf_dir), rolling, step_size).select("series_id", "start", "sample_idx", "y")


def batch_assign(spark, sf_dir, rolling=False, step_size=None):
    return windows.batches(_indexed(spark, sf_dir, rolling, step_size), 32).select("series_id", "start", "sample_idx", "batch_id", "in_batch")


def batch_stack(spark, sf_dir, rolling=False, step_size=None):
    one = windows.batches(_indexed(spark, sf_dir, rolling, step_size), 32).withColumn("y_last", F.element_at("y", -1))
    s = windows.stack(one, "y_last")
    return s.select("batch_id", F.size("y_last").alias("n"), F.round(F.element_at("y_last", 1), 2).alias("first"), F.round(F.element_at("y_last", -1), 2).alias("last"))


def shard_round_robin(spark, sf_dir, rolling=False, step_size=None):
    return windows.shard(_indexed(spark, sf_dir, rolling, step_size), 1, 3).select("series_id", "start", "sample_idx")


def batch_cap(spark, sf_dir):
    return windows.first_batches(windows.batches(_indexed(spark, sf_dir), 32), 2).select("series_id", "start", "batch_id", "in_batch")


def preview(spark, sf_dir):
    return submission.preview(fixtures.tables(spark, sf_dir).x_test, 12, "window_id", "time_step").select("window_id", "time_step", r("close", 2))


def _string_times(spark, sf_dir):
    """Joined returns whose times are strings: some are no time, and the others are spelled in two ways."""
    t = fixtures.tables(spark, sf_dir)
    text = F.when(F.col("window_id") % 7 == 0, "not a time").when(F.col("window_id") % 2 == 0, F.date_format("event_datetime", "yyyy-MM-dd HH:mm:ss"))
    y_true = t.y_true.withColumn("event_datetime", text.otherwise(F.date_format("event_datetime", "yyyy-MM-dd'T'HH:mm:ss")))
    return returns.joined_returns(y_true, t.y_pred, t.x_test)


def ic_string_times(spark, sf_dir):
    ics = metrics.ic_by_timestamp(_string_times(spark, sf_dir))
    return ics.select(F.col("event_datetime").cast("timestamp_ntz").alias("event_datetime"), "n", r("ic"))


def strategies_string_times(spark, sf_dir):
    table = strategies.portfolio_table(_string_times(spark, sf_dir))
    return table.select(F.col("event_datetime").cast("timestamp_ntz").alias("event_datetime"), "n", *(r(c, 7) for c in strategies.NAMES))


def _edge_sections(spark, sf_dir):
    """A cross-section of each series of bars around every guard: sizes 2 to 22, missing and NaN sides, equal and negative
    predictions, ties."""
    g, i = F.col("series_id"), F.col("time_step")
    rows = fixtures.bars(spark, sf_dir).where(i < 2 + g % 21)
    p = F.when((g % 11 == 6) & (i == 2), F.lit(None)).when((g % 11 == 8) & (i == 3), F.lit("NaN").cast("double")).when(g % 11 == 9, 0.25).when(g % 11 == 10, -0.1 * (i + 1)).otherwise(F.floor(F.col("close") / 100) % 11 / 10 - 0.5)
    t = F.when((g % 11 == 7) & (i == 1), F.lit(None)).otherwise((F.col("volume") * 37 + F.col("close")) % 97 / 1000 - 0.0431)
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(series_id AS INT), 0)")
    return rows.select(at.alias("event_datetime"), nan_to_null(p.cast("double")).alias("pred_ret"), t.cast("double").alias("true_ret"))


def edge_sections(spark, sf_dir):
    return strategies.portfolio_table(_edge_sections(spark, sf_dir)).select("event_datetime", "n", *(r(c, 7) for c in strategies.NAMES))


def edge_ics(spark, sf_dir):
    # A correlation of 0 can come out on either side of it.
    return metrics.ic_by_timestamp(_edge_sections(spark, sf_dir)).select("event_datetime", "n", F.round(F.col("ic") + 1e-12, 8).alias("ic"))


def distinct_windows(spark, sf_dir):
    return submission.distinct_windows(fixtures.tables(spark, sf_dir).x_test)


def first_windows(spark, sf_dir):
    x = fixtures.bars(spark, sf_dir).withColumnRenamed("series_id", "window_id").withColumn("ordinal", F.col("close") * 100 + F.col("time_step"))
    return submission.first_windows(x, "ordinal", FIRST)


def select_windows_union(spark, sf_dir):
    return submission.select_windows(fixtures.tables(spark, sf_dir).x_test, FIRST, MUST)


def semi_filter(spark, sf_dir):
    t = fixtures.tables(spark, sf_dir)
    return submission.only_windows(t.y_true, submission.select_windows(t.x_test, FIRST, MUST)).select("window_id", "time_step", r("close", 2))


def isin_filter(spark, sf_dir):
    return submission.only_windows(fixtures.tables(spark, sf_dir).y_true, [1, 2]).select("window_id", "time_step", r("close", 2))


def anti_missing(spark, sf_dir):
    return submission.missing_windows(fixtures.tables(spark, sf_dir).x_test, MUST)


def steps_per_window(spark, sf_dir):
    return submission.steps_per_window(fixtures.tables(spark, sf_dir).y_pred)


def submission_validate(spark, sf_dir):
    y = fixtures.tables(spark, sf_dir).y_pred.where((F.col("window_id") % 5 != 0) | (F.col("time_step") < 9))
    return submission.violations(y, strict=True)


def submission_summary(spark, sf_dir):
    return submission.summary(fixtures.tables(spark, sf_dir).y_pred)


def timestamp_coerce(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    out = e.select("event_id", text.alias("event_datetime")).transform(strategies.with_event_time)
    return out.select("event_id", F.col("event_datetime").cast("timestamp_ntz").alias("event_datetime"))


def narrow_types(spark, sf_dir):
    from barlane.sources.schemas import narrow

    out = narrow(fixtures.tables(spark, sf_dir).y_pred)
    return out.select("window_id", F.col("time_step").cast("int").alias("time_step"), F.round(F.col("pred_close").cast("double"), 0).alias("pred_close"))


def linspace_source(spark, sf_dir):
    """As many evenly spaced prices and volumes as a series has bars, between its smallest and largest."""
    out = io.spaced(fixtures.bars(spark, sf_dir), ["series_id"], ["close", "volume"])
    return out.select("series_id", "time_step", r("close", 6), r("volume", 6))


def _forecast(model):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fixtures.tables(spark, sf_dir)
        return forecast.generate_forecast(model, t.x_test).select("window_id", "time_step", r("pred_close", 4))

    return query


def forecast_udf(spark, sf_dir):
    def mean_of_last(frame):
        import pandas as pd

        frame = frame.sort_values("time_step")
        return pd.DataFrame({"window_id": frame["window_id"].iloc[0], "time_step": range(10), "pred_close": frame["close"].tail(5).mean()})

    return _forecast(forecast.PerWindow(mean_of_last))(spark, sf_dir)


def streaming_windows(spark, sf_dir):
    """Windows of a stream of all bars, run to its end. Files come in three parts, in each of which some bars of the next are
    early and some of the one before are late, by less than the ten minutes that bars are waited for; a last row closes the stream.

    A part has no more files than a batch, so it is in two batches at most. The clock of the first counts from the second's end on,
    when all of the part's bars are there."""
    import uuid
    from datetime import timedelta

    from barlane.streaming.live_windows import live_windows

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    bars = fixtures.bars(spark, sf_dir).select("series_id", F.col("time_step").cast("long").alias("time_step"), "close", F.expr("timestamp_seconds(1704067200 + 60 * time_step)").alias("event_time"))
    comes = F.col("time_step") + F.pmod(F.xxhash64("series_id", "time_step"), F.lit(8))
    part = F.when(comes < 300, 0).when(comes < 600, 1).otherwise(2)
    for k in range(3):
        bars.where(part == k).coalesce(FILES).write.mode("append").parquet(f"{at}/in")
    end = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in bars.schema.fields[:3]), F.expr("timestamp '2200-01-01'").alias("event_time"))
    end.write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", FILES).parquet(f"{at}/in")
    out = live_windows(stream, told=timedelta(days=3650))
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").where(F.col("kind") == "window").select("series_id", "start", "last_input", "last_target")


def _rolling(query):
    def over_all(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir, rolling=True, step_size=1)

    return over_all


QUERIES = {
    "mse": mse,
    "mae": mae,
    "returns_base_literal": _base("literal"),
    "returns_base_contiguous": _base("contiguous"),
    "csm_series": _strategy("csm"),
    "lotq_series": _strategy("LOTQ"),
    "pw_series": _strategy("proportional"),
    "csm_series_contiguous": _strategy("CSM", "contiguous"),
    "lotq_series_contiguous": _strategy("LOTQ", "contiguous"),
    "pw_series_contiguous": _strategy("PW", "contiguous"),
    "sharpe": sharpe,
    "equity_curve": equity_curve,
    "max_drawdown": max_drawdown,
    "var_es": var_es,
    "ic_by_timestamp": ic_by_timestamp,
    "ic": ic,
    "ir": ir,
    "evaluate_all_metrics": _evaluate("literal"),
    "evaluate_all_metrics_contiguous": _evaluate("contiguous"),
    "window_count": window_count,
    "window_count_non_rolling": window_count_non_rolling,
    "stride_none": stride_none,
    "window_samples_long": window_samples_long,
    "window_split_xy": window_split_xy,
    "sample_cap": sample_cap,
    "log_ret": _features("log_ret", pipeline=basic),
    "vol_delta": _features("vol_delta", pipeline=basic),
    "rolling_vol": _features("rolling_vol", pipeline=basic),
    "basic_features": _features(*features.FEATURES, pipeline=basic),
    "vwap": _features("close", "volume", "vwap", pipeline=features.VwapFeatures(noise_std=0.0), digits=4, nudge=NUDGE),
    "zscore": _features("close", "volume", pipeline=features.Standardise(["close", "volume"])),
    "zscore_inverse": _features("close", "volume", pipeline=features.Standardise(["close", "volume"]), inverse=True),
    "feature_pipeline": _features(*features.FEATURES, pipeline=chain),
    "feature_pipeline_inverse": _features(*features.FEATURES, pipeline=chain, inverse=True),
    "vwap_pipeline": _features("close", "volume", "vwap", pipeline=vwap_chain),
    "standardisation_check": standardisation_check,
    "batch_assign": batch_assign,
    "batch_stack": batch_stack,
    "shard_round_robin": shard_round_robin,
    "batch_cap": batch_cap,
    "preview": preview,
    "ic_string_times": ic_string_times,
    "strategies_string_times": strategies_string_times,
    "edge_sections": edge_sections,
    "edge_ics": edge_ics,
    "distinct_windows": distinct_windows,
    "first_windows": first_windows,
    "select_windows_union": select_windows_union,
    "semi_filter": semi_filter,
    "isin_filter": isin_filter,
    "anti_missing": anti_missing,
    "steps_per_window": steps_per_window,
    "submission_validate": submission_validate,
    "submission_summary": submission_summary,
    "timestamp_coerce": timestamp_coerce,
    "narrow_types": narrow_types,
    "linspace_source": linspace_source,
    "forecast_persistence": _forecast(forecast.Persistence()),
    "forecast_drift": _forecast(forecast.Drift()),
    "forecast_ar1_diff": _forecast(forecast.AR1Diff()),
    "forecast_arima_110": _forecast(forecast.Arima((1, 1, 0))),
    "forecast_arima_211": _forecast(forecast.Arima((2, 1, 1))),
    "forecast_udf": forecast_udf,
    "streaming_windows": streaming_windows,
}

#: Queries over whole windows end to end. Each has a second one, NAME_rolling, over the rolling windows of stride 1 from
#: which training samples are made: all windows of all series, so every bar of a series that has a window.
QUERIES |= {f"{name}_rolling": _rolling(QUERIES[name]) for name in oracle.OVER_WINDOWS}
