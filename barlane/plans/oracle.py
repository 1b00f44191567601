"""The engine's queries in DuckDB SQL."""

from __future__ import annotations

BARS = """
bars AS MATERIALIZED (
    SELECT l_suppkey AS series_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS time_step,
           l_extendedprice AS close, l_quantity AS volume
    FROM lineitem
)"""
TABLES = f"""{BARS}, x_test AS (
    SELECT series_id AS window_id, time_step, close, volume FROM bars WHERE time_step < 60
), y_true AS (
    SELECT series_id AS window_id, CAST(time_step - 60 AS INTEGER) AS time_step, close, TIMESTAMP '2024-01-01' + to_minutes(CAST(time_step - 60 AS INTEGER)) AS event_datetime
    FROM bars WHERE time_step BETWEEN 60 AND 69
), y_pred AS (
    SELECT y.window_id, y.time_step, x.close * (1 + 0.001::DOUBLE * (y.time_step + 1) * (y.window_id % 7 - 3)) AS pred_close
    FROM y_true y JOIN x_test x ON x.window_id = y.window_id AND x.time_step = 59
)"""


def _returns(mode: str) -> str:
    shift = 60 if mode == "contiguous" else 0
    return f"""{TABLES}, prices AS (
    SELECT window_id, time_step, close AS price, 0 AS seg FROM x_test
    UNION ALL SELECT window_id, time_step + {shift}, close, 1 FROM y_true
), prev AS (
    SELECT * FROM (SELECT window_id, time_step - {shift} AS time_step, lag(price) OVER (PARTITION BY window_id ORDER BY time_step, seg) AS prev_price FROM prices) WHERE prev_price IS NOT NULL
), tr AS (
    SELECT y.*, prev_price, close / (prev_price + 1e-12) - 1 AS true_ret FROM y_true y JOIN prev USING (window_id, time_step)
), pr AS (
    SELECT window_id, time_step, pred_close / (prev_price + 1e-12) - 1 AS pred_ret FROM y_pred JOIN prev USING (window_id, time_step)
), merged AS MATERIALIZED (
    SELECT tr.*, pr.pred_ret FROM tr JOIN pr USING (window_id, time_step)
)"""


def _table(mode: str) -> str:
    return f"""{_returns(mode)}, cuts AS (
    SELECT event_datetime, count(*) AS n, quantile_cont(pred_ret, 0.1) AS lo, quantile_cont(pred_ret, 0.8) AS mid, quantile_cont(pred_ret, 0.9) AS hi
    FROM merged GROUP BY event_datetime HAVING count(*) >= 3
), portfolio AS (
    SELECT event_datetime,
           CASE WHEN any_value(n) >= 20 THEN coalesce(avg(true_ret) FILTER (WHERE pred_ret >= hi) - avg(true_ret) FILTER (WHERE pred_ret <= lo), 0) ELSE 0 END AS csm,
           CASE WHEN any_value(n) >= 5 THEN coalesce(avg(true_ret) FILTER (WHERE pred_ret >= mid), 0) ELSE 0 END AS lotq,
           CASE WHEN sum(greatest(pred_ret, 0)) > 0 THEN sum(greatest(pred_ret, 0) * true_ret) / sum(greatest(pred_ret, 0)) ELSE 0 END AS pw
    FROM merged JOIN cuts USING (event_datetime) GROUP BY event_datetime
), series AS (
    SELECT event_datetime, 'CSM' AS strategy, csm AS ret FROM portfolio
    UNION ALL SELECT event_datetime, 'LOTQ', lotq FROM portfolio
    UNION ALL SELECT event_datetime, 'PW', pw FROM portfolio
)"""


def _risk(mode: str) -> str:
    return f"""{_table(mode)}, curve AS (
    SELECT *, max(equity) OVER w AS peak FROM (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY event_datetime) AS equity FROM series)
    WINDOW w AS (PARTITION BY strategy ORDER BY event_datetime)
), var_ AS (
    SELECT strategy, quantile_cont(ret, 0.05) AS var FROM series GROUP BY strategy
), es_ AS (
    SELECT strategy, any_value(var) AS var, coalesce(avg(ret) FILTER (WHERE ret <= var), any_value(var)) AS es FROM series JOIN var_ USING (strategy) GROUP BY strategy
), sharpe_ AS (
    SELECT strategy, avg(ret) / (stddev_pop(ret) + 1e-12) AS sharpe FROM series GROUP BY strategy
), mdd_ AS (
    SELECT strategy, max((peak - equity) / (peak + 1e-12)) AS mdd FROM curve GROUP BY strategy
)"""


def _ics(mode: str) -> str:
    return f"""ranked AS (
    SELECT event_datetime, n,
           rank() OVER (PARTITION BY event_datetime ORDER BY pred_ret) + (count(*) OVER (PARTITION BY event_datetime, pred_ret) - 1) / 2.0 AS a,
           rank() OVER (PARTITION BY event_datetime ORDER BY true_ret) + (count(*) OVER (PARTITION BY event_datetime, true_ret) - 1) / 2.0 AS b
    FROM (SELECT *, count(*) OVER (PARTITION BY event_datetime) AS n FROM merged) WHERE n >= 3
), ics AS (
    SELECT * FROM (SELECT event_datetime, any_value(n) AS n, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM ranked GROUP BY event_datetime) WHERE ic IS NOT NULL
)"""


def _with(body: str, select: str) -> str:
    return f"WITH {body}\n{select}"


ERRORS = "SELECT avg((close - pred_close) * (close - pred_close)) AS mse, avg(abs(close - pred_close)) AS mae FROM y_true JOIN y_pred USING (window_id, time_step)"


def _evaluate(mode: str) -> str:
    return _with(
        f"{_risk(mode)}, {_ics(mode)}, e AS ({ERRORS})",
        """SELECT round(mse, 2) AS "MSE", round(mae, 5) AS "MAE",
       round((SELECT coalesce(avg(ic), 0) FROM ics), 8) AS "IC",
       round((SELECT CASE WHEN count(ic) < 2 THEN 0 ELSE avg(ic) / (stddev_pop(ic) + 1e-12) END FROM ics), 6) AS "IR",
       round((SELECT avg(sharpe) FROM sharpe_), 7) AS "SharpeRatio", round((SELECT avg(mdd) FROM mdd_), 7) AS "MDD",
       round((SELECT avg(var) FROM es_), 7) AS "VaR", round((SELECT avg(es) FROM es_), 7) AS "ES"
FROM e""",
    )


SIZED = f"{BARS}, sized AS (SELECT series_id, count(*) AS n FROM bars GROUP BY series_id HAVING count(*) >= 70)"
STARTS_70 = f"{SIZED}, starts AS (SELECT series_id, unnest(range(0, n - 69, 70)) AS start FROM sized)"
STARTS_1 = f"{SIZED}, starts AS (SELECT series_id, unnest(range(0, n - 69)) AS start FROM sized)"
LONG = f"""{STARTS_70}, long AS (
    SELECT s.series_id, s.start, CAST(b.time_step - s.start AS INTEGER) AS pos, b.close, b.volume
    FROM starts s JOIN bars b ON b.series_id = s.series_id AND b.time_step BETWEEN s.start AND s.start + 69
), input AS (SELECT * FROM long WHERE pos < 60)"""
FEATURES = f"""{LONG}, first AS (
    SELECT *, CASE WHEN pos = 0 THEN 0 ELSE ln(close + 1e-6) - ln(lag(close) OVER w + 1e-6) END AS log_ret,
           CASE WHEN pos = 0 THEN 0 ELSE volume - lag(volume) OVER w END AS vol_delta
    FROM input WINDOW w AS (PARTITION BY series_id, start ORDER BY pos)
), features AS (
    SELECT *, stddev_pop(log_ret) OVER (PARTITION BY series_id, start ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_vol FROM first
)"""
VWAP = f"""{LONG}, moved AS (SELECT series_id, start, pos, close + 3.0::DOUBLE AS close, volume + 1.0::DOUBLE AS volume FROM input
), vwaps AS (
    SELECT *, sum(close * volume) OVER w / sum(volume) OVER w AS vwap FROM moved
    WINDOW w AS (PARTITION BY series_id, start ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def _z(c: str) -> str:
    return f"({c} - avg({c}) OVER w) / (CASE WHEN stddev_pop({c}) OVER w = 0 THEN 1 ELSE stddev_pop({c}) OVER w END)"


def _rounded(*names: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


def _nudged(*names: str) -> str:
    return ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in names)


SCALED = f"{FEATURES}, scaled AS (SELECT series_id, start, pos, close, volume, {_z('log_ret')} AS log_ret, {_z('vol_delta')} AS vol_delta, rolling_vol FROM features WINDOW w AS (PARTITION BY series_id, start))"
INDEXED = f"{STARTS_70}, indexed AS (SELECT series_id, start, row_number() OVER (ORDER BY series_id, start) - 1 AS sample_idx FROM starts)"
FIVE = ("close", "volume", "log_ret", "vol_delta", "rolling_vol")
AT = "SELECT series_id, start, pos, "
CHOSEN = f"{TABLES}, chosen AS (SELECT window_id FROM (SELECT DISTINCT window_id FROM x_test ORDER BY window_id LIMIT 25) UNION SELECT DISTINCT window_id FROM x_test WHERE window_id IN (1, 2, 9000000))"
AR1 = f"""{TABLES}, d AS (
    SELECT *, close - lag(close) OVER (PARTITION BY window_id ORDER BY time_step) AS d FROM x_test
), d2 AS (
    SELECT *, lag(d) OVER (PARTITION BY window_id ORDER BY time_step) AS d1 FROM d
), fit AS (
    SELECT window_id, max_by(close, time_step) AS last, max_by(d, time_step) AS d, coalesce(sum(d * d1) / nullif(sum(d1 * d1), 0), 0) AS phi FROM d2 GROUP BY window_id
)"""
STEP = "unnest(range(10))"


def _series(column: str, mode: str = "literal") -> str:
    return _with(_table(mode), f"SELECT event_datetime, round({column}, 7) AS ret FROM portfolio")


def _base(mode: str) -> str:
    return _with(_returns(mode), "SELECT window_id, time_step, event_datetime, round(close, 2) AS close, round(prev_price, 2) AS prev_price, round(true_ret, 8) AS true_ret, round(pred_ret, 8) AS pred_ret FROM merged")


def _forecast(body: str, value: str, source: str) -> str:
    return _with(body, f"SELECT window_id, CAST(time_step AS INTEGER) AS time_step, round({value}, 4) AS pred_close FROM (SELECT *, {STEP} AS time_step FROM {source})")


STRING_TIMES = f"""{_returns("literal").replace("merged AS MATERIALIZED (", "spelled AS MATERIALIZED (")}, merged AS (
    SELECT * REPLACE (try_cast(CASE WHEN window_id % 7 = 0 THEN 'not a time' WHEN window_id % 2 = 0 THEN strftime(event_datetime, '%Y-%m-%d %H:%M:%S') ELSE strftime(event_datetime, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS event_datetime)
    FROM spelled WHERE window_id % 7 <> 0
)"""
EDGE = f"""{BARS}, merged AS MATERIALIZED (
    SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(g AS INTEGER)) AS event_datetime,
           CASE WHEN g % 11 = 6 AND i = 2 OR g % 11 = 8 AND i = 3 THEN NULL WHEN g % 11 = 9 THEN 0.25::DOUBLE WHEN g % 11 = 10 THEN -0.1::DOUBLE * (i + 1)
                ELSE CAST(floor(close / 100) AS BIGINT) % 11 / 10 - 0.5 END AS pred_ret,
           CASE WHEN g % 11 = 7 AND i = 1 THEN NULL ELSE (volume * 37 + close) % 97 / 1000 - 0.0431::DOUBLE END AS true_ret
    FROM (SELECT series_id AS g, time_step AS i, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume FROM bars WHERE time_step < 2 + series_id % 21)
)"""
#: Cross-sections with the rules for missing sides.
GUARDED = """cuts AS (
    SELECT event_datetime, count(*) AS n, count(pred_ret) AS np, count(true_ret) AS nr, quantile_cont(pred_ret, 0.1) AS lo, quantile_cont(pred_ret, 0.8) AS mid, quantile_cont(pred_ret, 0.9) AS hi
    FROM merged GROUP BY event_datetime HAVING count(*) >= 3
)
SELECT event_datetime, any_value(n) AS n,
       round(CASE WHEN any_value(n) >= 20 AND any_value(np) = any_value(n) THEN coalesce(avg(true_ret) FILTER (WHERE pred_ret >= hi) - avg(true_ret) FILTER (WHERE pred_ret <= lo), 0) ELSE 0 END, 7) AS "CSM",
       round(CASE WHEN any_value(n) >= 5 AND any_value(np) = any_value(n) THEN coalesce(avg(true_ret) FILTER (WHERE pred_ret >= mid), 0) ELSE 0 END, 7) AS "LOTQ",
       round(CASE WHEN any_value(np) = any_value(n) AND any_value(nr) = any_value(n) AND sum(greatest(pred_ret, 0)) > 0 THEN sum(greatest(pred_ret, 0) * true_ret) / sum(greatest(pred_ret, 0)) ELSE 0 END, 7) AS "PW"
FROM merged JOIN cuts USING (event_datetime) GROUP BY event_datetime"""
#: The same for rank correlations: sizes count all rows, ranks only pairs.
PAIRED_ICS = """sized AS (SELECT *, count(*) OVER (PARTITION BY event_datetime) AS n FROM merged), ranked AS (
    SELECT event_datetime, n,
           rank() OVER (PARTITION BY event_datetime ORDER BY pred_ret) + (count(*) OVER (PARTITION BY event_datetime, pred_ret) - 1) / 2.0 AS a,
           rank() OVER (PARTITION BY event_datetime ORDER BY true_ret) + (count(*) OVER (PARTITION BY event_datetime, true_ret) - 1) / 2.0 AS b
    FROM sized WHERE n >= 3 AND pred_ret IS NOT NULL AND true_ret IS NOT NULL
)
SELECT event_datetime, n, round(ic + 1e-12, 8) AS ic FROM (SELECT event_datetime, any_value(n) AS n, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM ranked GROUP BY event_datetime) WHERE ic IS NOT NULL"""
ENDS = f"{TABLES}, ends AS (SELECT window_id, max_by(close, time_step) AS last, min_by(close, time_step) AS first, count(*) AS n FROM x_test GROUP BY window_id)"

SQL = {
    "mse": _with(TABLES, f"SELECT round(mse, 2) AS mse FROM ({ERRORS})"),
    "mae": _with(TABLES, f"SELECT round(mae, 5) AS mae FROM ({ERRORS})"),
    "returns_base_literal": _base("literal"),
    "returns_base_contiguous": _base("contiguous"),
    "csm_series": _series("csm"),
    "lotq_series": _series("lotq"),
    "pw_series": _series("pw"),
    "csm_series_contiguous": _series("csm", "contiguous"),
    "lotq_series_contiguous": _series("lotq", "contiguous"),
    "pw_series_contiguous": _series("pw", "contiguous"),
    "sharpe": _with(_risk("literal"), "SELECT strategy, round(sharpe, 7) AS sharpe FROM sharpe_"),
    "equity_curve": _with(_risk("literal"), "SELECT event_datetime, strategy, round(ret, 7) AS ret, round(ln(abs(equity) + 1), 6) AS log_equity, round(ln(abs(peak) + 1), 6) AS log_peak FROM curve"),
    "max_drawdown": _with(_risk("literal"), "SELECT strategy, round(mdd, 7) AS mdd FROM mdd_"),
    "var_es": _with(_risk("literal"), "SELECT strategy, round(var, 7) AS var, round(es, 7) AS es FROM es_"),
    "ic_by_timestamp": _with(f"{_returns('literal')}, {_ics('literal')}", "SELECT event_datetime, n, round(ic, 8) AS ic FROM ics"),
    "ic": _with(f"{_returns('literal')}, {_ics('literal')}", "SELECT round(coalesce(avg(ic), 0), 8) AS ic FROM ics"),
    "ir": _with(f"{_returns('literal')}, {_ics('literal')}", "SELECT round(CASE WHEN count(ic) < 2 THEN 0 ELSE avg(ic) / (stddev_pop(ic) + 1e-12) END, 6) AS ir FROM ics"),
    "evaluate_all_metrics": _evaluate("literal"),
    "evaluate_all_metrics_contiguous": _evaluate("contiguous"),
    "window_count": _with(SIZED, "SELECT CAST(sum((n - 70) // 1 + 1) AS BIGINT) AS n_windows FROM sized"),
    "window_count_non_rolling": _with(SIZED, "SELECT CAST(sum(n // 70) AS BIGINT) AS n_windows FROM sized"),
    "stride_none": _with(STARTS_70, "SELECT series_id, start, 70 AS n_rows FROM starts"),
    "window_samples_long": _with(LONG, "SELECT series_id, start, pos, round(close, 2) AS close, round(volume, 2) AS volume FROM long"),
    "window_split_xy": _with(
        f"{STARTS_1}, long AS (SELECT s.series_id, s.start, b.time_step - s.start AS pos, b.close, b.volume FROM starts s JOIN bars b ON b.series_id = s.series_id AND b.time_step BETWEEN s.start AND s.start + 69)",
        """SELECT series_id, start, CAST(count(*) FILTER (WHERE pos < 60) AS INTEGER) AS n_x, CAST(count(*) FILTER (WHERE pos >= 60) AS INTEGER) AS n_y,
       round(max(close) FILTER (WHERE pos = 0), 2) AS x_first, round(max(close) FILTER (WHERE pos = 59), 2) AS x_last, round(sum(volume) FILTER (WHERE pos < 60), 2) AS x_volume,
       round(max(close) FILTER (WHERE pos = 60), 2) AS y_first, round(max(close) FILTER (WHERE pos = 69), 2) AS y_last
FROM long GROUP BY series_id, start""",
    ),
    "sample_cap": _with(STARTS_1, "SELECT s.series_id, s.start, round(b.close, 2) AS y_last FROM (SELECT * FROM starts ORDER BY series_id, start LIMIT 500) s JOIN bars b ON b.series_id = s.series_id AND b.time_step = s.start + 69"),
    "log_ret": _with(FEATURES, f"{AT}{_rounded('log_ret')} FROM features"),
    "vol_delta": _with(FEATURES, f"{AT}{_rounded('vol_delta')} FROM features"),
    "rolling_vol": _with(FEATURES, f"{AT}{_rounded('rolling_vol')} FROM features"),
    "basic_features": _with(FEATURES, f"{AT}{_rounded(*FIVE)} FROM features"),
    "vwap": _with(VWAP, f"{AT}{_nudged('close', 'volume', 'vwap')} FROM vwaps"),
    "zscore": _with(f"{LONG}, z AS (SELECT series_id, start, pos, {_z('close')} AS close, {_z('volume')} AS volume FROM input WINDOW w AS (PARTITION BY series_id, start))", f"{AT}{_rounded('close', 'volume')} FROM z"),
    "zscore_inverse": _with(LONG, f"{AT}{_rounded('close', 'volume')} FROM input"),
    "feature_pipeline": _with(SCALED, f"{AT}{_rounded(*FIVE)} FROM scaled"),
    "feature_pipeline_inverse": _with(FEATURES, f"{AT}{_rounded(*FIVE)} FROM features"),
    "vwap_pipeline": _with(f"{VWAP}, z AS (SELECT series_id, start, pos, close, volume, {_z('vwap')} AS vwap FROM vwaps WINDOW w AS (PARTITION BY series_id, start))", f"{AT}{_rounded('close', 'volume', 'vwap')} FROM z"),
    "standardisation_check": _with(
        SCALED,
        """SELECT series_id, start, abs(avg(log_ret)) <= 1e-3 AS log_ret_mean_ok, abs(stddev_pop(log_ret) - 1) <= 1e-3 AS log_ret_scale_ok,
       abs(avg(vol_delta)) <= 1e-3 AS vol_delta_mean_ok, abs(stddev_pop(vol_delta) - 1) <= 1e-3 AS vol_delta_scale_ok
FROM scaled GROUP BY series_id, start""",
    ),
    "batch_assign": _with(INDEXED, "SELECT series_id, start, sample_idx, sample_idx // 32 AS batch_id, sample_idx % 32 AS in_batch FROM indexed"),
    "batch_stack": _with(
        INDEXED,
        """SELECT sample_idx // 32 AS batch_id, CAST(count(*) AS INTEGER) AS n, round(min_by(close, sample_idx), 2) AS first, round(max_by(close, sample_idx), 2) AS last
FROM indexed i JOIN bars b ON b.series_id = i.series_id AND b.time_step = i.start + 69 GROUP BY ALL""",
    ),
    "shard_round_robin": _with(INDEXED, "SELECT series_id, start, sample_idx FROM indexed WHERE sample_idx % 3 = 1"),
    "batch_cap": _with(INDEXED, "SELECT series_id, start, sample_idx // 32 AS batch_id, sample_idx % 32 AS in_batch FROM indexed WHERE sample_idx < 64"),
    "preview": _with(TABLES, "SELECT window_id, CAST(time_step AS INTEGER) AS time_step, round(close, 2) AS close FROM x_test ORDER BY window_id, time_step LIMIT 12"),
    "ic_string_times": _with(f"{STRING_TIMES}, {_ics('literal')}", "SELECT event_datetime, n, round(ic, 8) AS ic FROM ics"),
    "strategies_string_times": _with(STRING_TIMES, f", {GUARDED}"),
    "edge_sections": _with(EDGE, f", {GUARDED}"),
    "edge_ics": _with(EDGE, f", {PAIRED_ICS}"),
    "distinct_windows": _with(TABLES, "SELECT DISTINCT window_id FROM x_test"),
    "first_windows": _with(BARS, "SELECT series_id AS window_id FROM bars GROUP BY series_id ORDER BY min(close * 100 + time_step), series_id LIMIT 25"),
    "select_windows_union": _with(CHOSEN, "SELECT window_id FROM chosen"),
    "semi_filter": _with(CHOSEN, "SELECT window_id, time_step, round(close, 2) AS close FROM y_true WHERE window_id IN (SELECT window_id FROM chosen)"),
    "isin_filter": _with(TABLES, "SELECT window_id, time_step, round(close, 2) AS close FROM y_true WHERE window_id IN (1, 2)"),
    "anti_missing": _with(TABLES, "SELECT CAST(w AS BIGINT) AS window_id FROM (VALUES (1), (2), (9000000)) v(w) WHERE w NOT IN (SELECT window_id FROM x_test)"),
    "steps_per_window": _with(TABLES, "SELECT window_id, count(*) AS n_rows, count(DISTINCT time_step) AS n_steps, min(time_step) AS first_step, max(time_step) AS last_step FROM y_pred GROUP BY window_id"),
    "submission_validate": _with(
        TABLES,
        """SELECT window_id, count(*) AS n_rows, count(DISTINCT time_step) AS n_steps, min(time_step) AS first_step, max(time_step) AS last_step
FROM y_pred WHERE window_id % 5 <> 0 OR time_step < 9 GROUP BY window_id
HAVING count(DISTINCT time_step) <> 10 OR count(*) <> 10 OR min(time_step) <> 0 OR max(time_step) <> 9""",
    ),
    "submission_summary": _with(TABLES, "SELECT count(*) AS n_rows, count(DISTINCT window_id) AS n_windows FROM y_pred"),
    "timestamp_coerce": "SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS event_datetime FROM events",
    "narrow_types": _with(TABLES, "SELECT CAST(window_id AS INTEGER) AS window_id, time_step, round(CAST(CAST(pred_close AS FLOAT) AS DOUBLE), 0) AS pred_close FROM y_pred"),
    "linspace_source": _with(
        f"{BARS}, bounds AS (SELECT series_id, count(*) AS n, min(close) AS c0, max(close) AS c1, min(volume) AS v0, max(volume) AS v1 FROM bars GROUP BY series_id)",
        """SELECT series_id, time_step, round(c0 + time_step * ((c1 - c0) / greatest(n - 1, 1)), 6) AS close, round(v0 + time_step * ((v1 - v0) / greatest(n - 1, 1)), 6) AS volume
FROM (SELECT *, unnest(range(0, n)) AS time_step FROM bounds)""",
    ),
    "forecast_persistence": _forecast(ENDS, "last", "ends"),
    "forecast_drift": _forecast(ENDS, "last + (time_step + 1) * (last - first) / (n - 1)", "ends"),
    "forecast_udf": _with(TABLES, "SELECT window_id, CAST(time_step AS INTEGER) AS time_step, round(pred_close, 4) AS pred_close FROM (SELECT window_id, avg(close) AS pred_close, unnest(range(10)) AS time_step FROM x_test WHERE time_step >= 55 GROUP BY window_id)"),
    "streaming_windows": _with(STARTS_1, "SELECT s.series_id, s.start, a.close AS last_input, b.close AS last_target FROM starts s JOIN bars a ON a.series_id = s.series_id AND a.time_step = s.start + 59 JOIN bars b ON b.series_id = s.series_id AND b.time_step = s.start + 69"),
    "forecast_ar1_diff": _forecast(AR1, "last + d * list_sum(list_transform(range(1, time_step + 2), lambda k: pow(phi, k)))", "fit"),
}

#: Queries over windows end to end; NAME_rolling is the same statement over the starts of stride 1.
OVER_WINDOWS = (
    "window_samples_long", "log_ret", "vol_delta", "rolling_vol", "basic_features", "vwap", "zscore", "zscore_inverse", "feature_pipeline",
    "feature_pipeline_inverse", "vwap_pipeline", "standardisation_check", "batch_assign", "batch_stack", "shard_round_robin",
)
SQL |= {f"{name}_rolling": SQL[name].replace(STARTS_70, STARTS_1) for name in OVER_WINDOWS}
