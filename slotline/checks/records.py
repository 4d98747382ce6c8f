"""Nested report records as rows (section, name, value, text), each part beside the SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline import fixed
from slotline.checks import adapters as A
from slotline.checks.catalog import CATALOG
from slotline.checks.context import staged_slots
from slotline.checks.forecast import _DRIFT, drift_rows
from slotline.checks.live import _ALERTS, _alert_inputs
from slotline.checks.summary import _BANDED, _METRICS, _WEIGHTS
from slotline.operators import decide
from slotline.operators import evaluate as ev
from slotline.plans import reports

add = CATALOG.add

FEATURES = len(fixed.NUMERIC_FEATURES) + len(fixed.CATEGORICAL_FEATURES)
# The registry clips predictions to [0, 1] before it measures bands.
_CLIPPED = ", clipped AS (SELECT model, actual, least(1.0, greatest(0.0, predicted)) AS predicted FROM forecasts)" + _BANDED.replace("forecasts", "clipped")
_MET = f"met AS ({_METRICS}), met2 AS (SELECT * FROM met JOIN summed USING (model))"
_CUT = """span AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM (
  SELECT DISTINCT target_time_slot AS t FROM forecasts)) WHERE rn = greatest(1, floor(n*CAST(0.8 AS DOUBLE))))"""
_FIGURES = ("n", "mae", "rmse", "r2", "mape", "band_accuracy", "weighted_f1")
_METRIC_ROWS = " UNION ALL ".join(f"SELECT 'metric {c}' AS section, model AS name, CAST({c} AS DOUBLE) AS value, NULL AS text FROM met2" for c in _FIGURES)


def _after(ctes: str) -> str:
    return ctes.replace("WITH ", "", 1)


def _one(section, name, value=None, text=None):
    none = F.lit(None)
    return F.struct(
        F.lit(section).alias("section") if isinstance(section, str) else section.alias("section"),
        (F.lit(name) if isinstance(name, str) else name).cast("string").alias("name"),
        (none if value is None else value).cast("double").alias("value"),
        (none if text is None else text).cast("string").alias("text"),
    )


def _flat(record, parts):
    """One row per struct of ``parts``, which are structs or pairs (array of structs, True)."""
    arrays = [p[0] if isinstance(p, tuple) else F.array(p) for p in parts]
    return record.select(F.explode(F.concat(*arrays)).alias("r")).select("r.*")


def _metric_parts():
    return [(_metric_array(c), True) for c in _FIGURES]


def _metric_array(c):
    def row(m):
        return _one(f"metric {c}", m["model"], m[c])

    return F.transform("metrics", row)


def _metrics(spark, d):
    return ev.metrics_table(A.forecasts(spark, d), "actual", "predicted")


@add(
    "registry_record",
    A.final(
        f"""{_METRIC_ROWS}
UNION ALL SELECT 'champion', model, NULL, NULL FROM (SELECT model FROM met ORDER BY rmse, model LIMIT 1)
UNION ALL SELECT 'split', 'time', NULL, strftime(t, '%Y-%m-%d') FROM span
UNION ALL SELECT 'features', 'count', {FEATURES}, NULL
UNION ALL SELECT 'weight', model, weight, NULL FROM ({_WEIGHTS})
UNION ALL (SELECT 'drift', feature, psi, CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END
  FROM scores ORDER BY psi DESC, feature LIMIT 5)""",
        "value",
        "",
        f"{A.FORECAST_SQL}{_CLIPPED}, {_MET}, {_CUT}, {_after(_DRIFT)}",
    ),
)
def registry_record(spark, d):
    forecasts = A.forecasts(spark, d)
    weights = {r["model"]: r["weight"] for r in ev.ensemble_weights(forecasts, "actual", "predicted").collect()}
    cut = ev.split_time(forecasts).first()["split_time"]
    record = reports.registry_record(_metrics(spark, d), cut, weights, drift_rows(spark, d))
    return _flat(
        record,
        [
            *_metric_parts(),
            _one("champion", F.col("champion_model")),
            _one("split", "time", None, F.date_format("train_test_split_time", "yyyy-MM-dd")),
            _one("features", "count", F.col("feature_count")),
            (F.transform(F.map_entries("ensemble_weights"), lambda e: _one("weight", e["key"], e["value"])), True),
            (F.transform("drift_summary", lambda x: _one("drift", x["feature"], x["psi"], x["drift_level"])), True),
        ],
    )


@add(
    "project_summary",
    A.final(
        """SELECT 'data' AS section, 'rows' AS name, CAST((SELECT count(*) FROM stressed) AS DOUBLE) AS value, NULL AS text
UNION ALL SELECT 'data', 'systems', (SELECT count(DISTINCT system_code) FROM stressed), NULL
UNION ALL SELECT 'data', 'avg_utilization', (SELECT avg(utilization) FROM stressed), NULL
UNION ALL SELECT 'best', model, rmse, NULL FROM (SELECT model, rmse FROM met ORDER BY rmse, model LIMIT 1)
UNION ALL SELECT 'best mae', model, mae, NULL FROM (SELECT model, mae, rmse FROM met ORDER BY rmse, model LIMIT 1)
UNION ALL SELECT 'split', 'time', NULL, strftime(t, '%Y-%m-%d') FROM span
UNION ALL SELECT 'horizon', model, rmse, NULL FROM met
UNION ALL SELECT 'top', CAST(system_code AS VARCHAR), NULL, NULL FROM (SELECT system_code FROM scored ORDER BY balanced_score DESC, system_code LIMIT 1)""",
        "value",
        "",
        f"{A.with_ctes('stressed')}, {_after(A.FORECAST_SQL)}, met AS ({_METRICS}), {_CUT}, {_after(A.BOARD_SQL)}",
    ),
)
def project_summary(spark, d):
    metrics = _metrics(spark, d)
    horizons = metrics.select(F.col("model").alias("forecast_horizon"), "rmse")
    board = decide.recommend(A.board(spark, d), ordered=False)
    cut = ev.split_time(A.forecasts(spark, d)).first()["split_time"]
    record = reports.project_summary(staged_slots(spark, d), metrics, horizons, board, cut)
    data = F.col("dataset_summary")
    return _flat(
        record,
        [
            *[_one("data", c, data[c]) for c in ("rows", "systems", "avg_utilization")],
            _one("best", F.col("best_model"), F.col("best_rmse")),
            _one("best mae", F.col("best_model"), F.col("best_mae")),
            _one("split", "time", None, F.date_format("split_time", "yyyy-MM-dd")),
            (F.transform(F.map_entries("multi_horizon_best_rmse"), lambda e: _one("horizon", e["key"], e["value"])), True),
            _one("top", F.col("top_recommendation")),
        ],
    )


@add(
    "ops_summary",
    A.final(
        """SELECT 'drift' AS section, 'max_psi' AS name, max(psi) AS value,
    CASE WHEN max(psi) >= 0.25 THEN 'critical' WHEN max(psi) >= 0.1 THEN 'warning' ELSE 'stable' END AS text FROM scores
UNION ALL SELECT 'drift', 'features', count(*), NULL FROM scores
UNION ALL (SELECT 'top drift', feature, psi, NULL FROM scores ORDER BY psi DESC, feature LIMIT 5)
UNION ALL SELECT 'alert', category, NULL, message FROM alerts
UNION ALL SELECT 'alert count', s, (SELECT count(*) FROM alerts WHERE severity = s), NULL FROM (SELECT unnest(['critical', 'warning', 'info']) AS s)
UNION ALL (SELECT 'watch', CAST(system_code AS VARCHAR), predicted_utilization_1h, risk_band FROM scored
  ORDER BY predicted_utilization_1h DESC, system_code LIMIT 5)
UNION ALL (SELECT 'option', CAST(system_code AS VARCHAR), predicted_utilization_1h, risk_band FROM scored ORDER BY balanced_score DESC, system_code LIMIT 5)
UNION ALL (SELECT 'job', CAST(job_id AS VARCHAR), NULL, status FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 10)
UNION ALL (SELECT 'retrain', CAST(job_id AS VARCHAR), NULL, status FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 1)
UNION ALL SELECT 'champion', model, rmse, NULL FROM (SELECT model, rmse FROM met ORDER BY rmse, model LIMIT 1)""",
        "value",
        "",
        f"{_ALERTS}, {_after(A.FORECAST_SQL)}, met AS ({_METRICS})",
    ),
)
def ops_summary(spark, d):
    record = reports.ops_summary(*_alert_inputs(spark, d), metrics=_metrics(spark, d))

    def listed(column, section, name, value=None, text=None):
        def row(x):
            return _one(section, x[name], x[value] if value else None, x[text] if text else None)

        return F.transform(column, row), True

    drift, champion = F.col("drift_overview"), F.col("champion")
    return _flat(
        record,
        [
            _one("drift", "max_psi", drift["max_psi"], drift["severity"]),
            _one("drift", "features", drift["features_monitored"]),
            listed("top_drift_features", "top drift", "feature", "psi"),
            listed("alerts", "alert", "category", None, "message"),
            listed("alert_counts", "alert count", "severity", "n"),
            listed("critical_watchlist", "watch", "system_code", "predicted_utilization_1h", "risk_band"),
            listed("recommended_alternatives", "option", "system_code", "predicted_utilization_1h", "risk_band"),
            listed("retrain_jobs", "job", "job_id", None, "status"),
            _one("retrain", F.col("retrain_status")["job_id"], None, F.col("retrain_status")["status"]),
            _one("champion", champion["model"], champion["rmse"]),
        ],
    )
