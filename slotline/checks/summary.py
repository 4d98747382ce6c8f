"""Summaries, views, boards, logs and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline import fixed
from slotline.checks import adapters as A
from slotline.checks.catalog import CATALOG
from slotline.checks.series import enriched, slots
from slotline.operators import activity, decide, profile
from slotline.operators import evaluate as ev

add = CATALOG.add


def scored(spark, d):
    return decide.score_board(A.board(spark, d))


# --- slot summaries ---------------------------------------------------------


@add(
    "dataset_summary",
    A.final(
        """SELECT count(*) AS rows, 40 AS columns, count(DISTINCT system_code) AS systems,
      min(time_slot) AS date_start, max(time_slot) AS date_end, sum(occupancy_anomaly_flag) AS anomaly_rows,
      avg(utilization) AS avg_utilization, avg(queue_length) AS avg_queue_length FROM stressed""",
        "avg_utilization avg_queue_length",
        "rows columns systems anomaly_rows",
        A.with_ctes("stressed"),
    ),
)
def dataset_summary(spark, d):
    # Over the full clean table; Spark drops the window columns that the summary does not read.
    return profile.dataset_summary(slots(spark, d))


_PROFILE_D = (
    "latitude longitude mean_occupancy max_occupancy mean_utilization std_utilization mean_queue_length "
    "high_traffic_ratio special_day_ratio average_stress"
)


@add(
    "site_profiles",
    A.final(
        """SELECT system_code, avg(latitude) AS latitude, avg(longitude) AS longitude, max(capacity) AS capacity,
      avg(occupancy_clean) AS mean_occupancy, max(occupancy_clean) AS max_occupancy,
      avg(utilization) AS mean_utilization, coalesce(stddev_samp(utilization), 0) AS std_utilization,
      avg(queue_length) AS mean_queue_length,
      avg(CASE WHEN traffic_level = 2 THEN 1.0 ELSE 0.0 END) AS high_traffic_ratio,
      avg(is_special_day) AS special_day_ratio, avg(parking_stress_index) AS average_stress
      FROM stressed GROUP BY system_code""",
        _PROFILE_D,
        "capacity",
        A.with_ctes("stressed"),
    ),
)
def site_profiles(spark, d):
    return profile.site_profiles(enriched(spark, d))


@add(
    "daily_summary",
    A.final(
        """SELECT system_code, CAST(time_slot AS DATE) AS summary_date, avg(utilization) AS avg_utilization,
      max(utilization) AS max_utilization, avg(queue_length) AS avg_queue_length,
      sum(occupancy_anomaly_flag) AS anomaly_rows FROM stressed GROUP BY ALL""",
        "avg_utilization max_utilization avg_queue_length",
        "anomaly_rows",
        A.with_ctes("stressed"),
    ),
)
def daily_summary(spark, d):
    return profile.daily_summary(enriched(spark, d))


@add(
    "peak_periods",
    A.final(
        "SELECT system_code, hour, avg(utilization) AS avg_utilization, avg(queue_length) AS avg_queue_length "
        "FROM stressed GROUP BY ALL",
        "avg_utilization avg_queue_length",
        "hour",
        A.with_ctes("stressed"),
    ),
)
def peak_periods(spark, d):
    return profile.peak_periods(enriched(spark, d))


_HOURS = [f"h{h:02d}" for h in range(24)]


@add(
    "hour_pivot",
    A.final(
        "SELECT system_code, "
        + ", ".join(f"avg(utilization) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
        + " FROM stressed GROUP BY system_code",
        " ".join(_HOURS),
        "",
        A.with_ctes("stressed"),
    ),
)
def hour_pivot(spark, d):
    return profile.hour_pivot(enriched(spark, d))


@add(
    "distribution_summary",
    A.final(
        """SELECT l_shipmode_group AS category, count(*) AS n, avg(v) AS mean, min(v) AS lowest,
      quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS highest
      FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_group, l_extendedprice AS v FROM lineitem) GROUP BY 1""",
        "mean lowest q1 median q3 highest",
        "n",
    ),
)
def distribution_summary(spark, d):
    rows = A.table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("category"), "l_extendedprice"
    )
    return profile.distribution_summary(rows, "category", "l_extendedprice", few_categories=True)


@add(
    "bounded_sample",
    A.final(
        "SELECT event_id, event_type, value FROM events "
        "ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id LIMIT 3000",
        "value",
        "event_id",
    ),
)
def bounded_sample(spark, d):
    rows = A.table(spark, d, "events").select("event_id", "event_type", "value")
    return profile.bounded_sample(rows, ["event_id"])


# --- board ------------------------------------------------------------------

_SCORES = "balanced_score low_risk_score low_congestion_score max_availability_score"
_SCORED_D = (
    "utilization occupancy_clean capacity_pressure predicted_utilization_1h predicted_available_spaces_1h "
    "prediction_interval_lower prediction_interval_upper uncertainty_width predicted_free_ratio " + _SCORES
)


@add(
    "recommend_rank",
    A.final(
        "SELECT *, dense_rank() OVER (ORDER BY balanced_score DESC) AS recommendation_rank FROM scored",
        _SCORED_D,
        "capacity recommendation_rank",
        A.BOARD_SQL,
    ),
)
def recommend_rank(spark, d):
    return decide.recommend(A.board(spark, d))


@add(
    "recommended_view",
    A.final(
        "SELECT dense_rank() OVER (ORDER BY balanced_score DESC) AS recommendation_rank, system_code, "
        "predicted_available_spaces_1h, predicted_utilization_1h, risk_band, balanced_score FROM scored",
        "predicted_available_spaces_1h predicted_utilization_1h balanced_score",
        "recommendation_rank",
        A.BOARD_SQL,
    ),
)
def recommended_view(spark, d):
    return profile.recommended_view(decide.recommend(A.board(spark, d), ordered=False))


@add(
    "objective_rank",
    A.final(
        """SELECT system_code, low_risk_score, risk_band, row_number() OVER (ORDER BY low_risk_score DESC, system_code)
      AS recommendation_rank FROM scored ORDER BY low_risk_score DESC, system_code LIMIT 10""",
        "low_risk_score",
        "recommendation_rank",
        A.BOARD_SQL,
    ),
)
def objective_rank(spark, d):
    top = decide.objective_rank(scored(spark, d), "Lowest Risk", 10)
    return top.select("system_code", "low_risk_score", "risk_band", "recommendation_rank")


@add(
    "top_n_free",
    A.final(
        "SELECT system_code, predicted_available_spaces_1h, risk_band FROM scored "
        "ORDER BY predicted_available_spaces_1h DESC, system_code LIMIT 20",
        "predicted_available_spaces_1h",
        "",
        A.BOARD_SQL,
    ),
)
def top_n_free(spark, d):
    return decide.top_n(scored(spark, d), "predicted_available_spaces_1h", 20).select(
        "system_code", "predicted_available_spaces_1h", "risk_band"
    )


@add(
    "risk_counts",
    A.final(
        """SELECT coalesce(risk_band, 'Unknown') AS risk_band, count(*) AS count FROM (
      SELECT CASE WHEN system_code % 7 = 0 THEN NULL ELSE risk_band END AS risk_band FROM scored) GROUP BY 1""",
        "",
        "count",
        A.BOARD_SQL,
    ),
)
def risk_counts(spark, d):
    rows = scored(spark, d).withColumn("risk_band", F.when(F.col("system_code") % 7 != 0, F.col("risk_band")))
    return profile.label_counts(rows)


_SNAPSHOT = """SELECT count(DISTINCT system_code) AS systems, avg(predicted_utilization_1h) AS mean_utilization,
  count(*) FILTER (risk_band = 'Critical') AS critical_systems,
  count(*) FILTER (risk_band IN ('Critical', 'High')) AS high_risk_systems,
  count(*) FILTER (predicted_available_spaces_1h <= 50 OR predicted_free_ratio <= 0.05) AS low_availability_systems,
  (SELECT system_code FROM scored ORDER BY balanced_score DESC, system_code LIMIT 1) AS best_option,
  (SELECT system_code FROM scored ORDER BY predicted_utilization_1h DESC, system_code LIMIT 1) AS most_congested
  FROM scored"""


@add(
    "board_snapshot",
    A.final(
        _SNAPSHOT,
        "mean_utilization",
        "systems critical_systems high_risk_systems low_availability_systems",
        A.BOARD_SQL,
    ),
)
def board_snapshot(spark, d):
    return profile.board_snapshot(scored(spark, d))


@add(
    "snapshot_delta",
    A.final(
        """SELECT avg(u) AS before_mean_utilization, avg(v) AS after_mean_utilization,
      avg(v) - avg(u) AS delta_mean_utilization, (count(*) FILTER (after_band = 'Critical'))
        - (count(*) FILTER (risk_band = 'Critical')) AS delta_critical_systems FROM (
      SELECT predicted_utilization_1h AS u, least(1.0, predicted_utilization_1h + CAST(0.1 AS DOUBLE)) AS v, risk_band,
        CASE WHEN predicted_utilization_1h > 0.5 THEN 'Critical' ELSE risk_band END AS after_band FROM scored)""",
        "before_mean_utilization after_mean_utilization delta_mean_utilization",
        "delta_critical_systems",
        A.BOARD_SQL,
    ),
)
def snapshot_delta(spark, d):
    before = scored(spark, d)
    u = F.col("predicted_utilization_1h")
    after = before.withColumns(
        {
            "risk_band": F.when(u > 0.5, "Critical").otherwise(F.col("risk_band")),
            "predicted_utilization_1h": F.least(F.lit(1.0), u + 0.1),
        }
    )
    return profile.snapshot_delta(before, after)


@add(
    "union_topk_dedupe",
    A.BOARD_SQL
    + """, a AS (SELECT system_code, 0 AS l, row_number() OVER (ORDER BY capacity DESC, system_code) - 1 AS i FROM scored
        ORDER BY capacity DESC, system_code LIMIT 4),
      b AS (SELECT system_code, 1 AS l, row_number() OVER (ORDER BY predicted_utilization_1h DESC, system_code) - 1 AS i
        FROM scored ORDER BY predicted_utilization_1h DESC, system_code LIMIT 3),
      u AS (SELECT *, row_number() OVER (PARTITION BY system_code ORDER BY l, i) AS rn FROM (
        SELECT * FROM a UNION ALL SELECT * FROM b))
      SELECT system_code, row_number() OVER (ORDER BY l, i) - 1 AS place FROM u WHERE rn = 1""",
)
def union_topk_dedupe(spark, d):
    rows = decide.union_top_lists(scored(spark, d), [("capacity", 4), ("predicted_utilization_1h", 3)])
    return rows.select("system_code", F.col("_i").alias("place"))


def _stress_sql() -> str:
    """The four scenarios at step 2 from the same board; every site is linked with the five that follow, the nearer the heavier."""
    return (
        A.BOARD_SQL
        + """, rush AS (SELECT *, row_number() OVER (ORDER BY predicted_utilization_1h DESC, system_code) - 1 AS i FROM scored
    ORDER BY predicted_utilization_1h DESC, system_code LIMIT 6),
  a AS (SELECT *, 0 AS l, row_number() OVER (ORDER BY capacity DESC, system_code) - 1 AS j FROM scored
    ORDER BY capacity DESC, system_code LIMIT 4),
  b AS (SELECT *, 1 AS l, row_number() OVER (ORDER BY predicted_utilization_1h DESC, system_code) - 1 AS j FROM scored
    ORDER BY predicted_utilization_1h DESC, system_code LIMIT 3),
  u AS (SELECT *, row_number() OVER (ORDER BY l, j) - 1 AS i FROM (SELECT *, row_number() OVER (
    PARTITION BY system_code ORDER BY l, j) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE rn = 1),
  origin AS (SELECT * FROM scored ORDER BY predicted_utilization_1h DESC, system_code LIMIT 1),
  relief AS (SELECT *, 0 AS i FROM scored ORDER BY capacity DESC, system_code LIMIT 8),
  moved AS (
    SELECT 'rush_hour_surge' AS scenario, system_code, capacity, occupancy_clean + capacity*(CAST(0.05+0.015*2 AS DOUBLE)
      + CAST(0.005 AS DOUBLE)*i) AS occ, queue_length + 4 + i//2 AS q, 'high' AS traffic, 0 AS special FROM rush
    UNION ALL SELECT 'event_overflow', system_code, capacity, occupancy_clean + capacity*(CAST(0.08+0.02*2 AS DOUBLE)
      + CAST(0.01 AS DOUBLE)*(i % 2)), queue_length + 6 + i, 'high', 1 FROM u
    UNION ALL SELECT 'holiday_relief', system_code, capacity, occupancy_clean - capacity*CAST(0.06+0.015*2 AS DOUBLE),
      queue_length - greatest(queue_length, 1), 'low', 1 FROM relief
    UNION ALL SELECT 'spillover_disruption', system_code, capacity, capacity*least(CAST(0.99 AS DOUBLE), greatest(utilization
      + CAST(0.12 AS DOUBLE) + CAST(0.02 AS DOUBLE)*2, CAST(0.93 AS DOUBLE))), queue_length + 7, 'high', 0 FROM origin
    UNION ALL SELECT 'spillover_disruption', s.system_code, s.capacity, s.occupancy_clean + s.capacity*CAST(0.04+0.015*2 AS DOUBLE), s.queue_length + 4, 'high', 0
      FROM (SELECT t.* FROM scored t, origin o WHERE t.system_code - o.system_code BETWEEN 1 AND 5 ORDER BY t.system_code LIMIT 3) s)
  SELECT scenario, system_code, round_even(greatest(0.0, least(CAST(capacity AS DOUBLE), occ))*100, 0)/100 AS occupancy,
    CAST(CASE WHEN traffic = 'low' THEN least(2, greatest(0, least(30, q))) ELSE greatest(0, least(30, q)) END AS BIGINT)
      AS queue_length,
    traffic AS traffic_condition_nearby, CAST(special AS BIGINT) AS is_special_day, CAST(capacity AS DOUBLE) AS capacity,
    CASE system_code % 4 WHEN 0 THEN 'bike' WHEN 1 THEN 'truck' WHEN 2 THEN 'cycle' ELSE 'car' END AS vehicle_type,
    CAST(system_code % 97 AS DOUBLE) AS latitude, CAST(system_code % 89 AS DOUBLE) AS longitude FROM moved"""
    )


@add("stress_scenario", _stress_sql())
def stress_scenario(spark, d):
    code = F.col("system_code")
    board = scored(spark, d).withColumns(
        {
            "vehicle_type": F.when(code % 4 == 0, "bike").when(code % 4 == 1, "truck").when(code % 4 == 2, "cycle"),
            "latitude": (code % 97).cast("double"),
            "longitude": (code % 89).cast("double"),
        }
    )
    step = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step")
    edges = board.select("system_code", step).select("system_code", (code + F.col("step")).alias("neighbor_code"), (1 / F.col("step")).alias("weight"))
    edges = edges.join(board.select(code.alias("neighbor_code")), "neighbor_code", "left_semi")
    out = None
    for name in ("rush_hour_surge", "event_overflow", "holiday_relief", "spillover_disruption"):
        part = decide.stress_scenario(board, name, 2, edges).select(
            F.lit(name).alias("scenario"), "system_code", "occupancy", "queue_length",
            "traffic_condition_nearby", "is_special_day", "capacity", "vehicle_type", "latitude", "longitude",
        )
        out = part if out is None else out.unionByName(part)
    return out


# --- forecasts without models ----------------------------------------------

_METRICS = """SELECT model, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e*e)) AS rmse,
  1 - sum(e*e)/(count(*)*var_pop(actual)) AS r2, avg(abs(e)/greatest(abs(actual), 1e-6))*100 AS mape
  FROM (SELECT model, actual, actual - least(1.0, greatest(0.0, predicted)) AS e FROM forecasts) GROUP BY model"""


@add("regression_metrics", A.final(_METRICS, "mae rmse r2 mape", "n", A.FORECAST_SQL))
def regression_metrics(spark, d):
    return ev.regression_metrics(A.forecasts(spark, d), "actual", "predicted")


_BANDED = f""", banded AS (SELECT model, {A.band_sql('actual', fixed.UTILIZATION_EDGES, fixed.UTILIZATION_LABELS)} AS t,
  {A.band_sql('predicted', fixed.UTILIZATION_EDGES, fixed.UTILIZATION_LABELS)} AS p FROM forecasts),
bands AS (SELECT model, b, sum(s) AS support, sum(c) AS claimed, sum(h) AS hits FROM (
  SELECT model, t AS b, 1 AS s, 0 AS c, CASE WHEN t = p THEN 1 ELSE 0 END AS h FROM banded
  UNION ALL SELECT model, p, 0, 1, 0 FROM banded) GROUP BY model, b),
summed AS (SELECT model, sum(hits)/sum(support) AS band_accuracy,
  sum(support * (2.0*hits/(support + claimed)))/sum(support) AS weighted_f1 FROM bands GROUP BY model)"""


@add("band_metrics", A.final("SELECT * FROM summed", "band_accuracy weighted_f1", "", A.FORECAST_SQL + _BANDED))
def band_metrics(spark, d):
    """Unclipped predictions, so that the out-of-range band occurs."""
    return ev.band_metrics(A.forecasts(spark, d), "actual", "predicted", clip=False)


@add(
    "champion_model",
    A.final(
        f"SELECT * FROM ({_METRICS}) ORDER BY rmse, model LIMIT 1", "mae rmse r2 mape", "n", A.FORECAST_SQL
    ),
)
def champion_model(spark, d):
    return ev.champion(ev.regression_metrics(A.forecasts(spark, d), "actual", "predicted"))


@add(
    "interval_radius",
    A.final(
        "SELECT model, quantile_cont(abs(actual - predicted), 0.9) AS radius FROM forecasts GROUP BY model",
        "radius",
        "",
        A.FORECAST_SQL,
    ),
)
def interval_radius(spark, d):
    return ev.interval_radius(A.forecasts(spark, d), "actual", "predicted")


_WEIGHTS = """SELECT model, inv/sum(inv) OVER () AS weight FROM (SELECT model,
  1/greatest(sqrt(avg((actual - predicted)*(actual - predicted))), 1e-6) AS inv FROM forecasts GROUP BY model)"""


@add("ensemble_weights", A.final(_WEIGHTS, "weight", "", A.FORECAST_SQL))
def ensemble_weights(spark, d):
    return ev.ensemble_weights(A.forecasts(spark, d), "actual", "predicted")


_MEMBERS = """SELECT l_orderkey, l_linenumber, l_quantity/50 AS a,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_quantity + l_partkey % 7 - 3)/50 END AS b FROM lineitem"""


@add(
    "ensemble_predict",
    A.final(
        f"""SELECT l_orderkey, l_linenumber, CASE WHEN b IS NULL THEN a
      ELSE (CAST(0.51 AS DOUBLE)*a + CAST(0.49 AS DOUBLE)*b) / (CAST(0.51 AS DOUBLE) + CAST(0.49 AS DOUBLE)) END AS predicted
      FROM ({_MEMBERS})""",
        "predicted",
        "l_linenumber",
    ),
)
def ensemble_predict(spark, d):
    """Weighted blend; the second member is missing on some rows and the weights renormalise."""
    rows = A.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") / 50).alias("a"),
        F.when(F.col("l_linenumber") != 3, (F.col("l_quantity") + F.col("l_partkey") % 7 - 3) / 50).alias("b"),
    )
    value = ev.ensemble_value({"a": 0.51, "b": 0.49}, {"a": "a", "b": "b"})
    return rows.select("l_orderkey", "l_linenumber", value.alias("predicted"))


@add(
    "prediction_interval",
    A.final(
        """SELECT model, target_time_slot, actual, p AS predicted, least(1.0, greatest(0.0, p - radius))
        AS prediction_interval_lower, least(1.0, greatest(0.0, p + radius)) AS prediction_interval_upper,
        least(1.0, greatest(0.0, p + radius)) - least(1.0, greatest(0.0, p - radius)) AS uncertainty_width
      FROM (SELECT *, least(1.0, greatest(0.0, predicted)) AS p FROM forecasts)
      JOIN (SELECT model, quantile_cont(abs(actual - predicted), 0.9) AS radius FROM forecasts GROUP BY model)
      USING (model)""",
        "actual predicted prediction_interval_lower prediction_interval_upper uncertainty_width",
        "",
        A.FORECAST_SQL,
    ),
)
def prediction_interval(spark, d):
    from slotline.functions import columns as X

    rows = A.forecasts(spark, d)
    radius = ev.interval_radius(rows, "actual", "predicted")  # one row per model
    joined = rows.join(F.broadcast(radius), "model").withColumn("predicted", X.clip("predicted"))
    return ev.prediction_interval(joined, F.col("radius"), "predicted").drop("radius")


@add(
    "union_predictions",
    A.final(
        """SELECT 'Persistence Baseline' AS model, target_time_slot, actual AS predicted, NULL AS uncertainty_width FROM forecasts
      UNION ALL SELECT model, target_time_slot, predicted, CAST(0.0872 AS DOUBLE) FROM forecasts""",
        "predicted uncertainty_width",
        "",
        A.FORECAST_SQL,
    ),
)
def union_predictions(spark, d):
    rows = A.forecasts(spark, d)
    plain = rows.select(
        F.lit("Persistence Baseline").alias("model"), "target_time_slot", F.col("actual").alias("predicted")
    )
    wide = rows.select("model", "target_time_slot", "predicted", F.lit(0.0872).alias("uncertainty_width"))
    return plain.unionByName(wide, allowMissingColumns=True)


# --- time splits ------------------------------------------------------------

_TIMES = "WITH times AS (SELECT DISTINCT o_orderdate AS t FROM orders), numbered AS (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM times)"
_CUT = "(SELECT t FROM numbered WHERE rn = greatest(1, floor(n*CAST(0.8 AS DOUBLE))))"


@add(
    "temporal_split",
    f"{_TIMES} SELECT o_orderkey, o_orderdate, o_orderdate <= {_CUT} AS is_train FROM orders",
)
def temporal_split(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ev.temporal_split(rows, "o_orderdate")


@add(
    "calibration_split",
    f"""{_TIMES}, train AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= {_CUT}),
tn AS (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate AS t FROM train))
SELECT o_orderkey, o_orderdate,
  o_orderdate >= (SELECT t FROM tn WHERE rn = n - greatest(1, floor(n*CAST(0.15 AS DOUBLE))) + 1) AS is_calibration FROM train""",
)
def calibration_split(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    train = rows.where(F.col("o_orderdate") <= ev.split_time(rows, "o_orderdate").scalar())
    return ev.calibration_split(train, "o_orderdate")


_PLAN = f"""{_TIMES}, w AS (SELECT unnest([1, 2, 3]) AS k),
raw AS (SELECT k, n, n - (3 - k)*120 AS e, greatest(1, n - (3 - k)*120 - 120) AS s FROM w, (SELECT max(n) AS n FROM numbered)
  WHERE n > 170 AND greatest(1, n - (3 - k)*120 - 120) - 1 >= 100),
plan AS (SELECT row_number() OVER (ORDER BY k) AS "window",
  (SELECT t FROM numbered WHERE rn = s) AS train_end_time, (SELECT t FROM numbered WHERE rn = s + 1) AS test_start_time,
  (SELECT t FROM numbered WHERE rn = e) AS test_end_time FROM raw)"""


@add("backtest_plan", f"{_PLAN} SELECT * FROM plan")
def backtest_plan(spark, d):
    return ev.backtest_plan(A.table(spark, d, "orders"), "o_orderdate")


@add(
    "backtest_assign",
    f"{_PLAN} SELECT o_orderkey, o_orderdate, p.* FROM orders JOIN plan p "
    "ON o_orderdate BETWEEN test_start_time AND test_end_time",
)
def backtest_assign(spark, d):
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ev.assign_windows(rows, ev.backtest_plan(rows, "o_orderdate"), "o_orderdate")


# --- logs -------------------------------------------------------------------


@add(
    "recent_rows",
    A.final(
        "SELECT event_id AS request_id, event_type AS method, ts AS created_at, value AS duration_ms FROM events "
        "ORDER BY ts DESC, event_id DESC LIMIT 100",
        "duration_ms",
    ),
)
def recent_rows(spark, d):
    rows = A.requests(spark, d).select("request_id", "method", "created_at", "duration_ms")
    return activity.recent_rows(rows, "created_at", 100, "request_id")


@add(
    "activity_feed",
    """WITH audit AS (SELECT 'audit' AS source, ts AS created_at, event_type AS title, props AS summary,
  CAST(event_id AS VARCHAR) AS entry_id FROM events),
calls AS (SELECT 'api' AS source, ts AS created_at, event_type || ' /u/' || user_id AS title,
  printf('status=%d duration_ms=%.2f', CASE WHEN event_type = 'error' THEN 500 ELSE 200 END, round_even(value*100, 0)/100) AS summary,
  CAST(event_id AS VARCHAR) AS entry_id FROM events)
SELECT * FROM (SELECT * FROM audit UNION ALL SELECT * FROM calls)
ORDER BY created_at DESC, source, entry_id DESC LIMIT 20""",
)
def activity_feed(spark, d):
    return activity.activity_feed(A.audit(spark, d), A.requests(spark, d), 20)
