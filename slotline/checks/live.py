"""Live path: streams and their batch counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.checks import adapters as A
from slotline.checks.catalog import CATALOG
from slotline.checks.context import _ASOF_SQL, LIVE_SQL, graph, staged_slots
from slotline.checks.forecast import drift_rows
from slotline.checks.forecast import _DRIFT as DRIFT_CTES
from slotline.checks.summary import _SNAPSHOT, scored
from slotline.operators import activity, decide, figures, ranks
from slotline.plans import reports
from slotline.session import pin_time_zone, scratch_path, stage
from slotline.streaming import board as B
from slotline.streaming import ingest, keyed
from slotline.streaming.live import site_history

add = CATALOG.add


def event_stream(spark, d):
    """The events table as a file stream."""
    pin_time_zone(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return ingest.read_files(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def observation_stream(spark, d):
    return event_stream(spark, d).selectExpr(*[f"{e} AS {c}" for c, e in A.OBS_COLUMNS.items()])


_AGG_D = "latitude longitude occupancy queue_length"
_AGG_L = "record_id capacity is_special_day"
_CLOSED = "time_slot <= (SELECT max(time_slot) - INTERVAL 2 HOURS FROM placed)"


@add(
    "stream_slot_aggregate",
    A.final(
        f"SELECT system_code, time_slot, timestamp, vehicle_type, traffic_condition_nearby, "
        + ", ".join((_AGG_D + " " + _AGG_L).split())
        + f" FROM agg WHERE {_CLOSED}",
        _AGG_D,
        _AGG_L,
        A.with_ctes("agg"),
    ),
)
def stream_slot_aggregate(spark, d):
    """Slots closed by the watermark (two hours behind the newest slot)."""
    rows = ingest.slot_stream(observation_stream(spark, d))
    return ingest.drain(rows, scratch_path(spark, "slots"), scratch_path(spark, "checkpoint"))


@add(
    "stream_sessions",
    A.final(
        """SELECT system_code, min(time_slot) AS session_start, max(time_slot) AS session_last_slot, sum(n) AS readings
      FROM sessions JOIN (SELECT system_code, time_slot, count(*) AS n FROM placed GROUP BY ALL)
      USING (system_code, time_slot) GROUP BY system_code, session_id
      HAVING max(time_slot) + INTERVAL 30 MINUTES <= (SELECT max(time_slot) - INTERVAL 2 HOURS FROM placed)""",
        "",
        "readings",
        A.with_ctes("sessions"),
    ),
)
def stream_sessions(spark, d):
    rows = ingest.session_stream(observation_stream(spark, d))
    return ingest.drain(rows, scratch_path(spark, "sessions"), scratch_path(spark, "checkpoint"))


_STREAMED = """lag_occupancy_30m lag_occupancy_60m lag_utilization_30m lag_utilization_60m lag_utilization_120m
 lag_queue_30m rolling_utilization_3 rolling_utilization_6 rolling_queue_3 rolling_queue_6 rolling_stress_3
 lag_utilization_prev_day lag_queue_prev_day lag_stress_prev_day utilization_delta_30m utilization_delta_60m
 minutes_from_previous"""


@add(
    "stream_live_features",
    A.final(
        """SELECT system_code, time_slot, session_step, false AS is_late, * EXCLUDE (system_code, time_slot, session_step,
      utilization, session_progress), utilization - lag_utilization_30m AS utilization_delta_30m,
      utilization - lag_utilization_60m AS utilization_delta_60m FROM live""",
        _STREAMED,
        "session_step",
        A.with_ctes("slots") + LIVE_SQL,
    ),
)
def stream_live_features(spark, d):
    """The stateful stream over the clean slot table."""
    from slotline.streaming.live import live_feature_stream

    slots = staged_slots(spark, d)
    path = scratch_path(spark, "clean")
    slots.write.parquet(path)
    stream = ingest.read_files(spark, path, slots.schema)
    return ingest.drain(live_feature_stream(stream), scratch_path(spark, "live"), scratch_path(spark, "checkpoint"))


@add(
    "append_log",
    A.final(
        "SELECT event_id, user_id, event_type, ts, sha256(CAST(event_id AS VARCHAR) || '|' || event_type) AS entry_key FROM events",
        "",
        "event_id user_id",
    ),
)
def append_log(spark, d):
    rows = event_stream(spark, d).select("event_id", "user_id", "event_type", "ts")
    path = scratch_path(spark, "log")
    ingest.log_stream(rows, ["event_id", "event_type"], path, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path)


_UPSERTS = ["user_id", "event_id", "ts", "event_type", "value"]
_LATEST_SQL = A.final(
    """SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "value",
    "user_id event_id",
)


@add("live_board", _LATEST_SQL)
def live_board(spark, d):
    """A board seeded from one half of the changes and upserted with the other."""
    rows = A.table(spark, d, "events").select(*_UPSERTS)
    even = rows.where(F.col("event_id") % 2 == 0)
    seed = activity.upsert_latest(even.limit(0), even, "user_id", ["ts", "event_id"])
    return activity.upsert_latest(seed, rows.where(F.col("event_id") % 2 == 1), "user_id", ["ts", "event_id"])


@add("live_board_stream", _LATEST_SQL)
def live_board_stream(spark, d):
    """The same board kept by a stream through versioned tables."""
    path = scratch_path(spark, "board")
    stream = event_stream(spark, d).select(*_UPSERTS)
    B.board_stream(stream, path, scratch_path(spark, "checkpoint"), "user_id", ["ts", "event_id"]).awaitTermination()
    return B.read_board(spark, path)


_UPSERTED_SQL = A.BOARD_SQL.replace(
    "part_board AS (SELECT ",
    "part_board AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in A.BOARD_COLUMNS.items() if c not in ("predicted_utilization_1h", "queue_length"))
    + """, CASE WHEN p_partkey % 3 = 0 THEN CAST((p_size * 3) % 50 AS DOUBLE) / 50 ELSE CAST(p_size AS DOUBLE) / 50 END AS predicted_utilization_1h,
  CASE WHEN p_partkey % 3 = 0 THEN (p_partkey + 4) % 15 ELSE p_partkey % 15 END AS queue_length FROM part), untouched AS (SELECT """,
)


@add(
    "rank_after_upsert",
    A.final(
        """SELECT rn AS recommendation_rank FROM (SELECT system_code, row_number() OVER (ORDER BY balanced_score DESC, system_code) AS rn
      FROM scored) WHERE system_code = (SELECT max(p_partkey) // 6 * 3 FROM part)""",
        "",
        "recommendation_rank",
        _UPSERTED_SQL,
    ),
)
def rank_after_upsert(spark, d):
    """A third of the board gets new forecasts; the index follows by differences and ranks one of the changed sites."""
    board = stage(ranks.with_bucket(scored(spark, d)).withColumn("version", F.lit(0)), "board")
    index = stage(ranks.build_index(board), "index")
    fresh = A.board(spark, d, {"predicted_utilization_1h": "CAST((p_size * 3) % 50 AS DOUBLE) / 50", "queue_length": "(p_partkey + 4) % 15"})
    changes = decide.score_board(fresh.where(F.col("system_code") % 3 == 0)).transform(ranks.with_bucket).withColumn("version", F.lit(1))
    changes = stage(changes.select(*board.columns), "changes")
    before = board.join(changes.select("system_code"), "system_code", "left_semi")
    index = stage(ranks.index_after(index, before, changes), "index")
    board = stage(activity.upsert_latest(board, changes, "system_code", ["version"]), "board")
    middle = A.table(spark, d, "part").agg(F.expr("max(p_partkey) div 6 * 3")).scalar()
    return ranks.rank_from_index(board, index, middle)


@add(
    "board_snapshot_stream",
    A.final(_SNAPSHOT, "mean_utilization", "systems critical_systems high_risk_systems low_availability_systems", _UPSERTED_SQL),
)
def board_snapshot_stream(spark, d):
    """The headline figures after two micro-batches, the second with new forecasts for a third of the sites, kept by differences."""
    changed = {"predicted_utilization_1h": "CAST((p_size * 3) % 50 AS DOUBLE) / 50", "queue_length": "(p_partkey + 4) % 15"}
    first = A.board(spark, d).withColumn("version", F.lit(0))
    second = A.board(spark, d, changed).where(F.col("system_code") % 3 == 0).withColumn("version", F.lit(1))
    path, board, kept = scratch_path(spark, "changes"), scratch_path(spark, "board"), scratch_path(spark, "figures")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = ingest.read_files(spark, path, first.schema, files_per_batch=1)
    prepare = lambda rows: figures.with_buckets(decide.score_board(rows))
    B.board_stream(stream, board, scratch_path(spark, "checkpoint"), "system_code", ["version"], prepare, kept).awaitTermination()
    return figures.snapshot(B.read_beside(spark, board, kept), B.read_board(spark, board))


@add(
    "live_interval",
    A.final(
        """SELECT system_code, predicted_utilization_1h, greatest(0.0, predicted_utilization_1h - w/2) AS prediction_interval_lower,
      least(1.0, predicted_utilization_1h + w/2) AS prediction_interval_upper,
      least(1.0, predicted_utilization_1h + w/2) - greatest(0.0, predicted_utilization_1h - w/2) AS uncertainty_width
      FROM part_board, (SELECT max(coalesce(uncertainty_width, 0)) AS w FROM board)""",
        "predicted_utilization_1h prediction_interval_lower prediction_interval_upper uncertainty_width",
        "",
        A.BOARD_SQL,
    ),
)
def live_interval(spark, d):
    """Half the widest published width on both sides of a prediction."""
    widths = A.board(spark, d).select("uncertainty_width")
    rows = A.board(spark, d).select("system_code", "predicted_utilization_1h")
    return decide.live_interval(rows, widths)


# A linear stand-in for the models, so that SQL can follow the whole path.
STAND_IN = {
    "utilization": 0.55, "lag_utilization_30m": 0.2, "rolling_utilization_6": 0.15, "lag_utilization_prev_day": 0.1, "neighbor_utilization_mean": 0.05,
    "rolling_queue_3": 0.002, "minutes_from_previous": -0.00001,
}
_SCORED_D = """predicted_utilization_1h prediction_interval_lower prediction_interval_upper uncertainty_width predicted_available_spaces_1h predicted_free_ratio
 balanced_score low_risk_score low_congestion_score max_availability_score"""
_LINEAR = " + ".join(f"CAST({w!r} AS DOUBLE)*coalesce({c}, 0)" for c, w in STAND_IN.items())
_LIVE_SCORED = (
    _ASOF_SQL
    + LIVE_SQL
    + ", "
    + A.BOARD_SQL.replace("WITH ", "", 1)
    + f""", widest AS (SELECT max(coalesce(uncertainty_width, 0)) AS w FROM board),
together AS (SELECT l.*, n.* EXCLUDE (system_code, time_slot), s.capacity, s.capacity_pressure, s.occupancy_clean, s.queue_length, s.parking_stress_index,
  row_number() OVER (PARTITION BY l.system_code ORDER BY l.time_slot DESC) AS rn
  FROM live l JOIN nearby n USING (system_code, time_slot) JOIN slots s USING (system_code, time_slot)),
told AS (SELECT *, least(1.0, greatest(0.0, {_LINEAR})) AS predicted_utilization_1h FROM together WHERE rn = 1),
ranged AS (SELECT *, greatest(0.0, predicted_utilization_1h - w/2) AS prediction_interval_lower, least(1.0, predicted_utilization_1h + w/2) AS prediction_interval_upper,
  round_even(capacity*(1 - predicted_utilization_1h), 0) AS predicted_available_spaces_1h FROM told, widest),
spread AS (SELECT *, prediction_interval_upper - prediction_interval_lower AS uncertainty_width, predicted_available_spaces_1h/greatest(capacity, 1) AS predicted_free_ratio FROM ranged)"""
)


@add(
    "live_scored_board",
    A.final(
        """SELECT system_code, time_slot, session_step, lag_utilization_30m, rolling_utilization_6, lag_utilization_prev_day, neighbor_utilization_mean, mean_neighbor_distance,
      predicted_utilization_1h, prediction_interval_lower, prediction_interval_upper, uncertainty_width, predicted_available_spaces_1h, predicted_free_ratio,
      CAST(0.45 AS DOUBLE)*predicted_free_ratio + CAST(0.25 AS DOUBLE)*(1 - predicted_utilization_1h) + CAST(0.20 AS DOUBLE)*(1 - capacity_pressure)
        + CAST(0.10 AS DOUBLE)*(1 - uncertainty_width) AS balanced_score,
      1 - prediction_interval_upper AS low_risk_score, CAST(0.6 AS DOUBLE)*(1 - capacity_pressure) + CAST(0.4 AS DOUBLE)*(1 - predicted_utilization_1h) AS low_congestion_score,
      predicted_free_ratio AS max_availability_score,
      CASE WHEN prediction_interval_upper <= 0.55 THEN 'Low' WHEN prediction_interval_upper <= 0.75 THEN 'Moderate' WHEN prediction_interval_upper <= 0.9 THEN 'High' ELSE 'Critical' END AS risk_band
      FROM spread""",
        _SCORED_D + " lag_utilization_30m rolling_utilization_6 lag_utilization_prev_day neighbor_utilization_mean mean_neighbor_distance",
        "session_step",
        _LIVE_SCORED,
    ),
)
def live_scored_board(spark, d):
    """Slot rows of all sites as a stream in two steps of time, from a state that starts with the oldest third; the board keeps each site's newest scored row."""
    from slotline.streaming import score

    slots = staged_slots(spark, d)
    ends = slots.agg(F.min("time_slot").alias("a"), F.max("time_slot").alias("b"))
    third = lambda k: ends.select(F.timestamp_micros((F.unix_micros("a") + (F.unix_micros("b") - F.unix_micros("a")) * k / 3).cast("long"))).scalar()
    history = stage(slots.where(F.col("time_slot") < third(1)), "history")
    path = scratch_path(spark, "arrivals")
    for low, high in ((1, 2), (2, 4)):
        part = slots.where((F.col("time_slot") >= third(low)) & (F.col("time_slot") < third(high)))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = ingest.read_files(spark, path, slots.schema, files_per_batch=1)
    board, checkpoint = scratch_path(spark, "board"), scratch_path(spark, "checkpoint")
    predict = lambda rows: rows.withColumn("predicted_utilization_1h", score.linear_prediction(STAND_IN))
    widths = A.board(spark, d).select("uncertainty_width")
    score.scored_board_stream(stream, graph(slots), history, widths, predict, board, checkpoint).awaitTermination()
    names = "system_code time_slot session_step lag_utilization_30m rolling_utilization_6 lag_utilization_prev_day neighbor_utilization_mean mean_neighbor_distance"
    return B.read_board(spark, board).select(*names.split(), *_SCORED_D.split(), "risk_band")


_TEMPLATED = "lag_occupancy_30m lag_occupancy_60m lag_utilization_30m lag_utilization_60m lag_utilization_120m rolling_utilization_3 rolling_queue_6 rolling_stress_3 lag_utilization_prev_day lag_queue_prev_day"


@add(
    "live_template_lags",
    A.final(
        """SELECT a.system_code, a.time_slot, CASE WHEN a.time_slot = b.time_slot + INTERVAL 30 MINUTES THEN b.session_step + 1 ELSE 0 END AS session_step,
      b.occupancy_clean AS lag_occupancy_30m, c.occupancy_clean AS lag_occupancy_60m, b.utilization AS lag_utilization_30m, c.utilization AS lag_utilization_60m,
      b.lag_utilization_120m, list_avg([b.utilization, c.utilization]) AS rolling_utilization_3, list_avg([b.queue_length, c.queue_length]) AS rolling_queue_6,
      list_avg([b.parking_stress_index, c.parking_stress_index]) AS rolling_stress_3,
      coalesce(CASE a.slot_index WHEN b.slot_index THEN b.utilization WHEN c.slot_index THEN c.utilization END, b.lag_utilization_prev_day) AS lag_utilization_prev_day,
      coalesce(CASE a.slot_index WHEN b.slot_index THEN b.queue_length WHEN c.slot_index THEN c.queue_length END, b.lag_queue_prev_day) AS lag_queue_prev_day
      FROM r a JOIN r b ON b.system_code = a.system_code AND b.rn = 2 JOIN r c ON c.system_code = a.system_code AND c.rn = 3 WHERE a.rn = 1""",
        _TEMPLATED,
        "session_step",
        A.with_ctes("slots")
        + LIVE_SQL
        + """, r AS (SELECT l.*, s.slot_index, s.occupancy_clean, s.queue_length, s.parking_stress_index,
      row_number() OVER (PARTITION BY l.system_code ORDER BY l.time_slot DESC) AS rn FROM live l JOIN slots s USING (system_code, time_slot))""",
    ),
)
def live_template_lags(spark, d):
    """The newest row of each site after a history of two rows: lags that reach further back are those of the newest stored row."""
    slots = staged_slots(spark, d)
    place = F.row_number().over(Window.partitionBy("system_code").orderBy(F.desc("time_slot")))
    rows = stage(site_history(slots).withColumn("_place", place).where("_place <= 3"), "tails")
    path = scratch_path(spark, "newest")
    rows.where("_place = 1").drop("_place").write.parquet(path)
    stream = ingest.read_files(spark, path, rows.drop("_place").schema)
    features = keyed.feature_stream(stream, history=rows.where("_place > 1"))
    out = ingest.drain(features, scratch_path(spark, "live"), scratch_path(spark, "checkpoint"))
    return out.select("system_code", "time_slot", "session_step", *_TEMPLATED.split())


_JOBS = """jobs AS (SELECT job_id, arg_max(status, row(moment, event_id)) AS status, min(moment) AS created_at,
  max(CASE WHEN status = 'running' THEN moment END) AS started_at,
  max(CASE WHEN status IN ('completed', 'failed') THEN moment END) AS finished_at, arg_max(message, row(moment, event_id)) AS message
  FROM (SELECT user_id AS job_id, event_id, ts AS moment, props AS message, CASE event_type WHEN 'signup' THEN 'queued'
    WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status
    FROM events) GROUP BY job_id)"""


@add("job_state", f"WITH {_JOBS} SELECT * FROM jobs")
def job_state(spark, d):
    return activity.job_state(A.jobs(spark, d), "event_id")


_T = fixed.ALERT_TEXT
_ALERTS = (
    A.BOARD_SQL
    + ", "
    + DRIFT_CTES.replace("WITH ", "", 1)
    + ", "
    + _JOBS
    + f""", crit AS (SELECT count(*) AS n, arg_max(CAST(system_code AS VARCHAR), row(predicted_utilization_1h, -system_code)) AS k,
  max(predicted_utilization_1h) AS u FROM scored WHERE risk_band = 'Critical'),
tight AS (SELECT count(*) AS n, (SELECT string_agg(CAST(system_code AS VARCHAR), ', ' ORDER BY predicted_available_spaces_1h, system_code)
  FROM (SELECT * FROM scored WHERE predicted_available_spaces_1h <= 50 OR predicted_free_ratio <= 0.05
    ORDER BY predicted_available_spaces_1h, system_code LIMIT 3)) AS names
  FROM scored WHERE predicted_available_spaces_1h <= 50 OR predicted_free_ratio <= 0.05),
worst AS (SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END AS sev
  FROM scores ORDER BY psi DESC, feature LIMIT 1),
job AS (SELECT status, strftime(coalesce(finished_at, started_at, created_at), '%Y-%m-%d %H:%M:%S') AS stamp
  FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 1),
alerts AS (
SELECT CASE WHEN n >= 3 THEN 'critical' ELSE 'warning' END AS severity, 'capacity' AS category,
  '{_T['capacity']['title']}' AS title, printf('{_T['capacity']['message']}', n, k, round_even(u*10000, 0)/100) AS message,
  '{_T['capacity']['action']}' AS recommended_action FROM crit WHERE n > 0
UNION ALL SELECT 'warning', 'availability', '{_T['availability']['title']}',
  printf('{_T['availability']['message']}', n, names), '{_T['availability']['action']}' FROM tight WHERE n > 0
UNION ALL SELECT CASE WHEN sev = 'stable' THEN 'info' ELSE sev END, 'drift', '{_T['drift']['title']}',
  printf('{_T['drift']['message']}', round_even(psi*1000, 0)/1000, feature, sev), '{_T['drift']['action']}' FROM worst
UNION ALL SELECT CASE WHEN status = 'failed' THEN 'critical' ELSE 'info' END, 'retraining',
  printf('{_T['job']['title']}', status), printf('{_T['job']['message']}', status, stamp), '{_T['job']['action']}' FROM job)"""
)


def _alert_inputs(spark, d):
    return scored(spark, d), drift_rows(spark, d), activity.job_state(A.jobs(spark, d), "event_id")


@add("ops_alerts", _ALERTS + " SELECT * FROM alerts")
def ops_alerts(spark, d):
    return decide.ops_alerts(*_alert_inputs(spark, d))


@add(
    "alert_counts",
    _ALERTS
    + " SELECT s AS severity, (SELECT count(*) FROM alerts WHERE severity = s) AS n FROM (SELECT unnest(['critical', 'warning', 'info']) AS s)",
)
def alert_counts(spark, d):
    return decide.alert_counts(decide.ops_alerts(*_alert_inputs(spark, d)))


@add(
    "offered_rate",
    """SELECT event_id AS request_id, user_id AS client_host, ts AS created_at,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS offered,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND 1 PRECEDING) AS earlier
FROM events""",
)
def offered_rate(spark, d):
    """A six-hour trailing window, so that the sparse test clients overlap."""
    rows = A.requests(spark, d).select("request_id", "client_host", "created_at")
    return activity.offered_rate(rows, window_seconds=6 * 3600, bucket_seconds=86_400)


@add(
    "rate_admission",
    """WITH RECURSIVE ev AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, rn, event_id, ts, [us] AS q, true AS allowed, CAST(2 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS retry_after
  FROM ev WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, ts, CASE WHEN len(k) < 3 THEN list_append(k, us) ELSE k END, len(k) < 3,
    CASE WHEN len(k) < 3 THEN CAST(2 - len(k) AS BIGINT) ELSE 0 END,
    CASE WHEN len(k) < 3 THEN 0 ELSE greatest(1, (21600000000 - (us - k[1])) // 1000000) END
  FROM (SELECT e.*, list_filter(r.q, lambda x : e.us - x < 21600000000) AS k
    FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT event_id AS request_id, user_id AS client_host, ts AS created_at, allowed, remaining, retry_after FROM r""",
)
def rate_admission(spark, d):
    rows = A.requests(spark, d).select("request_id", "client_host", "created_at")
    return activity.rate_admission(rows, limit=3, window_seconds=6 * 3600)


_BARE = """bare AS (SELECT event_id AS request_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS client_host,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS created_at FROM events)"""


def _bare_requests(spark, d):
    rows = A.requests(spark, d).select("request_id", "client_host", "created_at")
    return rows.withColumns(
        {
            "client_host": F.when(F.col("request_id") % 4 != 0, F.col("client_host")),
            "created_at": F.when(F.col("request_id") % 9 != 0, F.col("created_at")),
        }
    )


@add(
    "offered_rate_nulls",
    f"""WITH {_BARE} SELECT request_id, client_host, created_at,
  CASE WHEN created_at IS NOT NULL THEN count(*) OVER (PARTITION BY client_host, created_at IS NULL ORDER BY coalesce(epoch_us(created_at), 0)
    RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) END AS offered,
  CASE WHEN created_at IS NOT NULL THEN count(*) OVER (PARTITION BY client_host, created_at IS NULL ORDER BY coalesce(epoch_us(created_at), 0)
    RANGE BETWEEN 599999999 PRECEDING AND 1 PRECEDING) END AS earlier FROM bare""",
)
def offered_rate_nulls(spark, d):
    """A quarter of the requests has no client, a ninth no time."""
    return activity.offered_rate(_bare_requests(spark, d), window_seconds=600)


@add(
    "rate_admission_hot",
    """WITH RECURSIVE ev AS (SELECT *, epoch_us(moment) AS us, row_number() OVER (PARTITION BY client ORDER BY moment, event_id) AS rn FROM (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS client, ts AS moment FROM events)),
r AS (SELECT client, rn, event_id, moment, [us] AS q, true AS allowed, CAST(2 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS retry_after FROM ev WHERE rn = 1
  UNION ALL SELECT client, rn, event_id, moment, CASE WHEN len(k) < 3 THEN list_append(k, us) ELSE k END, len(k) < 3,
    CASE WHEN len(k) < 3 THEN CAST(2 - len(k) AS BIGINT) ELSE 0 END,
    CASE WHEN len(k) < 3 THEN 0 ELSE greatest(1, (3600000000 - (us - k[1])) // 1000000) END
  FROM (SELECT e.*, list_filter(r.q, lambda x : e.us - x < 3600000000) AS k FROM r JOIN ev e ON e.client = r.client AND e.rn = r.rn + 1))
SELECT event_id AS request_id, client AS client_host, moment AS created_at, allowed, remaining, retry_after FROM r""",
)
def rate_admission_hot(spark, d):
    """A third of all requests comes from one client, whose burst is replayed in blocks."""
    rows = A.requests(spark, d).select("request_id", "client_host", "created_at")
    hot = F.when(F.col("request_id") % 3 == 0, F.lit(-1)).otherwise(F.col("client_host"))
    return activity.rate_admission(rows.withColumn("client_host", hot), limit=3, window_seconds=3600)


@add(
    "rate_admission_nulls",
    f"""WITH RECURSIVE {_BARE}, ev AS (SELECT *, coalesce(CAST(client_host AS VARCHAR), 'unknown') AS c, epoch_us(created_at) AS us,
  row_number() OVER (PARTITION BY client_host ORDER BY created_at, request_id) AS rn FROM bare WHERE created_at IS NOT NULL),
r AS (SELECT c, rn, request_id, client_host, created_at, [us] AS q, true AS allowed, CAST(2 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS retry_after
  FROM ev WHERE rn = 1
  UNION ALL SELECT c, rn, request_id, client_host, created_at, CASE WHEN len(k) < 3 THEN list_append(k, us) ELSE k END, len(k) < 3,
    CASE WHEN len(k) < 3 THEN CAST(2 - len(k) AS BIGINT) ELSE 0 END,
    CASE WHEN len(k) < 3 THEN 0 ELSE greatest(1, (600000000 - (us - k[1])) // 1000000) END
  FROM (SELECT e.*, list_filter(r.q, lambda x : e.us - x < 600000000) AS k FROM r JOIN ev e ON e.c = r.c AND e.rn = r.rn + 1))
SELECT request_id, client_host, created_at, allowed, remaining, retry_after FROM r
UNION ALL SELECT request_id, client_host, created_at, NULL, NULL, NULL FROM bare WHERE created_at IS NULL""",
)
def rate_admission_nulls(spark, d):
    """Requests without a client are limited as one client; those without a time are not judged."""
    return activity.rate_admission(_bare_requests(spark, d), limit=3, window_seconds=600)


@add(
    "board_reset_upsert",
    A.final(
        """SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_id % 4 <> 1) WHERE rn = 1""",
        "value",
        "user_id event_id",
    ),
)
def board_reset_upsert(spark, d):
    """Seed, upsert, reset to the seed, then two sources that both start at batch 0; what came before the reset is gone, nothing else is."""
    rows = A.table(spark, d, "events").select(*_UPSERTS)
    part = lambda k: rows.where(F.col("event_id") % 4 == k)
    order = ["ts", "event_id"]
    path = scratch_path(spark, "board")
    seed = activity.upsert_latest(rows.limit(0), part(0), "user_id", order)
    B.seed_if_empty(seed, path)
    B.upsert_batch(part(1), path, 0, "user_id", order, "one")
    B.reset(seed, path)
    B.upsert_batch(part(1), path, 0, "user_id", order, "one")  # delivered before, so it changes nothing
    B.upsert_batch(part(2), path, 1, "user_id", order, "one")
    B.upsert_batch(part(3), path, 0, "user_id", order, "two")
    return B.read_board(spark, path)
