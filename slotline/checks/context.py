"""Neighbours, as-of joins and the model table."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline.checks import adapters as A
from slotline.checks.catalog import CATALOG
from slotline.operators import spatial
from slotline.operators.asof import asof_join
from slotline.plans.features import build_clean, build_features
from slotline.session import stage
from slotline.streaming.live import live_features

add = CATALOG.add
CONTEXT = "neighbor_utilization_mean neighbor_queue_mean neighbor_stress_mean mean_neighbor_distance"


def staged_slots(spark, d):
    """The clean table, written once and read by every branch that follows."""
    return stage(build_clean(A.observations(spark, d)), "slots")


def graph(slots):
    """The neighbour table, written once like the slot table: k rows per site."""
    return stage(spatial.knn_graph(spatial.canonical_sites(slots)), "edges")


def feature_rows(spark, d):
    slots = staged_slots(spark, d)
    return build_features(slots, graph(slots))


@add(
    "knn_graph",
    A.final(
        """SELECT system_code, neighbor_code, distance,
      (1/greatest(distance, 1e-6)) / sum(1/greatest(distance, 1e-6)) OVER (PARTITION BY system_code) AS weight
      FROM pairs WHERE rn <= 3""",
        "distance weight",
        "system_code neighbor_code",
        """WITH sites AS (SELECT vec_id AS system_code, CAST(embedding[1] AS DOUBLE) AS lat,
      CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings),
    pairs AS (SELECT *, row_number() OVER (PARTITION BY system_code ORDER BY distance, neighbor_code) AS rn FROM (
      SELECT a.system_code, b.system_code AS neighbor_code,
        sqrt((a.lat-b.lat)*(a.lat-b.lat) + (a.lon-b.lon)*(a.lon-b.lon)) AS distance
      FROM sites a JOIN sites b ON a.system_code <> b.system_code))""",
    ),
)
def knn_graph(spark, d):
    return spatial.knn_graph(spatial.canonical_sites(A.sites(spark, d)))


@add(
    "neighbor_context",
    A.final(
        "SELECT s.system_code, s.time_slot, " + ", ".join("c." + c for c in CONTEXT.split())
        + " FROM slots s LEFT JOIN context c ON s.system_code = c.system_code AND s.time_slot = c.time_slot",
        CONTEXT,
        "",
        A.with_ctes("context"),
    ),
)
def neighbor_context(spark, d):
    slots = staged_slots(spark, d)
    return spatial.neighbour_context(slots, graph(slots)).select("system_code", "time_slot", *CONTEXT.split())


@add(
    "asof_join",
    A.final(
        """SELECT l.event_id, l.user_id, l.ts, r.event_id AS view_id, r.ts AS view_ts, r.value AS view_value
      FROM (SELECT * FROM events WHERE event_type = 'purchase') l
      ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn
        FROM events WHERE event_type = 'view') WHERE rn = 1) r
      ON l.user_id = r.user_id AND l.ts >= r.ts""",
        "view_value",
        "event_id user_id view_id",
    ),
)
def _asof_join(spark, d):
    events = A.table(spark, d, "events")
    left = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = events.where(F.col("event_type") == "view")
    wanted = {"event_id": "view_id", "ts": "view_ts", "value": "view_value"}
    return asof_join(left, right, ["user_id"], "ts", "ts", wanted, tie_break="event_id")


@add(
    "asof_join_dense",
    A.final(
        """SELECT l.event_id, l.ts, r.event_id AS seen_id, r.value AS seen_value
      FROM (SELECT * FROM crowded WHERE event_id % 2 = 1) l
      ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client, ts ORDER BY event_id DESC) AS rn
        FROM crowded WHERE event_id % 2 = 0) WHERE rn = 1) r
      ON l.client = r.client AND l.ts >= r.ts""",
        "seen_value",
        "event_id seen_id",
        """WITH crowded AS (SELECT event_id, value, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS client,
      CASE WHEN user_id % 3 = 0 THEN make_timestamp(1704067200000000 + event_id % 4 * 20000000 + event_id % 900) ELSE ts END AS ts FROM events)""",
    ),
)
def asof_join_dense(spark, d):
    """A third of all rows belong to one key and lie within a minute, many at one instant; buckets with more than a fiftieth of the rows are cut."""
    events = A.table(spark, d, "events")
    hot = F.col("user_id") % 3 == 0
    crowd = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id") % 4 * 20_000_000 + F.col("event_id") % 900)
    rows = events.select(
        "event_id", "value", F.when(hot, F.lit(-1)).otherwise(F.col("user_id")).alias("client"), F.when(hot, crowd).otherwise(F.col("ts")).alias("ts")
    )
    left = rows.where(F.col("event_id") % 2 == 1).select("event_id", "client", "ts")
    out = asof_join(left, rows.where(F.col("event_id") % 2 == 0), ["client"], "ts", "ts", {"event_id": "seen_id", "value": "seen_value"}, tie_break="event_id", full=max(2, events.count() // 50))
    return out.select("event_id", "ts", "seen_id", "seen_value")


_ASOF_SQL = A.with_ctes("edges") + """,
asked AS (SELECT s.system_code, s.time_slot, e.neighbor_code, e.distance, e.weight
  FROM slots s JOIN edges e ON e.system_code = s.system_code),
matched AS (SELECT a.*, h.utilization, h.queue_length, h.parking_stress_index, h.time_slot AS seen
  FROM asked a ASOF LEFT JOIN slots h ON a.neighbor_code = h.system_code AND a.time_slot >= h.time_slot),
nearby AS (SELECT system_code, time_slot, coalesce(sum(weight*utilization), 0) AS neighbor_utilization_mean,
  coalesce(sum(weight*queue_length), 0) AS neighbor_queue_mean,
  coalesce(sum(weight*parking_stress_index), 0) AS neighbor_stress_mean,
  coalesce(sum(CASE WHEN seen IS NOT NULL THEN distance END), 0)/count(*) AS mean_neighbor_distance
  FROM matched GROUP BY system_code, time_slot)"""


@add(
    "asof_neighbor_context",
    A.final("SELECT * FROM nearby", CONTEXT, "", _ASOF_SQL),
)
def asof_neighbor_context(spark, d):
    slots = staged_slots(spark, d)
    return spatial.asof_neighbour_context(slots.select("system_code", "time_slot"), slots, graph(slots))


MODEL_DOUBLES = """latitude longitude occupancy queue_length occupancy_raw occupancy_clean available_spaces
 utilization hour_sin hour_cos dow_sin dow_cos capacity_pressure parking_stress_index minutes_from_previous
 session_progress lag_utilization_prev_day lag_queue_prev_day lag_stress_prev_day lag_occupancy_30m
 lag_occupancy_60m lag_utilization_30m lag_utilization_60m lag_utilization_120m lag_queue_30m
 rolling_utilization_3 rolling_utilization_6 rolling_queue_3 rolling_queue_6 rolling_stress_3
 target_occupancy_1h target_available_spaces_1h target_utilization_1h target_stress_1h target_utilization_30m
 target_available_spaces_30m target_utilization_2h target_available_spaces_2h neighbor_utilization_mean
 neighbor_queue_mean neighbor_stress_mean mean_neighbor_distance utilization_delta_30m utilization_delta_60m
 spatial_utilization_gap"""
MODEL_LONGS = """record_id capacity is_special_day occupancy_anomaly_flag month day day_of_week is_weekend hour
 minute slot_index traffic_level vehicle_priority session_id session_step session_size"""


@add(
    "model_dataset",
    A.final("SELECT * FROM model", MODEL_DOUBLES, MODEL_LONGS, A.with_ctes("model")),
)
def model_dataset(spark, d):
    from slotline import fixed

    return feature_rows(spark, d).dropna(subset=fixed.REQUIRED_FEATURES)


_LK = "OVER (PARTITION BY system_code ORDER BY time_slot)"
_LIVE = [
    "lag_occupancy_30m", "lag_occupancy_60m", "lag_utilization_30m", "lag_utilization_60m",
    "lag_utilization_120m", "lag_queue_30m", "rolling_utilization_3", "rolling_utilization_6",
    "rolling_queue_3", "rolling_queue_6", "rolling_stress_3", "lag_utilization_prev_day",
    "lag_queue_prev_day", "lag_stress_prev_day", "utilization_delta_30m", "utilization_delta_60m",
    "minutes_from_previous", "session_progress", *CONTEXT.split(), "spatial_utilization_gap",
]


def _roll(c, n):
    return (
        f"avg({c}) OVER (PARTITION BY system_code ORDER BY time_slot "
        f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    )


def _carry(c):
    return (
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY system_code ORDER BY time_slot "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


# Own-history columns of a live row, from the slots expression.
LIVE_SQL = f""",
raw AS (SELECT *, lag(utilization) OVER (PARTITION BY system_code, slot_index ORDER BY time_slot) AS u0,
  lag(queue_length) OVER (PARTITION BY system_code, slot_index ORDER BY time_slot) AS q0,
  lag(parking_stress_index) OVER (PARTITION BY system_code, slot_index ORDER BY time_slot) AS s0
  FROM (SELECT * EXCLUDE (session_step, session_progress, session_size), session_step FROM slots)),
live AS (SELECT system_code, time_slot, utilization, session_step, minutes_from_previous,
  session_step/CAST(session_step + 1 AS DOUBLE) AS session_progress,
  lag(occupancy_clean, 1) {_LK} AS lag_occupancy_30m, lag(occupancy_clean, 2) {_LK} AS lag_occupancy_60m,
  lag(utilization, 1) {_LK} AS lag_utilization_30m, lag(utilization, 2) {_LK} AS lag_utilization_60m,
  lag(utilization, 4) {_LK} AS lag_utilization_120m, lag(queue_length, 1) {_LK} AS lag_queue_30m,
  {_roll('utilization', 3)} AS rolling_utilization_3, {_roll('utilization', 6)} AS rolling_utilization_6,
  {_roll('queue_length', 3)} AS rolling_queue_3, {_roll('queue_length', 6)} AS rolling_queue_6,
  {_roll('parking_stress_index', 3)} AS rolling_stress_3, {_carry('u0')} AS lag_utilization_prev_day,
  {_carry('q0')} AS lag_queue_prev_day, {_carry('s0')} AS lag_stress_prev_day FROM raw)"""


@add(
    "live_features",
    A.final(
        "SELECT system_code, time_slot, session_step, " + ", ".join(_LIVE) + " FROM together",
        " ".join(_LIVE),
        "session_step",
        _ASOF_SQL + LIVE_SQL + """,
together AS (SELECT l.*, n.* EXCLUDE (system_code, time_slot),
  utilization - lag_utilization_30m AS utilization_delta_30m,
  utilization - lag_utilization_60m AS utilization_delta_60m,
  utilization - neighbor_utilization_mean AS spatial_utilization_gap
  FROM live l JOIN nearby n ON n.system_code = l.system_code AND n.time_slot = l.time_slot)""",
    ),
)
def _live_features(spark, d):
    slots = staged_slots(spark, d)
    return live_features(slots, graph(slots)).select("system_code", "time_slot", "session_step", *_LIVE)
