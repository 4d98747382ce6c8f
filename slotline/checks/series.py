"""Sources, cleaning, projections and windows over the slot series."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline import fixed
from slotline.checks import adapters as A
from slotline.checks.catalog import CATALOG
from slotline.functions import columns as X
from slotline.operators import timeseries as ts
from slotline.operators.profile import key_catalog
from slotline.plans.features import build_clean, enrich_slots
from slotline.session import scratch_path
from slotline.sources import tables as S
from slotline.streaming.ingest import validate

add = CATALOG.add
SLOT_TYPES = ["system_code", "time_slot"]


def aggregated(spark, d):
    return ts.slot_aggregate(A.observations(spark, d))


def enriched(spark, d):
    return enrich_slots(aggregated(spark, d))


def slots(spark, d):
    return build_clean(A.observations(spark, d))


# --- sources and sinks ------------------------------------------------------

OBS_NAMES = ", ".join(A.OBS_COLUMNS)


@add(
    "scan_observations",
    A.final(
        f"SELECT {OBS_NAMES} FROM obs",
        "occupancy latitude longitude",
        "record_id capacity queue_length is_special_day",
        A.with_ctes("obs"),
    ),
)
def scan_observations(spark, d):
    """The feed written in its source CSV shape and read back through the declared reader."""
    back = {v: k for k, v in fixed.SOURCE_HEADER.items()}
    path = scratch_path(spark, "csv")
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    feed = A.observations(spark, d).withColumnsRenamed(back).select(*fixed.SOURCE_HEADER)
    feed.write.option("header", True).option("timestampFormat", stamp).csv(path)
    return S.read_observations_csv(spark, path, timestamp_format=stamp)


@add(
    "scan_damaged",
    """SELECT CAST(count(*) FILTER (WHERE event_id % 10 > 2) AS BIGINT) AS readable,
  CAST(count(*) FILTER (WHERE event_id % 10 <= 2) AS BIGINT) AS damaged,
  CAST(sum(event_id) FILTER (WHERE event_id % 10 > 2) AS BIGINT) AS readable_ids FROM events""",
)
def scan_damaged(spark, d):
    """The feed with unreadable times, numbers and field counts in three rows of ten: all rows are found on one side."""
    back = {v: k for k, v in fixed.SOURCE_HEADER.items()}
    path = scratch_path(spark, "csv")
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    kind = F.col("record_id") % 10
    feed = A.observations(spark, d).withColumn("timestamp", F.date_format("timestamp", stamp))
    feed = feed.withColumn("timestamp", F.when(kind == 0, F.lit("noon-ish")).otherwise(F.col("timestamp")))
    feed = feed.withColumn("occupancy", F.when(kind == 1, F.lit("many")).otherwise(F.col("occupancy").cast("string")))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fixed.SOURCE_HEADER.values()]
    line = F.when(kind == 2, F.concat_ws(",", *texts, F.lit("surplus"))).otherwise(F.concat_ws(",", *texts))
    feed.select(F.when(line.isNull(), "").otherwise(line).alias("value")).write.text(path)
    good, damaged = S.split_observations_csv(spark, path, timestamp_format=stamp, header=False)
    sums = good.agg(F.count(F.lit(1)).alias("readable"), F.sum("record_id").alias("readable_ids"))
    return sums.crossJoin(damaged.agg(F.count(F.lit(1)).alias("damaged"))).select("readable", "damaged", "readable_ids")


@add("key_catalog", "SELECT DISTINCT event_type AS system_code FROM events WHERE event_type IS NOT NULL")
def _key_catalog(spark, d):
    return key_catalog(A.observations(spark, d), "system_code")


@add(
    "write_read_roundtrip",
    A.final(
        "SELECT system_code, time_slot, date, utilization, queue_length, session_id FROM slots",
        "utilization queue_length",
        "session_id",
        A.with_ctes("slots"),
    ),
)
def write_read_roundtrip(spark, d):
    path = scratch_path(spark, "slots")
    S.write_table(slots(spark, d), path, partition_by=["date"])
    names = ["system_code", "time_slot", "date", "utilization", "queue_length", "session_id"]
    return S.read_table(spark, path, names).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@add(
    "payload_roundtrip",
    A.final(
        "SELECT record_id, system_code, timestamp, occupancy, traffic_condition_nearby FROM obs",
        "occupancy",
        "record_id",
        A.with_ctes("obs"),
    ),
)
def payload_roundtrip(spark, d):
    names = ["record_id", "system_code", "timestamp", "occupancy", "traffic_condition_nearby"]
    rows = A.observations(spark, d).select(*names)
    return S.decode_payload(S.encode_payload(rows, ["system_code"]), rows.schema)


# --- projections ------------------------------------------------------------


@add("slot_round", A.final("SELECT record_id, timestamp, time_slot FROM placed", "", "record_id", A.with_ctes("placed")))
def slot_round(spark, d):
    rows = A.observations(spark, d)
    return rows.select("record_id", "timestamp", X.slot_round("timestamp").alias("time_slot"))


_MEASURES = "occupancy_raw occupancy_clean queue_length available_spaces utilization"


@add(
    "clean_measures",
    A.final(
        "SELECT system_code, time_slot, capacity, occupancy_anomaly_flag, "
        + ", ".join(_MEASURES.split())
        + " FROM clean",
        _MEASURES,
        "capacity occupancy_anomaly_flag",
        A.with_ctes("clean"),
    ),
)
def clean_measures(spark, d):
    return ts.clean_measures(aggregated(spark, d)).select(
        *SLOT_TYPES, "capacity", "occupancy_anomaly_flag", *_MEASURES.split()
    )


_CALENDAR = "date month day day_of_week day_name is_weekend hour minute slot_index hour_sin hour_cos dow_sin dow_cos"


@add(
    "calendar_features",
    A.final(
        "SELECT system_code, time_slot, " + ", ".join(_CALENDAR.split()) + " FROM clean",
        "hour_sin hour_cos dow_sin dow_cos",
        "month day day_of_week is_weekend hour minute slot_index",
        A.with_ctes("clean"),
    ),
)
def calendar_features(spark, d):
    return ts.calendar_features(aggregated(spark, d)).select(*SLOT_TYPES, *_CALENDAR.split())


@add(
    "ordinal_encode",
    A.final(
        """SELECT record_id,
      CASE lower(traffic_condition_nearby) WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END AS traffic_level,
      CASE lower(vehicle_type) WHEN 'cycle' THEN 0 WHEN 'bike' THEN 1 WHEN 'car' THEN 2 WHEN 'truck' THEN 3
        ELSE 1 END AS vehicle_priority FROM obs""",
        "",
        "record_id traffic_level vehicle_priority",
        A.with_ctes("obs"),
    ),
)
def ordinal_encode(spark, d):
    return ts.ordinal_levels(A.observations(spark, d)).select("record_id", "traffic_level", "vehicle_priority")


@add(
    "stress_index",
    A.final(
        "SELECT system_code, time_slot, capacity_pressure, parking_stress_index FROM stressed",
        "capacity_pressure parking_stress_index",
        "",
        A.with_ctes("stressed"),
    ),
)
def stress_index(spark, d):
    return enriched(spark, d).select(*SLOT_TYPES, "capacity_pressure", "parking_stress_index")


_BAND_VALUE = "(l_quantity + l_partkey % 7 - 3)/50"


@add(
    "band_values",
    f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  {A.band_sql(_BAND_VALUE, fixed.UTILIZATION_EDGES, fixed.UTILIZATION_LABELS)} AS utilization_band,
  {A.band_sql(_BAND_VALUE, fixed.REGIME_EDGES, fixed.REGIME_LABELS)} AS demand_regime,
  {A.band_sql(_BAND_VALUE, fixed.RISK_EDGES, fixed.RISK_LABELS)} AS risk_band FROM lineitem""",
)
def band_values(spark, d):
    rows = A.table(spark, d, "lineitem")
    v = F.expr(_BAND_VALUE)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        X.utilization_band(v).alias("utilization_band"),
        X.demand_regime(v).alias("demand_regime"),
        X.risk_band(v).alias("risk_band"),
    )


@add(
    "risk_band_total",
    f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN {_BAND_VALUE} <= 0.55 THEN 'Low'
  WHEN {_BAND_VALUE} <= 0.75 THEN 'Moderate' WHEN {_BAND_VALUE} <= 0.9 THEN 'High' ELSE 'Critical' END AS risk_band
  FROM lineitem""",
)
def risk_band_total(spark, d):
    v = F.expr(_BAND_VALUE)
    return A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", X.risk_band_total(v).alias("risk_band")
    )


@add(
    "low_availability",
    A.final(
        "SELECT system_code, predicted_available_spaces_1h, predicted_free_ratio FROM scored "
        "WHERE predicted_available_spaces_1h <= 50 OR predicted_free_ratio <= 0.05",
        "predicted_available_spaces_1h predicted_free_ratio",
        "",
        A.BOARD_SQL,
    ),
)
def low_availability(spark, d):
    from slotline.operators.decide import score_board

    return (
        score_board(A.board(spark, d))
        .where(X.low_availability())
        .select("system_code", "predicted_available_spaces_1h", "predicted_free_ratio")
    )


@add(
    "model_name_filter",
    A.final(
        "SELECT p_brand, count(*) AS n, avg(p_size) AS mean_size FROM part WHERE lower(p_brand) LIKE '%brand#1%' "
        "GROUP BY p_brand",
        "mean_size",
        "n",
    ),
)
def model_name_filter(spark, d):
    """Case-insensitive contains, then a mean over the rows kept."""
    rows = A.table(spark, d, "part").where(F.lower("p_brand").contains("BRAND#1".lower()))
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("mean_size"))


@add(
    "reason_code",
    A.with_ctes("features")
    + f"""
SELECT system_code, time_slot, CASE WHEN queue_length >= 8 AND utilization >= 0.85 THEN '{fixed.REASON_QUEUE}'
  WHEN spatial_utilization_gap >= 0.2 THEN '{fixed.REASON_SPATIAL}'
  WHEN capacity_pressure >= 0.02 THEN '{fixed.REASON_PRESSURE}' ELSE '{fixed.REASON_OTHER}' END AS anomaly_reason
FROM features""",
)
def reason_code(spark, d):
    from slotline.checks.context import feature_rows

    return feature_rows(spark, d).select(*SLOT_TYPES, X.anomaly_reason().alias("anomaly_reason"))


@add(
    "quarantine_rows",
    """WITH raw AS (SELECT event_id,
  CASE WHEN event_id % 11 = 0 THEN 'nowhere' ELSE event_type END AS system_code,
  CASE WHEN event_id % 13 = 0 THEN -value ELSE value END AS occupancy,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 35 AS queue_length, user_id % 3 AS is_special_day,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(10*(user_id % 9) AS DOUBLE) END AS capacity,
  CASE WHEN event_id % 19 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp,
  CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'average' WHEN 2 THEN 'high' ELSE 'jam' END AS traffic FROM events),
known AS (SELECT DISTINCT event_type AS system_code FROM events),
judged AS (SELECT r.*,
  concat_ws(',', CASE WHEN r.system_code NOT IN (SELECT system_code FROM known) THEN 'unknown_key' END,
   CASE WHEN occupancy < 0 THEN 'occupancy' END,
   CASE WHEN queue_length < 0 OR queue_length > 30 THEN 'queue_length' END,
   CASE WHEN is_special_day < 0 OR is_special_day > 1 THEN 'is_special_day' END,
   CASE WHEN capacity <= 0 THEN 'capacity' END,
   CASE WHEN try_cast(stamp AS TIMESTAMP) IS NULL THEN 'timestamp' END,
   CASE WHEN traffic NOT IN ('low','average','high') THEN 'traffic_condition_nearby' END) AS problems FROM raw r)
SELECT event_id, system_code, problems, problems = '' AS is_valid FROM judged""",
)
def quarantine_rows(spark, d):
    """Every event judged; deliberately damaged rows go to quarantine with their reasons."""
    raw = A.table(spark, d, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 11 = 0 THEN 'nowhere' ELSE event_type END AS system_code",
        "CASE WHEN event_id % 13 = 0 THEN -value ELSE value END AS occupancy",
        "CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 35 AS INT) AS queue_length",
        "CAST(user_id % 3 AS INT) AS is_special_day",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(10*(user_id % 9) AS DOUBLE) END AS capacity",
        "CASE WHEN event_id % 19 = 0 THEN 'not a time' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS timestamp",
        "CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'average' WHEN 2 THEN 'high' ELSE 'jam' END "
        "AS traffic_condition_nearby",
    )
    known = A.table(spark, d, "events").select(F.col("event_type").alias("system_code")).distinct()
    return validate(raw, known).select("event_id", "system_code", "problems", "is_valid")


# --- slot table and windows -------------------------------------------------

_AGG_D = "latitude longitude occupancy queue_length"
_AGG_L = "record_id capacity is_special_day"


@add(
    "slot_aggregate",
    A.final(
        "SELECT system_code, time_slot, timestamp, vehicle_type, traffic_condition_nearby, "
        + ", ".join((_AGG_D + " " + _AGG_L).split())
        + " FROM agg",
        _AGG_D,
        _AGG_L,
        A.with_ctes("agg"),
    ),
)
def slot_aggregate(spark, d):
    return aggregated(spark, d)


@add(
    "mode_by_group",
    """WITH m AS (SELECT o_custkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
  FROM orders GROUP BY o_custkey, o_orderpriority)
SELECT o_custkey, o_orderpriority AS usual_priority FROM m WHERE rn = 1""",
)
def mode_by_group(spark, d):
    rows = A.table(spark, d, "orders")
    return rows.groupBy("o_custkey").agg(ts.mode_smallest("o_orderpriority").alias("usual_priority"))


@add(
    "sessionize",
    A.final(
        "SELECT system_code, time_slot, is_new_session, session_id, minutes_from_previous FROM sessions",
        "minutes_from_previous",
        "session_id",
        A.with_ctes("sessions"),
    ),
)
def sessionize(spark, d):
    return ts.sessionize(aggregated(spark, d)).select(
        *SLOT_TYPES, "is_new_session", "session_id", "minutes_from_previous"
    )


@add(
    "session_progress",
    A.final(
        "SELECT system_code, time_slot, session_step, session_size, session_progress FROM slots",
        "session_progress",
        "session_step session_size",
        A.with_ctes("slots"),
    ),
)
def session_progress(spark, d):
    rows = ts.sessionize(aggregated(spark, d)).transform(ts.session_progress)
    return rows.select(*SLOT_TYPES, "session_step", "session_size", "session_progress")


def _window_query(name, columns, stamps, build):
    names = list(columns)
    doubles = [c for c in names if c not in stamps]
    sql = A.final(
        "SELECT system_code, time_slot, " + ", ".join(names) + " FROM lagged",
        " ".join(doubles),
        "",
        A.with_ctes("lagged"),
    )
    add(name, sql)(lambda spark, d: build(slots(spark, d)).select(*SLOT_TYPES, *names))


_window_query("prev_day_lag", ts.PREVIOUS_DAY_LAGS, [], ts.previous_day_lags)
_window_query("session_lags", ts.IN_SESSION_LAGS, [], lambda s: ts.lags(s, ts.IN_SESSION_LAGS))
_window_query("rolling_means", ts.ROLLING_MEANS, [], ts.rolling_means)
_window_query(
    "lead_targets",
    ts.LEAD_TARGETS,
    ["target_time_slot", "target_time_slot_30m", "target_time_slot_2h"],
    ts.leads,
)

_K = "OVER (PARTITION BY system_code ORDER BY time_slot)"
_KR = "OVER (PARTITION BY system_code ORDER BY time_slot ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@add(
    "key_lags",
    A.final(
        f"""SELECT system_code, time_slot, lag(occupancy_clean, 1) {_K} AS lag_occupancy_30m,
      lag(occupancy_clean, 2) {_K} AS lag_occupancy_60m, lag(utilization, 1) {_K} AS lag_utilization_30m,
      lag(utilization, 2) {_K} AS lag_utilization_60m, lag(utilization, 4) {_K} AS lag_utilization_120m,
      lag(queue_length, 1) {_K} AS lag_queue_30m, avg(utilization) {_KR.format(n=3)} AS rolling_utilization_3,
      avg(utilization) {_KR.format(n=6)} AS rolling_utilization_6, avg(queue_length) {_KR.format(n=3)} AS rolling_queue_3,
      avg(queue_length) {_KR.format(n=6)} AS rolling_queue_6,
      avg(parking_stress_index) {_KR.format(n=3)} AS rolling_stress_3 FROM stressed""",
        " ".join([*ts.IN_SESSION_LAGS, *ts.ROLLING_MEANS]),
        "",
        A.with_ctes("stressed"),
    ),
)
def key_lags(spark, d):
    rows = enriched(spark, d)
    return (
        rows.transform(ts.lags, ts.IN_SESSION_LAGS, ("system_code",))
        .transform(ts.rolling_means, ts.ROLLING_MEANS, ("system_code",))
        .select(*SLOT_TYPES, *ts.IN_SESSION_LAGS, *ts.ROLLING_MEANS)
    )


@add(
    "latest_per_key",
    A.final(
        """SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
        "value",
        "user_id event_id",
    ),
)
def latest_per_key(spark, d):
    rows = A.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return ts.latest_per_key(rows, "user_id", ["ts", "event_id"])


@add(
    "sequence_windows",
    A.with_ctes("slots")
    + """,
windowed AS (SELECT system_code, session_id, time_slot,
  list([utilization, queue_length, hour_sin]) OVER (PARTITION BY system_code, session_id ORDER BY time_slot
    ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sequence,
  lead(time_slot, 2) OVER (PARTITION BY system_code, session_id ORDER BY time_slot) AS target_time_slot,
  lead(utilization, 2) OVER (PARTITION BY system_code, session_id ORDER BY time_slot) AS target_value,
  count(*) OVER (PARTITION BY system_code, session_id) AS n FROM slots)
SELECT system_code, CAST(session_id AS BIGINT) AS session_id, time_slot, target_time_slot,
  round_even(target_value*1e6 + 1e-4, 0)/1e6 + 0.0 AS target_value,
  array_to_string(list_transform(flatten(sequence), lambda x : CAST(CAST(round_even(x*1e6 + 1e-4, 0) AS BIGINT) AS VARCHAR)), ',')
    AS sequence
FROM windowed WHERE n >= 9 AND len(sequence) = 6 AND target_time_slot IS NOT NULL""",
)
def sequence_windows(spark, d):
    rows = ts.sequence_windows(slots(spark, d), ("utilization", "queue_length", "hour_sin"))
    text = F.transform(F.flatten("sequence"), lambda x: F.rint(x * 1e6 + 1e-4).cast("long").cast("string"))
    return rows.select(
        "system_code", "session_id", "time_slot", "target_time_slot", "target_value",
        F.array_join(text, ",").alias("sequence"),
    )


@add(
    "dedupe_keep_first",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1",
)
def dedupe_keep_first(spark, d):
    rows = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ts.first_per_key(rows, "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")])


@add(
    "history_union",
    A.final(
        """SELECT system_code, time_slot, utilization, queue_length FROM stressed WHERE minute = 0
      UNION ALL SELECT system_code, time_slot, utilization, NULL FROM stressed WHERE minute <> 0""",
        "utilization queue_length",
        "",
        A.with_ctes("stressed"),
    ),
)
def history_union(spark, d):
    rows = enriched(spark, d)
    base = rows.where(F.col("minute") == 0).select("system_code", "time_slot", "utilization", "queue_length")
    live = rows.where(F.col("minute") != 0).select("system_code", "time_slot", "utilization", "day_name")
    return S.union_history(base, live)
