"""The given tables in the shapes the operators take, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotline.session import pin_time_zone

# Shared text: valid in Spark SQL and in DuckDB.
OBS_COLUMNS = {
    "record_id": "event_id",
    "system_code": "event_type",
    "timestamp": "ts",
    "capacity": "60 + 20*(user_id % 3)",
    "occupancy": "value",
    "queue_length": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 15",
    "traffic_condition_nearby": "CASE user_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'average' WHEN 2 THEN 'high' END",
    "vehicle_type": "CASE user_id % 5 WHEN 0 THEN 'cycle' WHEN 1 THEN 'bike' WHEN 2 THEN 'car' "
    "WHEN 3 THEN 'truck' ELSE 'van' END",
    "is_special_day": "CASE WHEN extract(day FROM ts) % 7 = 0 THEN 1 ELSE 0 END",
    "latitude": "CAST(26.0 + 0.01*length(event_type) + 0.003*ascii(event_type) + 1e-9*(event_id % 3) AS DOUBLE)",
    "longitude": "CAST(91.0 + 0.02*length(event_type) + 1e-9*(event_id % 3) AS DOUBLE)",
}
BOARD_COLUMNS = {
    "system_code": "p_partkey",
    "capacity": "CAST(floor(p_retailprice) AS BIGINT)",
    "utilization": "CAST((p_size * 7) % 50 AS DOUBLE) / 50",
    "predicted_utilization_1h": "CAST(p_size AS DOUBLE) / 50",
    "queue_length": "p_partkey % 15",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its zone-less instants are read as UTC."""
    pin_time_zone(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    stamps = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else df


def observations(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    columns = {**OBS_COLUMNS, "system_code": key}
    return table(spark, folder, "events").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("system_code"),
        F.element_at("embedding", 1).cast("double").alias("latitude"),
        F.element_at("embedding", 2).cast("double").alias("longitude"),
    )


def forecasts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        (F.col("l_quantity") / 50).alias("actual"),
        ((F.col("l_quantity") + F.col("l_partkey") % 7 - 3) / 50).alias("predicted"),
        F.col("l_shipdate").alias("target_time_slot"),
    )


def board(spark: SparkSession, folder: str, changed: dict[str, str] | None = None) -> DataFrame:
    """A forecast board, one row per part; ``changed`` expressions take the place of the usual ones."""
    predicted = F.col("predicted_utilization_1h")
    end = lambda v: F.when(
        F.col("system_code") % 10 != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    )
    return (
        table(spark, folder, "part")
        .selectExpr(*[f"{e} AS {c}" for c, e in (BOARD_COLUMNS | (changed or {})).items()])
        .withColumns(
            {
                "prediction_interval_lower": end(predicted - 0.0436),
                "prediction_interval_upper": end(predicted + 0.0436),
                "capacity_pressure": F.col("queue_length") / F.col("capacity"),
                "predicted_available_spaces_1h": F.rint(F.col("capacity") * (1 - predicted)),
                "occupancy_clean": F.col("capacity") * F.col("utilization"),
            }
        )
        .withColumn(
            "uncertainty_width", F.col("prediction_interval_upper") - F.col("prediction_interval_lower")
        )
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("method"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("user_id").alias("client_host"),
        F.col("value").alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def audit(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .select(
            F.col("event_id"),
            F.col("event_type"),
            F.lit("service").alias("actor"),
            F.col("props").alias("payload_json"),
            F.col("ts").alias("created_at"),
        )
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "queued")
        .when(kind.isin("view", "click"), "running")
        .when(kind == "purchase", "completed")
        .when(kind == "error", "failed")
    )
    return (
        table(spark, folder, "events")
        .select(
            F.col("user_id").alias("job_id"),
            status.alias("status"),
            F.col("props").alias("message"),
            F.col("ts").alias("at"),
            "event_id",
        )
    )


def tidy(df: DataFrame) -> DataFrame:
    """Comparable values: doubles to six digits, whole numbers as long, instants without zone.

    The nudge of 1e-10 keeps exact ties from being decided by the order in which a sum was added up.
    """
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.rint(c.cast("double") * F.lit(1e6) + F.lit(1e-4)) / F.lit(1e6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- SQL side ---------------------------------------------------------------


def r6(expression: str) -> str:
    return f"round_even(({expression})*1e6 + 1e-4, 0)/1e6 + 0.0"


def final(query: str, doubles: str = "", longs: str = "", ctes: str = "") -> str:
    """The oracle's last step, the counterpart of ``tidy``."""
    edits = [f"{r6(c)} AS {c}" for c in doubles.split()]
    edits += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    body = f"SELECT * REPLACE ({', '.join(edits)}) FROM ({query}) AS q" if edits else query
    return f"{ctes}\n{body}" if ctes else body


def slot_sql(column: str) -> str:
    return f"make_timestamp(CAST(round_even(epoch_us({column})/1800000000.0, 0) AS BIGINT)*1800000000)"


def clip_sql(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"CASE WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END"


def band_sql(x: str, edges: list[float], labels: list[str]) -> str:
    whens = " ".join(f"WHEN {x} <= {e} THEN '{label}'" for e, label in zip(edges[1:], labels))
    return f"CASE WHEN {x} IS NULL OR {x} < {edges[0]} THEN 'nan' {whens} ELSE 'nan' END"


OBS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in OBS_COLUMNS.items()) + " FROM events"

_MODE = """
  SELECT system_code, time_slot, {c} FROM (
    SELECT system_code, time_slot, {c},
      row_number() OVER (PARTITION BY system_code, time_slot ORDER BY count(*) DESC, {c}) AS rn
    FROM placed WHERE {c} IS NOT NULL GROUP BY system_code, time_slot, {c}) WHERE rn = 1"""

_W = "OVER (PARTITION BY system_code, session_id ORDER BY time_slot)"
_R = "OVER (PARTITION BY system_code, session_id ORDER BY time_slot ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

CTES = {
    "obs": OBS_SQL,
    "placed": f"SELECT *, {slot_sql('timestamp')} AS time_slot FROM obs",
    "vmode": _MODE.format(c="vehicle_type"),
    "tmode": _MODE.format(c="traffic_condition_nearby"),
    "agg": """
  SELECT p.*, v.vehicle_type, t.traffic_condition_nearby FROM (
    SELECT system_code, time_slot, min(record_id) AS record_id, min(timestamp) AS timestamp,
      max(capacity) AS capacity, max(is_special_day) AS is_special_day, avg(latitude) AS latitude,
      avg(longitude) AS longitude, avg(occupancy) AS occupancy, avg(queue_length) AS queue_length
    FROM placed GROUP BY system_code, time_slot) p
  LEFT JOIN vmode v USING (system_code, time_slot) LEFT JOIN tmode t USING (system_code, time_slot)""",
    "measured": """
  SELECT * REPLACE (CASE WHEN queue_length < 0 THEN 0 ELSE queue_length END AS queue_length),
    occupancy AS occupancy_raw,
    CASE WHEN least(occupancy, CAST(capacity AS DOUBLE)) < 0 THEN 0.0
      ELSE least(occupancy, CAST(capacity AS DOUBLE)) END AS occupancy_clean,
    CASE WHEN occupancy > capacity THEN 1 ELSE 0 END AS occupancy_anomaly_flag
  FROM agg""",
    "clean": f"""
  SELECT m.*, capacity - occupancy_clean AS available_spaces,
    {clip_sql('(occupancy_clean / capacity)')} AS utilization,
    strftime(time_slot, '%Y-%m-%d') AS date, month(time_slot) AS month, day(time_slot) AS day,
    isodow(time_slot) - 1 AS day_of_week, dayname(time_slot) AS day_name,
    CASE WHEN isodow(time_slot) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    hour(time_slot) AS hour, minute(time_slot) AS minute,
    hour(time_slot)*2 + minute(time_slot)//30 AS slot_index,
    sin(2*pi()*hour(time_slot)/24) AS hour_sin, cos(2*pi()*hour(time_slot)/24) AS hour_cos,
    sin(2*pi()*(isodow(time_slot)-1)/7) AS dow_sin, cos(2*pi()*(isodow(time_slot)-1)/7) AS dow_cos,
    CASE lower(traffic_condition_nearby) WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END AS traffic_level,
    CASE lower(vehicle_type) WHEN 'cycle' THEN 0 WHEN 'bike' THEN 1 WHEN 'car' THEN 2 WHEN 'truck' THEN 3
      ELSE 1 END AS vehicle_priority,
    queue_length / greatest(capacity, 1) AS capacity_pressure
  FROM measured m""",
    "stressed": f"""
  SELECT *, {clip_sql('(CAST(0.7 AS DOUBLE)*utilization + CAST(0.2 AS DOUBLE)*traffic_level/2 + CAST(0.1 AS DOUBLE)*capacity_pressure)')}
    AS parking_stress_index FROM clean""",
    "gaps": """
  SELECT *, epoch(time_slot) - epoch(lag(time_slot) OVER (PARTITION BY system_code ORDER BY time_slot)) AS gap
  FROM stressed""",
    "sessions": """
  SELECT * EXCLUDE (gap), gap IS NULL OR gap <> 1800 AS is_new_session,
    sum(CASE WHEN gap IS NULL OR gap <> 1800 THEN 1 ELSE 0 END)
      OVER (PARTITION BY system_code ORDER BY time_slot ROWS UNBOUNDED PRECEDING) AS session_id,
    coalesce(gap/60.0, 0.0) AS minutes_from_previous
  FROM gaps""",
    "slots": f"""
  SELECT *, (row_number() {_W}) - 1 AS session_step,
    count(record_id) OVER (PARTITION BY system_code, session_id) AS session_size,
    ((row_number() {_W}) - 1) / greatest(count(record_id) OVER (PARTITION BY system_code, session_id), 1)
      AS session_progress
  FROM sessions""",
    "sites": "SELECT system_code, avg(latitude) AS lat, avg(longitude) AS lon FROM slots GROUP BY system_code",
    "pairs": """
  SELECT *, row_number() OVER (PARTITION BY system_code ORDER BY distance, neighbor_code) AS rn FROM (
    SELECT a.system_code, b.system_code AS neighbor_code,
      sqrt((a.lat-b.lat)*(a.lat-b.lat) + (a.lon-b.lon)*(a.lon-b.lon)) AS distance
    FROM sites a JOIN sites b ON a.system_code <> b.system_code)""",
    "edges": """
  SELECT system_code, neighbor_code, distance,
    (1/greatest(distance, 1e-6)) / sum(1/greatest(distance, 1e-6)) OVER (PARTITION BY system_code) AS weight
  FROM pairs WHERE rn <= 3""",
    "context": """
  SELECT e.system_code, s.time_slot, coalesce(sum(weight*utilization), 0) AS neighbor_utilization_mean,
    coalesce(sum(weight*queue_length), 0) AS neighbor_queue_mean,
    coalesce(sum(weight*parking_stress_index), 0) AS neighbor_stress_mean,
    avg(distance) AS mean_neighbor_distance
  FROM edges e JOIN slots s ON s.system_code = e.neighbor_code GROUP BY e.system_code, s.time_slot""",
    "lagged": f"""
  SELECT s.*,
    lag(utilization) OVER (PARTITION BY system_code, slot_index ORDER BY time_slot) AS lag_utilization_prev_day,
    lag(queue_length) OVER (PARTITION BY system_code, slot_index ORDER BY time_slot) AS lag_queue_prev_day,
    lag(parking_stress_index) OVER (PARTITION BY system_code, slot_index ORDER BY time_slot) AS lag_stress_prev_day,
    lag(occupancy_clean, 1) {_W} AS lag_occupancy_30m, lag(occupancy_clean, 2) {_W} AS lag_occupancy_60m,
    lag(utilization, 1) {_W} AS lag_utilization_30m, lag(utilization, 2) {_W} AS lag_utilization_60m,
    lag(utilization, 4) {_W} AS lag_utilization_120m, lag(queue_length, 1) {_W} AS lag_queue_30m,
    avg(utilization) {_R.format(n=3)} AS rolling_utilization_3,
    avg(utilization) {_R.format(n=6)} AS rolling_utilization_6,
    avg(queue_length) {_R.format(n=3)} AS rolling_queue_3,
    avg(queue_length) {_R.format(n=6)} AS rolling_queue_6,
    avg(parking_stress_index) {_R.format(n=3)} AS rolling_stress_3,
    lead(time_slot, 2) {_W} AS target_time_slot, lead(occupancy_clean, 2) {_W} AS target_occupancy_1h,
    lead(available_spaces, 2) {_W} AS target_available_spaces_1h,
    lead(utilization, 2) {_W} AS target_utilization_1h, lead(parking_stress_index, 2) {_W} AS target_stress_1h,
    lead(time_slot, 1) {_W} AS target_time_slot_30m, lead(utilization, 1) {_W} AS target_utilization_30m,
    lead(available_spaces, 1) {_W} AS target_available_spaces_30m,
    lead(time_slot, 4) {_W} AS target_time_slot_2h, lead(utilization, 4) {_W} AS target_utilization_2h,
    lead(available_spaces, 4) {_W} AS target_available_spaces_2h
  FROM slots s""",
    "features": f"""
  SELECT l.*, c.* EXCLUDE (system_code, time_slot),
    utilization - lag_utilization_30m AS utilization_delta_30m,
    utilization - lag_utilization_60m AS utilization_delta_60m,
    utilization - neighbor_utilization_mean AS spatial_utilization_gap,
    {band_sql('target_stress_1h', [0.0, 0.35, 0.6, 0.8, 1.01], ['Stable', 'Busy', 'Congested', 'Critical'])}
      AS future_demand_regime,
    {band_sql('utilization', [0.0, 0.4, 0.7, 0.9, 1.01], ['Low', 'Moderate', 'High', 'Critical'])}
      AS current_utilization_band,
    {band_sql('target_utilization_1h', [0.0, 0.4, 0.7, 0.9, 1.01], ['Low', 'Moderate', 'High', 'Critical'])}
      AS target_utilization_band_1h
  FROM lagged l LEFT JOIN context c ON c.system_code = l.system_code AND c.time_slot = l.time_slot""",
    "model": """
  SELECT * FROM features WHERE lag_occupancy_30m IS NOT NULL AND lag_occupancy_60m IS NOT NULL
    AND lag_utilization_30m IS NOT NULL AND lag_utilization_60m IS NOT NULL
    AND lag_utilization_120m IS NOT NULL AND lag_queue_30m IS NOT NULL
    AND neighbor_utilization_mean IS NOT NULL AND neighbor_queue_mean IS NOT NULL
    AND neighbor_stress_mean IS NOT NULL AND lag_utilization_prev_day IS NOT NULL
    AND lag_queue_prev_day IS NOT NULL AND lag_stress_prev_day IS NOT NULL
    AND target_utilization_1h IS NOT NULL AND target_time_slot IS NOT NULL""",
}


def with_ctes(last: str) -> str:
    """The chain of table expressions up to ``last``."""
    names = list(CTES)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names[: names.index(last) + 1])


BOARD_SQL = (
    "WITH part_board AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in BOARD_COLUMNS.items())
    + """ FROM part),
board AS (SELECT b.*, upper0 - lower0 AS uncertainty_width, lower0 AS prediction_interval_lower,
  upper0 AS prediction_interval_upper FROM (
  SELECT *, CASE WHEN system_code % 10 <> 0
      THEN least(1.0, greatest(0.0, predicted_utilization_1h - CAST(0.0436 AS DOUBLE))) END AS lower0,
    CASE WHEN system_code % 10 <> 0
      THEN least(1.0, greatest(0.0, predicted_utilization_1h + CAST(0.0436 AS DOUBLE))) END AS upper0,
    queue_length / CAST(capacity AS DOUBLE) AS capacity_pressure,
    round_even(capacity*(1 - predicted_utilization_1h), 0) AS predicted_available_spaces_1h,
    capacity*utilization AS occupancy_clean
  FROM part_board) b),
scored AS (SELECT system_code, capacity, utilization, queue_length, occupancy_clean, capacity_pressure,
  predicted_utilization_1h, predicted_available_spaces_1h, lo AS prediction_interval_lower,
  up AS prediction_interval_upper, width AS uncertainty_width, free AS predicted_free_ratio,
  CAST(0.45 AS DOUBLE)*free + CAST(0.25 AS DOUBLE)*(1 - predicted_utilization_1h)
    + CAST(0.20 AS DOUBLE)*(1 - least(1.0, greatest(0.0, capacity_pressure)))
    + CAST(0.10 AS DOUBLE)*(1 - least(1.0, greatest(0.0, width))) AS balanced_score,
  1 - up AS low_risk_score,
  CAST(0.6 AS DOUBLE)*(1 - least(1.0, greatest(0.0, capacity_pressure)))
    + CAST(0.4 AS DOUBLE)*(1 - predicted_utilization_1h) AS low_congestion_score,
  free AS max_availability_score,
  """
    + band_sql("up", [0.0, 0.55, 0.75, 0.9, 1.01], ["Low", "Moderate", "High", "Critical"])
    + """ AS risk_band
  FROM (SELECT *, up - lo AS width, predicted_available_spaces_1h/greatest(capacity, 1) AS free FROM (
    SELECT *, coalesce(prediction_interval_lower, predicted_utilization_1h) AS lo,
      coalesce(prediction_interval_upper, predicted_utilization_1h) AS up FROM board)))"""
)

FORECAST_SQL = """WITH forecasts AS (SELECT l_returnflag AS model, l_quantity/50 AS actual,
  (l_quantity + l_partkey % 7 - 3)/50 AS predicted, l_shipdate AS target_time_slot FROM lineitem)"""
