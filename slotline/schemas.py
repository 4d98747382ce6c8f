"""Declared schemas; sources are never inferred."""

from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


OBSERVATIONS = _struct(
    ("record_id", _L),
    ("system_code", _S),
    ("capacity", _L),
    ("latitude", _D),
    ("longitude", _D),
    ("occupancy", _D),
    ("vehicle_type", _S),
    ("traffic_condition_nearby", _S),
    ("queue_length", _L),
    ("is_special_day", _I),
    ("timestamp", _TS),
)

EDGES = _struct(("system_code", _S), ("neighbor_code", _S), ("distance", _D), ("weight", _D))

INGEST_EVENT = _struct(
    ("system_code", _S),
    ("occupancy", _D),
    ("queue_length", _I),
    ("traffic_condition_nearby", _S),
    ("is_special_day", _I),
    ("timestamp", _S),
    ("vehicle_type", _S),
    ("capacity", _D),
    ("latitude", _D),
    ("longitude", _D),
)

WHAT_IF = _struct(
    ("system_code", _S),
    ("queue_length", _I),
    ("traffic_condition_nearby", _S),
    ("is_special_day", _I),
    ("vehicle_type", _S),
)

REQUEST_LOG = _struct(
    ("request_id", _S),
    ("method", _S),
    ("path", _S),
    ("status_code", _I),
    ("client_host", _S),
    ("duration_ms", _D),
    ("metadata_json", _S),
    ("created_at", _TS),
)

AUDIT_EVENTS = _struct(
    ("event_id", _S), ("event_type", _S), ("actor", _S), ("payload_json", _S), ("created_at", _TS)
)

RETRAIN_EVENTS = _struct(("job_id", _S), ("status", _S), ("message", _S), ("at", _TS))

DRIFT_REPORT = _struct(
    ("train_period_end", _TS),
    ("reference_rows", _L),
    ("recent_rows", _L),
    (
        "features",
        T.ArrayType(
            _struct(
                ("feature", _S),
                ("psi", _D),
                ("drift_level", _S),
                ("train_mean", _D),
                ("recent_mean", _D),
            )
        ),
    ),
)
