"""Vocabularies, edges, weights, labels and texts that results depend on."""

# --- slots and horizons ----------------------------------------------------
SLOT_MINUTES = 30
HORIZON_STEPS = 2
SEQUENCE_LENGTH = 6
NEIGHBOURS = 3
SEED = 42

# --- ordinal maps (lower-cased input, default 1) ---------------------------
TRAFFIC_LEVELS = {"low": 0, "average": 1, "high": 2}
VEHICLE_LEVELS = {"cycle": 0, "bike": 1, "car": 2, "truck": 3}
ORDINAL_DEFAULT = 1

# --- right-closed bands ----------------------------------------------------
UTILIZATION_EDGES = [0.0, 0.4, 0.7, 0.9, 1.01]
UTILIZATION_LABELS = ["Low", "Moderate", "High", "Critical"]
REGIME_EDGES = [0.0, 0.35, 0.6, 0.8, 1.01]
REGIME_LABELS = ["Stable", "Busy", "Congested", "Critical"]
RISK_EDGES = [0.0, 0.55, 0.75, 0.9, 1.01]
RISK_LABELS = ["Low", "Moderate", "High", "Critical"]
NO_BAND = "nan"

# --- stress index weights: utilization, traffic level / 2, capacity pressure
STRESS_WEIGHTS = (0.7, 0.2, 0.1)

# --- source header -> column name ------------------------------------------
SOURCE_HEADER = {
    "ID": "record_id",
    "SystemCodeNumber": "system_code",
    "Capacity": "capacity",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Occupancy": "occupancy",
    "VehicleType": "vehicle_type",
    "TrafficConditionNearby": "traffic_condition_nearby",
    "QueueLength": "queue_length",
    "IsSpecialDay": "is_special_day",
    "Timestamp": "timestamp",
}

# --- model inputs ----------------------------------------------------------
NUMERIC_FEATURES = [
    "capacity",
    "latitude",
    "longitude",
    "occupancy_clean",
    "available_spaces",
    "utilization",
    "queue_length",
    "is_special_day",
    "is_weekend",
    "hour",
    "minute",
    "day_of_week",
    "slot_index",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "traffic_level",
    "vehicle_priority",
    "session_progress",
    "capacity_pressure",
    "parking_stress_index",
    "neighbor_utilization_mean",
    "neighbor_queue_mean",
    "neighbor_stress_mean",
    "spatial_utilization_gap",
    "mean_neighbor_distance",
    "lag_occupancy_30m",
    "lag_occupancy_60m",
    "lag_utilization_30m",
    "lag_utilization_60m",
    "lag_utilization_120m",
    "lag_queue_30m",
    "lag_utilization_prev_day",
    "lag_queue_prev_day",
    "lag_stress_prev_day",
    "rolling_utilization_3",
    "rolling_utilization_6",
    "rolling_queue_3",
    "rolling_queue_6",
    "rolling_stress_3",
    "utilization_delta_30m",
    "utilization_delta_60m",
]
CATEGORICAL_FEATURES = ["system_code", "vehicle_type", "traffic_condition_nearby", "day_name"]
REQUIRED_FEATURES = [
    "lag_occupancy_30m",
    "lag_occupancy_60m",
    "lag_utilization_30m",
    "lag_utilization_60m",
    "lag_utilization_120m",
    "lag_queue_30m",
    "neighbor_utilization_mean",
    "neighbor_queue_mean",
    "neighbor_stress_mean",
    "lag_utilization_prev_day",
    "lag_queue_prev_day",
    "lag_stress_prev_day",
    "target_utilization_1h",
    "target_time_slot",
]
SEQUENCE_FEATURES = [
    "capacity",
    "latitude",
    "longitude",
    "occupancy_clean",
    "available_spaces",
    "utilization",
    "queue_length",
    "is_special_day",
    "is_weekend",
    "hour",
    "minute",
    "day_of_week",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "traffic_level",
    "vehicle_priority",
    "capacity_pressure",
    "parking_stress_index",
]
PROFILE_FEATURES = [
    "latitude",
    "longitude",
    "capacity",
    "mean_occupancy",
    "max_occupancy",
    "mean_utilization",
    "std_utilization",
    "mean_queue_length",
    "high_traffic_ratio",
    "special_day_ratio",
    "average_stress",
]
ANOMALY_FEATURES = [
    "utilization",
    "queue_length",
    "traffic_level",
    "capacity_pressure",
    "parking_stress_index",
    "neighbor_utilization_mean",
    "spatial_utilization_gap",
]
DRIFT_FEATURES = [
    "utilization",
    "queue_length",
    "parking_stress_index",
    "capacity_pressure",
    "neighbor_utilization_mean",
    "lag_utilization_30m",
    "rolling_utilization_6",
]
# horizon name -> (target column, target time column)
HORIZONS = {
    "30 minutes": ("target_utilization_30m", "target_time_slot_30m"),
    "1 hour": ("target_utilization_1h", "target_time_slot"),
    "2 hours": ("target_utilization_2h", "target_time_slot_2h"),
}

# --- evaluation ------------------------------------------------------------
TRAIN_RATIO = 0.8
CALIBRATION_RATIO = 0.15
INTERVAL_QUANTILE = 0.9
ERROR_FLOOR = 1e-6
BACKTEST_SIZE = 120
BACKTEST_WINDOWS = 3
BACKTEST_SLACK = 50
BACKTEST_MIN_TRAIN = 100
DEFAULT_INTERVAL_WIDTH = 0.08

# --- model settings --------------------------------------------------------
FOREST_SETTINGS = {"trees": 350, "depth": 14, "min_leaf": 2}
BOOST_SETTINGS = {"rounds": 350, "depth": 6, "step": 0.05, "row_share": 0.9, "column_share": "0.8"}
BOOST_PENALTIES = {"l1": 0.1, "l2": 1.0, "least_weight": 1.0}
ANOMALY_SHARE = 0.03
ANOMALY_TREES = 100
ANOMALY_SAMPLE = 256

# --- drift -----------------------------------------------------------------
PSI_BINS = 10
PSI_FLOOR = 1e-6
DRIFT_CUTS = (0.10, 0.25)
DRIFT_LEVELS = ("stable", "moderate", "high")
DRIFT_SEVERITIES = ("stable", "warning", "critical")

# --- anomaly reasons, first match wins -------------------------------------
REASON_QUEUE = "High queue and near-full utilization"
REASON_SPATIAL = "Higher congestion than neighboring parking systems"
REASON_PRESSURE = "Queue pressure is unusually high for this capacity"
REASON_OTHER = "Unusual demand pattern detected"
REASON_CUTS = {"queue": 8, "utilization": 0.85, "gap": 0.2, "pressure": 0.02}

# --- recommendation objectives and score weights ---------------------------
OBJECTIVES = {
    "Balanced": "balanced_score",
    "Maximum Availability": "max_availability_score",
    "Lowest Risk": "low_risk_score",
    "Lowest Congestion": "low_congestion_score",
}
BALANCED_WEIGHTS = (0.45, 0.25, 0.20, 0.10)
CONGESTION_WEIGHTS = (0.6, 0.4)
LOW_SPACES = 50
LOW_FREE_RATIO = 0.05

# --- alert vocabulary ------------------------------------------------------
SEVERITY_ORDER = ("critical", "warning", "info")
ALERT_TEXT = {
    "capacity": {
        "title": "Critical parking pressure detected",
        "message": "%d systems are critical. Highest risk is %s with predicted utilization %.2f%%.",
        "action": "Reroute drivers to the top-ranked live recommendations and monitor nearby spillover systems.",
    },
    "availability": {
        "title": "Low-availability systems emerging",
        "message": "%d systems are forecast to have 50 or fewer free spaces. Most constrained: %s.",
        "action": "Prioritize alternative parking guidance before queues spill into adjacent systems.",
    },
    "drift": {
        "title": "Data drift monitor",
        "message": "Highest PSI is %.3f on %s; current drift status is %s.",
        "action": "Continue monitoring feature movement and retrain if PSI enters the warning band.",
    },
    "no_job": {
        "title": "No retraining jobs on record",
        "message": "The live ops database does not yet contain a retraining history.",
        "action": "Use the retraining endpoint when drift or live performance starts to degrade.",
    },
    "job": {
        "title": "Latest retraining job is %s",
        "message": "Most recent retraining job status: %s at %s.",
        "action": "Investigate failures immediately, or keep the current champion model in service "
        "if the last run completed cleanly.",
    },
}

# --- stress scenarios ------------------------------------------------------
# Each row: picks, ranking column; shift = base + per_step * step + per_rank * rank
# (per_parity uses rank % 2); queue shift likewise; traffic; special day.
QUEUE_LIMIT = 30
QUIET_QUEUE_LIMIT = 2
SPILL_TARGET = {"gain": 0.12, "per_step": 0.02, "floor": 0.93, "ceiling": 0.99}

# --- request audit ---------------------------------------------------------
UNKNOWN_CLIENT = "unknown"
REQUEST_LIMIT = 180
REQUEST_WINDOW_SECONDS = 60
