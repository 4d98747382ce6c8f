"""Models, drift, clusters, anomalies, what-if and report records."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotline import fixed
from slotline.checks import adapters as A
from slotline.checks.catalog import CATALOG
from slotline.checks.context import feature_rows, graph, staged_slots
from slotline.checks.series import enriched
from slotline.functions import columns as X
from slotline.operators import anomalies, cluster, decide, drift, profile
from slotline.operators import evaluate as ev
from slotline.operators import timeseries as ts
from slotline.plans import boosted, normal, reports, training
from slotline.session import stage
from slotline.streaming import score

add = CATALOG.add
DRIFT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def model_rows(spark, d):
    """The model table, written once: every fit and split reads the table."""
    return stage(feature_rows(spark, d).dropna(subset=fixed.REQUIRED_FEATURES), "model")


# --- forecasts --------------------------------------------------------------

_FRAME = [
    "capacity", "available_spaces", "target_available_spaces_1h", "utilization", "target_utilization_1h",
    "predicted_utilization_1h", "predicted_available_spaces_1h",
]


def _frame_sql(predicted: str, model: str) -> str:
    return f"""SELECT system_code, time_slot, target_time_slot, capacity, available_spaces, target_available_spaces_1h,
      utilization, target_utilization_1h, '{model}' AS model, p AS predicted_utilization_1h,
      round_even(capacity*(1 - p), 0) AS predicted_available_spaces_1h
      FROM (SELECT *, least(1.0, greatest(0.0, {predicted})) AS p FROM model)"""


@add(
    "persistence_forecast",
    A.final(
        _frame_sql("utilization", "Persistence Baseline"),
        " ".join(_FRAME[1:]),
        "capacity",
        A.with_ctes("model"),
    ),
)
def persistence_forecast(spark, d):
    return ev.prediction_frame(
        feature_rows(spark, d).dropna(subset=fixed.REQUIRED_FEATURES), "Persistence Baseline", F.col("utilization")
    )


@add(
    "prediction_frame",
    A.final(
        _frame_sql("rolling_utilization_3 + utilization_delta_30m", "Momentum"),
        " ".join(_FRAME[1:]),
        "capacity",
        A.with_ctes("model"),
    ),
)
def prediction_frame(spark, d):
    """A prediction that leaves [0, 1], so that clipping and half-even counts show."""
    rows = feature_rows(spark, d).dropna(subset=fixed.REQUIRED_FEATURES)
    return ev.prediction_frame(rows, "Momentum", F.col("rolling_utilization_3") + F.col("utilization_delta_30m"))


def _scored_test(table, maker):
    rows = training.model_input(table)
    cut = F.lit(ev.split_time(rows).first()["split_time"])
    time = F.col("target_time_slot")
    model = maker.fit(rows.where(time <= cut))
    return training.score(model, rows.where(time > cut), "_p")


@add("rf_forecast")
def rf_forecast(spark, d):
    maker = training.forest_pipeline("target_utilization_1h", training.SMALL_FOREST)
    return ev.prediction_frame(_scored_test(model_rows(spark, d), maker), "Random Forest", F.col("_p"))


@add("gbt_forecast")
def gbt_forecast(spark, d):
    maker = training.boost_pipeline("target_utilization_1h", training.SMALL_BOOST)
    return ev.prediction_frame(_scored_test(model_rows(spark, d), maker), "Boosted Trees", F.col("_p"))


@add("feature_importance")
def feature_importance(spark, d):
    rows = training.model_input(model_rows(spark, d))
    model = training.forest_pipeline("target_utilization_1h", training.SMALL_FOREST).fit(rows)
    return training.feature_importance(model, rows)


@add("multi_horizon")
def multi_horizon(spark, d):
    return training.multi_horizon(model_rows(spark, d), training.SMALL_BOOST)[0]


@add("sequence_forecast")
def sequence_forecast(spark, d):
    windows = ts.sequence_windows(staged_slots(spark, d))
    tested = training.sequence_regressor(windows)[1]
    return tested.select("system_code", "time_slot", "target_time_slot", "target_value", "predicted_value")


_SPANS = "train_end_time, test_start_time, test_end_time"
_BACK = f"""WITH forecasts AS (SELECT l_quantity/50 AS actual, (l_quantity + l_partkey % 7 - 3)/50 AS raw, l_shipdate AS t FROM lineitem),
times AS (SELECT DISTINCT t FROM forecasts), numbered AS (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM times),
w AS (SELECT unnest([1, 2, 3]) AS k),
raw AS (SELECT k, n, n - (3 - k)*120 AS e, greatest(1, n - (3 - k)*120 - 120) AS s FROM w, (SELECT max(n) AS n FROM numbered)
  WHERE n > 170 AND greatest(1, n - (3 - k)*120 - 120) - 1 >= 100),
plan AS (SELECT row_number() OVER (ORDER BY k) AS win,
  (SELECT t FROM numbered WHERE rn = s) AS train_end_time, (SELECT t FROM numbered WHERE rn = s + 1) AS test_start_time,
  (SELECT t FROM numbered WHERE rn = e) AS test_end_time FROM raw),
tests AS (SELECT p.*, actual, least(1.0, greatest(0.0, raw)) AS predicted FROM forecasts f JOIN plan p
  ON f.t BETWEEN test_start_time AND test_end_time),
errors AS (SELECT win, {_SPANS}, count(*) AS n, avg(abs(actual - predicted)) AS mae,
  sqrt(avg((actual - predicted)*(actual - predicted))) AS rmse,
  1 - sum((actual - predicted)*(actual - predicted))/(count(*)*var_pop(actual)) AS r2,
  avg(abs(actual - predicted)/greatest(abs(actual), 1e-6))*100 AS mape FROM tests GROUP BY ALL),
banded AS (SELECT win, {A.band_sql('actual', fixed.UTILIZATION_EDGES, fixed.UTILIZATION_LABELS)} AS t,
  {A.band_sql('predicted', fixed.UTILIZATION_EDGES, fixed.UTILIZATION_LABELS)} AS p FROM tests),
bands AS (SELECT win, b, sum(s) AS support, sum(c) AS claimed, sum(h) AS hits FROM (
  SELECT win, t AS b, 1 AS s, 0 AS c, CASE WHEN t = p THEN 1 ELSE 0 END AS h FROM banded
  UNION ALL SELECT win, p, 0, 1, 0 FROM banded) GROUP BY win, b),
summed AS (SELECT win, sum(hits)/sum(support) AS band_accuracy,
  sum(support * (2.0*hits/(support + claimed)))/sum(support) AS weighted_f1 FROM bands GROUP BY win)"""
_METRIC_D = "mae rmse r2 mape band_accuracy weighted_f1"


def _back_rows(spark, d):
    return A.forecasts(spark, d)


@add(
    "backtest_persistence",
    A.final(
        f"""SELECT e.win AS "window", {_SPANS}, n, mae, rmse, r2, mape, band_accuracy, weighted_f1,
      'Rolling Persistence' AS model FROM errors e JOIN summed s ON e.win = s.win""",
        _METRIC_D,
        "n",
        _BACK,
    ),
)
def backtest_persistence(spark, d):
    return training.backtest_persistence(_back_rows(spark, d), "actual", "predicted")


@add("rolling_backtest")
def rolling_backtest(spark, d):
    return training.backtest(model_rows(spark, d), training.SMALL_BOOST)[0]


@add(
    "rolling_linear",
    A.final(
        f"""SELECT e.win AS "window", {_SPANS}, n, mae, rmse, r2, mape, band_accuracy, weighted_f1,
      'Rolling Linear' AS model FROM errors e JOIN summed s ON e.win = s.win""",
        _METRIC_D,
        "n",
        _BACK.replace("tests AS (SELECT p.*, actual, least(1.0, greatest(0.0, raw)) AS predicted FROM forecasts f JOIN plan p", """fits AS (
  SELECT win, regr_slope(actual, raw) AS a, regr_intercept(actual, raw) AS b FROM forecasts f JOIN plan p ON f.t <= p.train_end_time GROUP BY win),
tests AS (SELECT p.*, actual, least(1.0, greatest(0.0, a*raw + b)) AS predicted FROM forecasts f JOIN (SELECT * FROM plan JOIN fits USING (win)) p""").replace("errors AS (SELECT win, ", "errors AS (SELECT win, "),
    ),
)
def rolling_linear(spark, d):
    """Every window's fit from prefix sums of products."""
    return normal.rolling_linear(A.forecasts(spark, d), ["predicted"], "actual")[0]


@add(
    "site_encoding",
    A.final(
        """SELECT o_orderkey, (coalesce(s, 0) - coalesce(fs, 0) + 10*m)/(coalesce(n, 0) - coalesce(fn, 0) + 10) AS site_mean
      FROM orders o LEFT JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) a ON a.k = o.o_custkey
      LEFT JOIN (SELECT o_custkey AS k, o_orderkey % 5 AS f, sum(o_totalprice) AS fs, count(*) AS fn FROM orders GROUP BY 1, 2) b
        ON b.k = o.o_custkey AND b.f = o.o_orderkey % 5, (SELECT avg(o_totalprice) AS m FROM orders)""",
        "site_mean",
        "o_orderkey",
    ),
)
def site_encoding(spark, d):
    """Out-of-fold means of as many keys as there are customers."""
    rows = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return training.target_means(rows, "o_custkey", "o_totalprice", F.col("o_orderkey") % 5).select("o_orderkey", "site_mean")


@add(
    "backtest_summary",
    A.final(
        f"""SELECT 'Rolling Persistence' AS model, avg(rmse) AS avg_rmse, avg(mae) AS avg_mae,
      avg(band_accuracy) AS avg_band_accuracy FROM errors e JOIN summed s ON e.win = s.win""",
        "avg_rmse avg_mae avg_band_accuracy",
        "",
        _BACK,
    ),
)
def backtest_summary(spark, d):
    return profile.mean_metrics(backtest_persistence(spark, d), "model")


@add(
    "horizon_summary",
    A.final(
        """SELECT forecast_horizon, avg(rmse) AS avg_rmse, avg(mae) AS avg_mae, avg(hit) AS avg_band_accuracy FROM (
      SELECT CASE l_linenumber % 3 WHEN 0 THEN '30 minutes' WHEN 1 THEN '1 hour' ELSE '2 hours' END AS forecast_horizon,
        l_linestatus, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae, avg(CASE WHEN ta = tp THEN 1.0 ELSE 0.0 END) AS hit FROM (
        SELECT *, a - p AS e, """
        + A.band_sql("a", fixed.UTILIZATION_EDGES, fixed.UTILIZATION_LABELS)
        + " AS ta, "
        + A.band_sql("p", fixed.UTILIZATION_EDGES, fixed.UTILIZATION_LABELS)
        + """ AS tp FROM (SELECT *, l_quantity/50 AS a,
          least(1.0, greatest(0.0, (l_quantity + l_partkey % 7 - 3)/50)) AS p FROM lineitem)) GROUP BY 1, 2)
      GROUP BY forecast_horizon""",
        "avg_rmse avg_mae avg_band_accuracy",
    ),
)
def horizon_summary(spark, d):
    rows = A.table(spark, d, "lineitem")
    names = F.when(F.col("l_linenumber") % 3 == 0, "30 minutes").when(F.col("l_linenumber") % 3 == 1, "1 hour")
    shaped = rows.select(
        names.otherwise("2 hours").alias("forecast_horizon"),
        "l_linestatus",
        (F.col("l_quantity") / 50).alias("actual"),
        ((F.col("l_quantity") + F.col("l_partkey") % 7 - 3) / 50).alias("predicted"),
    )
    metrics = ev.metrics_table(shaped, "actual", "predicted", ["forecast_horizon", "l_linestatus"])
    return profile.mean_metrics(metrics, "forecast_horizon")


# --- drift ------------------------------------------------------------------

_DRIFT = """WITH times AS (SELECT DISTINCT l_shipdate AS t FROM lineitem),
cut AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM times)
  WHERE rn = greatest(1, floor(n*CAST(0.8 AS DOUBLE)))),
long AS (SELECT l_shipdate <= (SELECT t FROM cut) AS ref, feature, value FROM (
  UNPIVOT (SELECT l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value,
  [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM long WHERE ref GROUP BY feature),
binned AS (SELECT l.*, CASE WHEN value < e[1] OR value > e[len(e)] THEN NULL WHEN value = e[1] THEN 1
  ELSE len(list_filter(e, lambda x : x < value)) END AS b, len(e) - 1 AS m FROM long l JOIN edges USING (feature)),
spine AS (SELECT feature, unnest(range(1, CAST(len(e) AS BIGINT))) AS b FROM edges),
counts AS (SELECT feature, b, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM binned WHERE b IS NOT NULL GROUP BY feature, b),
shares AS (SELECT s.feature, greatest(coalesce(r, 0)/sum(coalesce(r, 0)) OVER (PARTITION BY s.feature), 1e-6) AS r,
  greatest(coalesce(c, 0)/sum(coalesce(c, 0)) OVER (PARTITION BY s.feature), 1e-6) AS c
  FROM spine s LEFT JOIN counts k ON k.feature = s.feature AND k.b = s.b),
scores AS (SELECT feature, CASE WHEN count(*) >= 2 THEN sum((c - r)*ln(c/r)) ELSE 0.0 END AS psi FROM shares GROUP BY feature),
means AS (SELECT feature, avg(value) FILTER (ref) AS train_mean, avg(value) FILTER (NOT ref) AS recent_mean,
  count(*) FILTER (ref) AS reference_rows, count(*) FILTER (NOT ref) AS recent_rows FROM long GROUP BY feature)"""


def drift_input(spark, d):
    rows = A.table(spark, d, "lineitem").select("l_shipdate", *DRIFT_COLUMNS)
    cut = ev.split_time(rows, "l_shipdate").first()["split_time"]  # one value, known before the report
    return rows, F.col("l_shipdate") <= F.lit(cut)


@add("psi_drift", A.final("SELECT feature, psi FROM scores", "psi", "", _DRIFT))
def psi_drift(spark, d):
    rows, reference = drift_input(spark, d)
    return drift.drift_scores(rows, DRIFT_COLUMNS, reference).select("feature", "psi")


def drift_rows(spark, d):
    rows, reference = drift_input(spark, d)
    return drift.drift_report(rows, DRIFT_COLUMNS, reference)


@add(
    "drift_report",
    A.final(
        """SELECT s.feature, psi, train_mean, recent_mean, reference_rows, recent_rows,
      CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS drift_level
      FROM scores s JOIN means m ON s.feature = m.feature""",
        "psi train_mean recent_mean",
        "reference_rows recent_rows",
        _DRIFT,
    ),
)
def drift_report(spark, d):
    return drift_rows(spark, d)


@add(
    "drift_severity",
    A.final(
        """SELECT max(psi) AS max_psi, count(*) AS features_monitored,
      CASE WHEN max(psi) >= 0.25 THEN 'critical' WHEN max(psi) >= 0.1 THEN 'warning' ELSE 'stable' END AS severity,
      bool_or(psi >= 0.1) AS retrain FROM scores""",
        "max_psi",
        "features_monitored",
        _DRIFT,
    ),
)
def drift_severity(spark, d):
    return drift.drift_decision(drift_rows(spark, d))


# --- sites ------------------------------------------------------------------

SITE_KEY = "concat(event_type, '-', CAST(user_id % 8 AS STRING))"


def many_site_profiles(spark, d):
    """Profiles of 40 sites: event type by user group."""
    return profile.site_profiles(ts.slot_aggregate(A.observations(spark, d, SITE_KEY)).transform(_enrich))


def _enrich(slots):
    from slotline.plans.features import enrich_slots

    return enrich_slots(slots)


@add("cluster_sites")
def cluster_sites(spark, d):
    out, summary = cluster.choose_clusters(many_site_profiles(spark, d), measure="euclidean")
    return out.select("system_code", "cluster", "pca_1", "pca_2").withColumn(
        "silhouette", F.lit(float(summary["silhouette_score"]))
    )


@add(
    "cluster_facts",
    """WITH s AS (SELECT count(DISTINCT event_type || '-' || CAST(user_id % 8 AS VARCHAR)) AS n FROM events)
SELECT CAST(k AS BIGINT) AS k, n AS sites, CAST(20 AS BIGINT) AS starts, CAST(0 AS BIGINT) AS misplaced, true AS least_cost FROM s, (SELECT unnest([2, 3, 4, 5]) AS k)""",
)
def cluster_facts(spark, d):
    """What holds for any k-means answer: no site is nearer to another centre, and the kept start is the cheapest of all."""
    features = fixed.PROFILE_FEATURES
    names = [f"z_{c}" for c in features]
    rows = stage(cluster.standardised(many_site_profiles(spark, d), features))
    found = cluster.kmeans(rows, names, [2, 3, 4, 5])
    out = None
    for k, fit in found.items():
        placed = cluster.nearest(rows, names, fit["centres"])
        away = lambda j: sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(names, fit["centres"][j])), F.lit(0.0))
        gaps = F.array(*[away(j) for j in range(k)])
        wrong = F.count_if(F.array_min(gaps) < F.element_at(gaps, F.col("cluster") + 1) - 1e-9)
        cost = F.abs(F.sum(F.element_at(gaps, F.col("cluster") + 1)) - F.lit(min(fit["costs"]))) < 1e-6
        one = placed.agg(F.lit(k).cast("long").alias("k"), F.count(F.lit(1)).alias("sites"), F.lit(len(fit["costs"])).cast("long").alias("starts"), wrong.alias("misplaced"), cost.alias("least_cost"))
        out = one if out is None else out.unionByName(one)
    return out


@add(
    "pca_facts",
    """SELECT count(DISTINCT event_type || '-' || CAST(user_id % 8 AS VARCHAR)) AS sites, true AS centred, true AS uncorrelated, true AS first_is_widest, true AS spread_is_largest FROM events""",
)
def pca_facts(spark, d):
    """What holds for the first two components of any table: centred, uncorrelated, ordered, and no input column spreads more than the first."""
    rows = cluster.standardised(many_site_profiles(spark, d), fixed.PROFILE_FEATURES)
    both = rows.join(pca_project(spark, d), "system_code")
    widest = F.greatest(*[F.var_pop(f"z_{c}") for c in fixed.PROFILE_FEATURES])
    near = lambda c: F.abs(c) < 1e-6
    return both.agg(
        F.count(F.lit(1)).alias("sites"),
        (near(F.avg("pca_1")) & near(F.avg("pca_2"))).alias("centred"),
        near(F.covar_pop("pca_1", "pca_2")).alias("uncorrelated"),
        (F.var_pop("pca_1") >= F.var_pop("pca_2") - 1e-9).alias("first_is_widest"),
        (F.var_pop("pca_1") >= widest - 1e-9).alias("spread_is_largest"),
    )


_SPLIT_SQL = """, times AS (SELECT DISTINCT target_time_slot AS t FROM model),
cut AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM times) WHERE rn = greatest(1, floor(n*CAST(0.8 AS DOUBLE)))),
tested AS (SELECT * FROM model WHERE target_time_slot > (SELECT t FROM cut))"""


@add(
    "boosted_first_cut",
    A.final(
        """SELECT feature, cut, gain, gl, CAST(hl AS BIGINT) AS hl FROM (
      SELECT *, row_number() OVER (ORDER BY gain DESC, feature, cut) AS rn FROM (
        SELECT *, CASE WHEN hl >= 1 AND ht - hl >= 1 THEN power(greatest(abs(gl) - CAST(0.1 AS DOUBLE), 0), 2)/(hl + 1) + power(greatest(abs(gt - gl) - CAST(0.1 AS DOUBLE), 0), 2)/(ht - hl + 1)
          - power(greatest(abs(gt) - CAST(0.1 AS DOUBLE), 0), 2)/(ht + 1) ELSE -1 END AS gain FROM (
          SELECT feature, v AS cut, sum(g) OVER w AS gl, sum(n) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(n) OVER (PARTITION BY feature) AS ht
          FROM (SELECT feature, v, sum(g) AS g, count(*) AS n FROM (
            UNPIVOT (SELECT CAST(l_quantity AS BIGINT) AS f0, CAST(l_linenumber AS BIGINT) AS f1, CAST(round(l_discount*100) AS BIGINT) AS f2,
              (SELECT avg(l_extendedprice/10000) FROM lineitem) - l_extendedprice/10000 AS g FROM lineitem) ON f0, f1, f2 INTO NAME feature VALUE v) GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY feature ORDER BY v)))) WHERE rn = 1""",
        "gain gl",
    ),
)
def boosted_first_cut(spark, d):
    """The first cut of a boosted tree for prices, from sums per value of three features."""
    rows = A.table(spark, d, "lineitem")
    mean = rows.agg(F.avg(F.col("l_extendedprice") / 10000)).scalar()
    values = F.array(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.rint(F.col("l_discount") * 100).cast("long"))
    long = rows.select((mean - F.col("l_extendedprice") / 10000).alias("g"), F.posexplode(values).alias("feature", "bin"))
    sums = long.groupBy(F.lit(0).alias("node"), "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).cast("double").alias("h"))
    penalties = fixed.BOOST_PENALTIES
    best = boosted.best_cuts(sums, penalties["l1"], penalties["l2"], penalties["least_weight"])
    return best.select(F.format_string("f%d", "feature").alias("feature"), F.col("bin").alias("cut"), "gain", "gl", F.col("hl").cast("long").alias("hl"))


@add(
    "forecast_facts",
    A.final(
        """SELECT unnest(['Boosted Trees', 'Random Forest']) AS model, system_code, time_slot, target_time_slot, capacity, target_utilization_1h, true AS in_range, true AS spaces_follow,
      true AS within_training FROM tested""",
        "target_utilization_1h",
        "capacity",
        A.with_ctes("model") + _SPLIT_SQL,
    ),
)
def forecast_facts(spark, d):
    """Every test row of both tree models, with what any fit must keep: range, free spaces, and (for averages of labels) the span of the training labels."""
    rows = model_rows(spark, d)
    out = None
    for name, maker in (
        ("Random Forest", training.forest_pipeline("target_utilization_1h", training.SMALL_FOREST)),
        ("Boosted Trees", training.boost_pipeline("target_utilization_1h", training.SMALL_BOOST)),
    ):
        frame = ev.prediction_frame(_scored_test(rows, maker), name, F.col("_p"))
        p = F.col("predicted_utilization_1h")
        ends = rows.agg(F.min("target_utilization_1h").alias("a"), F.max("target_utilization_1h").alias("b"))
        # A forest averages labels, so it stays between them; boosted trees may go beyond by a little.
        inside = p.between(ends.select("a").scalar() - 0.05, ends.select("b").scalar() + 0.05)
        part = frame.select(
            "model", "system_code", "time_slot", "target_time_slot", "capacity", "target_utilization_1h", p.between(0, 1).alias("in_range"),
            (F.col("predicted_available_spaces_1h") == F.rint(F.col("capacity") * (1 - p))).alias("spaces_follow"), inside.alias("within_training"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@add(
    "forecast_board_facts",
    A.final(
        """SELECT system_code, time_slot, round_even(capacity*(1 - least(1.0, greatest(0.0, utilization))), 0) AS free_now, true AS ranged, true AS spaces_follow, true AS ranked
      FROM (SELECT *, row_number() OVER (PARTITION BY system_code ORDER BY time_slot DESC) AS rn FROM model) WHERE rn = 1""",
        "free_now",
        "",
        A.with_ctes("model"),
    ),
)
def forecast_board_facts(spark, d):
    """The forecast board's rows with what any trained board must keep: order of the interval, free spaces, ranks that follow the scores."""
    rows = model_rows(spark, d)
    trained = training.train_and_evaluate(rows, training.SMALL_FOREST, training.SMALL_BOOST)
    board = stage(decide.recommend(training.score_latest(ts.latest_per_key(rows), trained)), "board")
    p = F.col("predicted_utilization_1h")
    scores = board.agg(F.array_sort(F.collect_set("balanced_score"))).scalar()  # one score per site of the test tables
    return board.withColumn("_scores", scores).select(
        "system_code", "time_slot", X.free_spaces("capacity", "utilization").alias("free_now"),
        ((F.col("prediction_interval_lower") <= p) & (p <= F.col("prediction_interval_upper"))).alias("ranged"),
        (F.col("predicted_available_spaces_1h") == F.rint(F.col("capacity") * (1 - p))).alias("spaces_follow"),
        (F.col("recommendation_rank") == F.size(F.filter(F.col("_scores"), lambda x: x > F.col("balanced_score"))) + 1).alias("ranked"),
    )


@add("pca_project")
def pca_project(spark, d):
    from pyspark.ml.feature import VectorAssembler

    rows = cluster.standardised(many_site_profiles(spark, d), fixed.PROFILE_FEATURES)
    names = [f"z_{c}" for c in fixed.PROFILE_FEATURES]
    wide = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    return cluster.components(wide)[0].select("system_code", "pca_1", "pca_2")


_SITE_MEANS = """WITH s AS (SELECT event_type || '-' || CAST(user_id % 8 AS VARCHAR) AS k, user_id % 8 % 3 AS c,
  avg(value) AS x, avg(hour(ts)) AS y FROM events GROUP BY 1, 2)"""


def _labelled_sites(spark, d):
    rows = A.table(spark, d, "events")
    return rows.groupBy(
        F.expr(SITE_KEY).alias("k"), (F.col("user_id") % 8 % 3).cast("int").alias("c")
    ).agg(F.avg("value").alias("x"), F.avg(F.hour("ts")).alias("y"))


@add(
    "silhouette",
    A.final(
        """SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a)/greatest(a, b) END) AS silhouette FROM (
      SELECT k, max(n) AS n, max(CASE WHEN own THEN total/(m - 1) END) AS a, min(CASE WHEN NOT own THEN total/m END) AS b FROM (
        SELECT p.k, p.c = q.c AS own, q.c AS qc, sum(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y))) AS total,
          count(*) AS m, max(z.n) AS n FROM s p CROSS JOIN s q JOIN (SELECT c, count(*) AS n FROM s GROUP BY c) z ON z.c = p.c
        GROUP BY p.k, p.c, q.c) GROUP BY k)""",
        "silhouette",
        "",
        _SITE_MEANS,
    ),
)
def silhouette(spark, d):
    """Euclidean silhouette of site means under given labels."""
    return cluster.silhouette_euclidean(_labelled_sites(spark, d), "c", ["x", "y"], "k")


@add(
    "silhouette_squared",
    A.final(
        """SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a)/greatest(a, b) END) AS silhouette FROM (
      SELECT k, max(n) AS n, max(CASE WHEN own THEN total/(m - 1) END) AS a, min(CASE WHEN NOT own THEN total/m END) AS b FROM (
        SELECT p.k, p.c = q.c AS own, q.c AS qc, sum((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)) AS total,
          count(*) AS m, max(z.n) AS n FROM s p CROSS JOIN s q JOIN (SELECT c, count(*) AS n FROM s GROUP BY c) z ON z.c = p.c
        GROUP BY p.k, p.c, q.c) GROUP BY k)""",
        "silhouette",
        "",
        """WITH s AS (SELECT vec_id AS k, label AS c, CAST(embedding[1] AS DOUBLE) AS x,
      CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)""",
    ),
)
def silhouette_squared(spark, d):
    rows = A.table(spark, d, "embeddings").select(
        F.col("label").alias("c"),
        F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"),
    )
    return cluster.silhouette_squared(rows, "c", ["x", "y"])


# --- anomalies --------------------------------------------------------------


@add("isolation_anomalies")
def isolation_anomalies(spark, d):
    rows = stage(feature_rows(spark, d), "features")
    found = anomalies.detect_anomalies(rows)
    return found.select("system_code", "time_slot", "anomaly_score", "anomaly_reason")


@add(
    "score_threshold_flag",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.97) FROM lineitem) AS BIGINT) AS anomaly_flag FROM lineitem""",
)
def score_threshold_flag(spark, d):
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return anomalies.flag_above_quantile(rows, "l_extendedprice").drop("l_extendedprice")


# --- what-if ----------------------------------------------------------------

_WHAT_D = "queue_length capacity_pressure parking_stress_index rolling_queue_3 rolling_queue_6 rolling_stress_3"


@add(
    "what_if",
    A.final(
        f"""SELECT scenario_id, system_code, vehicle_type, traffic_condition_nearby, traffic_level, is_special_day,
      queue_length, capacity_pressure, parking_stress_index, queue_length AS rolling_queue_3,
      queue_length AS rolling_queue_6, parking_stress_index AS rolling_stress_3 FROM (
      SELECT *, {A.clip_sql('(CAST(0.7 AS DOUBLE)*utilization + CAST(0.2 AS DOUBLE)*traffic_level/2 + CAST(0.1 AS DOUBLE)*capacity_pressure)')}
        AS parking_stress_index FROM (
        SELECT *, queue_length/CAST(capacity AS DOUBLE) AS capacity_pressure FROM (
          SELECT e.event_id AS scenario_id, l.system_code, l.capacity, l.utilization,
            coalesce(CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 25 AS DOUBLE) END, l.queue_length) AS queue_length,
            CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE l.traffic_level END AS traffic_level,
            CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'average' WHEN 2 THEN 'high'
              ELSE l.traffic_condition_nearby END AS traffic_condition_nearby,
            coalesce(CASE WHEN user_id % 5 <> 0 THEN user_id % 2 END, l.is_special_day) AS is_special_day,
            coalesce(CASE WHEN user_id % 7 = 0 THEN 'truck' END, l.vehicle_type) AS vehicle_type
          FROM events e JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_code ORDER BY time_slot DESC) AS rn
            FROM stressed) WHERE rn = 1) l ON l.system_code = e.event_type)))""",
        _WHAT_D,
        "traffic_level is_special_day scenario_id",
        A.with_ctes("stressed"),
    ),
)
def what_if(spark, d):
    """Every event is one scenario on the newest slot of its site."""
    return _scenario_rows(spark, d).select(
        "scenario_id", "system_code", "vehicle_type", "traffic_condition_nearby", "traffic_level",
        "is_special_day", *_WHAT_D.split(),
    )


def _scenario_rows(spark, d):
    latest = ts.latest_per_key(enriched(spark, d)).withColumns(
        {c: F.lit(None).cast("double") for c in ("rolling_queue_3", "rolling_queue_6", "rolling_stress_3")}
    )
    user = F.col("user_id")
    scenarios = A.table(spark, d, "events").select(
        F.col("event_id").alias("scenario_id"),
        F.col("event_type").alias("system_code"),
        F.when(user % 3 != 0, user % 25).alias("new_queue_length"),
        F.when(user % 4 == 0, "low").when(user % 4 == 1, "average").when(user % 4 == 2, "high").alias(
            "new_traffic_condition_nearby"
        ),
        F.when(user % 5 != 0, user % 2).alias("new_is_special_day"),
        F.when(user % 7 == 0, "truck").alias("new_vehicle_type"),
    )
    return decide.what_if(latest, scenarios)


_ANSWER = {"utilization": 0.6, "parking_stress_index": 0.25, "rolling_queue_3": 0.004, "capacity_pressure": 0.1}


@add(
    "what_if_scored",
    A.final(
        """SELECT scenario_id, system_code, round_even(p*1e6, 0)/1e6 AS predicted_utilization_1h, round_even(greatest(0.0, p - w/2)*1e6, 0)/1e6 AS prediction_interval_lower,
      round_even(least(1.0, p + w/2)*1e6, 0)/1e6 AS prediction_interval_upper, CAST(round_even(capacity*(1 - p), 0) AS BIGINT) AS predicted_free_spaces_1h
      FROM (SELECT *, least(1.0, greatest(0.0, """
        + " + ".join(f"CAST({w!r} AS DOUBLE)*coalesce({c}, 0)" for c, w in _ANSWER.items())
        + """)) AS p FROM asked), (SELECT max(coalesce(uncertainty_width, 0)) AS w FROM board)""",
        "predicted_utilization_1h prediction_interval_lower prediction_interval_upper",
        "scenario_id predicted_free_spaces_1h",
        A.with_ctes("stressed")
        + ", "
        + A.BOARD_SQL.replace("WITH ", "", 1)
        + f""", asked AS (SELECT *, queue_length AS rolling_queue_3,
        {A.clip_sql('(CAST(0.7 AS DOUBLE)*utilization + CAST(0.2 AS DOUBLE)*traffic_level/2 + CAST(0.1 AS DOUBLE)*capacity_pressure)')} AS parking_stress_index FROM (
        SELECT *, queue_length/CAST(capacity AS DOUBLE) AS capacity_pressure FROM (
          SELECT e.event_id AS scenario_id, l.system_code, l.capacity, l.utilization,
            coalesce(CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 25 AS DOUBLE) END, l.queue_length) AS queue_length,
            CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE l.traffic_level END AS traffic_level
          FROM events e JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_code ORDER BY time_slot DESC) AS rn
            FROM stressed) WHERE rn = 1) l ON l.system_code = e.event_type)))""",
    ),
)
def what_if_scored(spark, d):
    """The answer to every scenario: a stand-in prediction on its feature row, interval and free spaces."""
    rows = _scenario_rows(spark, d).withColumn("predicted_utilization_1h", score.linear_prediction(_ANSWER))
    answer = decide.what_if_answer(rows, A.board(spark, d).select("uncertainty_width"))
    return answer.select(
        "scenario_id", "system_code", "predicted_utilization_1h", "prediction_interval_lower", "prediction_interval_upper", "predicted_free_spaces_1h"
    )


# --- records ----------------------------------------------------------------


@add("forecast_board")
def forecast_board(spark, d):
    """Train both models, score the newest row of each site and rank the board."""
    rows = model_rows(spark, d)
    trained = training.train_and_evaluate(rows, training.SMALL_FOREST, training.SMALL_BOOST)
    latest = ts.latest_per_key(rows)
    ranked = decide.recommend(training.score_latest(latest, trained))
    return ranked.select(
        "system_code", "time_slot", "predicted_utilization_1h", "predicted_available_spaces_1h",
        "prediction_interval_lower", "prediction_interval_upper", "risk_band", "recommendation_rank",
        X.free_spaces("capacity", "utilization").alias("free_now"),
    )
