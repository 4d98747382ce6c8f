"""Values published for the 14-site data set, recomputed from their inputs (given here by value)."""

import math

import pytest
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators import cluster, decide, profile

# site, capacity, utilization, pressure, predicted, free, lower, upper, balanced, risk band, rank, queue,
# traffic level, stress
BOARD = """
BHMBCCMKT01|577|0.4748700173310225|0.0034662045060658577|0.3775630700017853|359|0.33397757753933244|0.42114856246423815|0.7261815620833195|Low|1|2|0|0.3327556325823223
Others-CCCPS202|2937|0.4446714334354784|0.0010214504596527069|0.39000231308613714|1792|0.3464168206236843|0.43358780554859|0.7181439166986922|Low|2|3|0|0.31137214845080013
Others-CCCPS119a|2803|0.4555833036032822|0.0010702818408847663|0.4160582367730742|1637|0.37247274431062133|0.45964372923552704|0.6998619919753184|Low|3|3|0|0.319015340706386
Others-CCCPS98|3103|0.573960683209797|0.0009668063164679343|0.49513634192587175|1567|0.4515508494634189|0.5387218343883245|0.6445532794485358|Low|4|3|0|0.40186915887850466
BHMNCPNST01|485|0.6144329896907217|0.004123711340206186|0.5476923430462078|219|0.504106850583755|0.5912778355086606|0.606730949766576|Moderate|5|2|0|0.43051546391752576
BHMNCPHST01|1200|0.7075|0.0025|0.5989823005336437|481|0.5553968080711909|0.6425677929960965|0.5714123263740986|Moderate|6|3|0|0.49549999999999994
Others-CCCPS8|1322|0.7148260211800302|0.0022692889561270802|0.6261058454564343|494|0.5825203529939815|0.6696913379188871|0.5524568940011921|Moderate|7|3|1|0.6006051437216339
Shopping|1920|0.7458333333333333|0.0015625|0.6320774441241062|706|0.5884919516616534|0.675662936586559|0.5484197904764829|Moderate|8|3|0|0.5222395833333333
Others-CCCPS135a|3883|0.7651300540818955|0.0007725985063095545|0.6485684168574817|1365|0.6049829243950289|0.6921539093199345|0.5371758217587584|Moderate|9|3|0|0.5356682977079578
Others-CCCPS105a|2009|0.7730214036834245|0.0014932802389248383|0.6691771763231928|665|0.62559168386074|0.7127626687856456|0.5226446552116789|Moderate|10|3|0|0.5412643106022896
Broad Street|690|0.8782608695652174|0.002898550724637681|0.758117931713973|167|0.7145324392515202|0.8017034241764258|0.46008675191234955|High|11|2|0|0.615072463768116
BHMEURBRD01|470|0.8914893617021277|0.006382978723404255|0.7704390519083948|108|0.726853559445942|0.8140245443708476|0.4508007981048789|High|12|3|0|0.6246808510638298
BHMMBMMBX01|687|0.8850072780203785|0.004366812227074236|0.776852494040154|153|0.7332670015777012|0.8204379865026068|0.4464147561634098|High|13|3|1|0.7199417758369724
BHMBCCTHL01|387|1.0|0.007751937984496124|0.9693992393985247|12|0.9258137469360719|1.0|0.31263466561916986|Critical|14|3|0|0.7007751937984495
"""

# site profiles and the published cluster label
PROFILES = """
26.144536140000003|91.73617216|577|162.47972456006121|573|0.2815939767072118|0.17214348868066323|3.6514919663351186|0.22800306044376434|0.1499617444529457|0.27846782887504823|2
26.144494589999997|91.73620513|387|287.1407804131599|387|0.7419658408608784|0.231330422600013|4.137209895434838|0.2234123947972456|0.1499617444529457|0.6018529392188223|0
26.14901995|91.7395035|470|303.3897396630934|470|0.6455100843895604|0.2914797316625853|4.018249106687085|0.22434915773353753|0.15007656967840735|0.5324976105915957|0
20.0000347|78.00000286|687|477.9938791124713|687|0.6957698385916613|0.17523099856314703|4.471818413669983|0.22647283856159142|0.1499617444529457|0.5684855221037618|4
26.14001386|91.73099967|1200|560.8941563467492|954|0.46741179695562435|0.1857008353966374|4.535216718266254|0.2260061919504644|0.14705882352941177|0.40929993872549014|1
26.14004753|91.73097233|485|286.4949768160742|467|0.5907112924042767|0.11805757090406536|4.123724884080371|0.23956723338485317|0.14760432766615147|0.4956464570818528|1
26.13795775|91.74099445|690|437.41194486983153|690|0.6339303548838139|0.29712559170692376|4.28177641653905|0.21362940275650844|0.15007656967840735|0.5241574006258739|0
26.14747299|91.72804914|2009|1140.2884468247896|1914|0.5675900681059182|0.1354821325424385|5.150854373884213|0.22800306044376434|0.1499617444529457|0.4794363073387304|3
26.14754061|91.72797041|2803|541.5631216526397|1534|0.19320839159922926|0.08742128064023141|4.549349655700077|0.23335883703136956|0.1499617444529457|0.21628040346977673|2
26.14749943|91.72800489|3883|2297.5087987758225|3499|0.5916839553890865|0.2269841209874229|5.592323386891099|0.22417750573833206|0.1499617444529457|0.49420037171163705|3
26.14749053|91.72799688|2937|1012.7452180566182|1467|0.34482302283167116|0.09989308978154678|5.042336138740117|0.22417750573833206|0.1499617444529457|0.32196095910924444|2
26.147548859999997|91.72799519|1322|662.2938026013773|1235|0.5009786706515713|0.1291888474802866|4.747895944912012|0.2325937260902831|0.1499617444529457|0.43115132991560623|2
26.147499979999996|91.72797778|3103|1016.8209640397857|1911|0.3276896435835597|0.09285874353058567|5.029839326702372|0.22117706197398623|0.1499617444529457|0.3082747623606841|2
26.15050395|91.73353109|1920|1069.2639632746748|1637|0.5569083142055599|0.19333965220356328|5.067329762815608|0.2234123947972456|0.1499617444529457|0.4691357035832695|3
"""


@pytest.fixture(scope="module")
def board(spark):
    rows = []
    for line in BOARD.strip().splitlines():
        p = line.split("|")
        rows.append((p[0], int(p[1]), *map(float, p[2:9]), p[9], int(p[10]), int(p[11]), int(p[12]), float(p[13])))
    names = (
        "system_code string, capacity long, utilization double, capacity_pressure double, "
        "predicted_utilization_1h double, predicted_available_spaces_1h double, prediction_interval_lower double, "
        "prediction_interval_upper double, want_balanced double, want_band string, want_rank int, queue_length int, "
        "traffic_level int, want_stress double"
    )
    return spark.createDataFrame(rows, names).withColumn("uncertainty_width", F.lit(None).cast("double"))


def test_recommendations(board):
    rows = decide.recommend(board).collect()
    assert [r.recommendation_rank for r in rows] == list(range(1, 15))
    for r in rows:
        assert r.recommendation_rank == r.want_rank and r.risk_band == r.want_band
        assert math.isclose(r.balanced_score, r.want_balanced, abs_tol=1e-12)
        assert math.isclose(r.low_risk_score, 1 - r.prediction_interval_upper, abs_tol=1e-12)


def test_free_spaces_and_stress(board):
    rows = board.select(
        X.free_spaces("capacity", "predicted_utilization_1h").alias("free"),
        "predicted_available_spaces_1h",
        X.stress_index("utilization", "traffic_level", X.capacity_pressure("queue_length", "capacity")).alias("stress"),
        "want_stress",
    ).collect()
    assert all(r.free == r.predicted_available_spaces_1h for r in rows)
    assert all(math.isclose(r.stress, r.want_stress, abs_tol=1e-12) for r in rows)


def test_interval(spark):
    radius = 0.0435855
    df = spark.createDataFrame([(0.9693992393985247,)], "predicted_utilization_1h double")
    from slotline.operators.evaluate import prediction_interval

    row = prediction_interval(df, radius).first()
    assert math.isclose(row.prediction_interval_lower, 0.9258137469, abs_tol=1e-6)
    assert row.prediction_interval_upper == 1.0


def test_champion_and_backtest_means(spark):
    from slotline.operators.evaluate import champion

    metrics = spark.createDataFrame(
        [("XGBoost", 0.027170257), ("Weighted Ensemble", 0.027350311), ("Random Forest", 0.028736522),
         ("LSTM", 0.033653563), ("Persistence Baseline", 0.06116687)],
        "model string, rmse double",
    )
    assert champion(metrics).first().model == "XGBoost"
    windows = spark.createDataFrame(
        [("m", 0.036084345, 0.022953832, 0.908765653), ("m", 0.025894858, 0.017269172, 0.919588875),
         ("m", 0.026300499, 0.018824996, 0.928700906)],
        "model string, rmse double, mae double, band_accuracy double",
    )
    row = profile.mean_metrics(windows, "model").first()
    assert math.isclose(row.avg_rmse, 0.029426567, abs_tol=1e-8)


def test_silhouette_and_explained_variance(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = [
        (f"s{i:02d}", *map(float, line.split("|")[:-1]), int(line.split("|")[-1]))
        for i, line in enumerate(PROFILES.strip().splitlines())
    ]
    names = ["system_code", *fixed.PROFILE_FEATURES, "cluster"]
    df = cluster.standardised(spark.createDataFrame(rows, names), fixed.PROFILE_FEATURES)
    wide = [f"z_{c}" for c in fixed.PROFILE_FEATURES]
    found = cluster.silhouette_euclidean(df, "cluster", wide, "system_code", block_rows=4).first()
    assert math.isclose(found.silhouette, 0.29019, abs_tol=1e-4)
    vectors = VectorAssembler(inputCols=wide, outputCol="features").transform(df)
    coords, explained = cluster.components(vectors)
    assert math.isclose(explained, 0.64077, abs_tol=1e-4)
    assert coords.count() == 14


def test_cluster_choice_runs_over_all_k(spark):
    rows = [
        (f"s{i:02d}", *map(float, line.split("|")[:-1]))
        for i, line in enumerate(PROFILES.strip().splitlines())
    ]
    out, summary = cluster.choose_clusters(spark.createDataFrame(rows, ["system_code", *fixed.PROFILE_FEATURES]), measure="euclidean")
    assert out.count() == 14 and 2 <= summary["optimal_clusters"] <= 5
    assert summary["silhouette_score"] > 0.2
