import datetime as dt
import graphlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import boosting, charts, filters, forecast, insights, kpi, learning, metrics, series
from tabularium.plans import models as models_plan
from tabularium.tables import Tables


@pytest.fixture
def sales(spark):
    rows = [("2024-01-05", 10.0, 1.0, "a"), ("2024-01-20", 20.0, -3.0, "b"), ("2024-03-02", 30.0, 2.0, "a"), ("2024-04-01", 5.0, 0.0, None)]
    return spark.createDataFrame([(dt.datetime.fromisoformat(d), s, p, k) for d, s, p, k in rows], "d timestamp_ntz, s double, p double, k string")


def test_months_without_rows_count_as_zero(sales):
    got = [(str(r["period"]), r["total"]) for r in series.monthly(sales, "d", "s").orderBy("period").collect()]
    assert got == [("2024-01-01", 30.0), ("2024-02-01", 0.0), ("2024-03-01", 30.0), ("2024-04-01", 5.0)]
    change = series.last_change(series.monthly(sales, "d", "s")).first()
    assert change["change_pct"] == pytest.approx(-83.3333, abs=1e-3)
    assert series.daily(sales, "d", "s").count() == 88


def test_change_is_null_after_an_empty_month(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 5.0), (dt.datetime(2024, 3, 1), 7.0)], "d timestamp_ntz, s double")
    assert series.last_change(series.monthly(df, "d", "s")).first()["change_pct"] is None


def test_trend_and_insights(spark):
    up = spark.range(8).select(F.add_months(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("period"), (F.col("id") * 10.0 + 5).alias("total"))
    assert [r["severity"] for r in insights.trend(series.trend(up), "sales").collect()] == ["info"]
    down = up.withColumn("total", 100 - F.col("total"))
    assert [r["severity"] for r in insights.trend(series.trend(down), "sales").collect()] == ["critical"]
    assert insights.trend(series.trend(up.limit(2)), "sales").count() == 0
    label = lambda pct: [(r["type"], r["severity"]) for r in insights.recent_change(spark.createDataFrame([(1.0, float(pct))], "previous double, change_pct double"), "s").collect()]
    assert label(-15) == [("declining_performance", "warning")] and label(-30) == [("declining_performance", "critical")]
    assert label(20) == [("accelerating_performance", "info")] and label(-14.9) == label(19.9) == []
    margin = lambda v: [r["severity"] for r in insights.margin(spark.createDataFrame([("profit_margin", v)], "metric string, value double")).collect()]
    assert margin(0.04) == ["warning"] and margin(-0.1) == ["critical"] and margin(0.0) == margin(0.05) == []


def test_kpis(sales):
    one = kpi.summary(sales, "s", "p").first()
    assert (one["total_sales"], one["total_profit"], one["profit_margin_percentage"]) == (65.0, 0.0, 0.0)
    totals = kpi.group_totals(sales, "k", "s")
    assert sorted(tuple(r) for r in totals.collect()) == [("a", 40.0), ("b", 20.0)]
    assert kpi.best_and_worst(totals, "k").first()["best"] == "a"
    assert [tuple(r) for r in kpi.loss_makers(kpi.group_totals(sales, "k", "p"), "k").collect()] == [("b", 3.0)]


def test_ties_go_to_the_smaller_key(spark):
    t = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0)], "k string, total double")
    one = kpi.best_and_worst(t, "k").first()
    assert (one["best"], one["worst"]) == ("a", "a")


def test_drivers_need_both_periods(spark):
    rows = [(1, "a", "x", 5.0), (2, "a", "x", 9.0), (1, "b", "x", 4.0), (2, "c", "x", 50.0)]
    marked = spark.createDataFrame(rows, "period int, k string, g string, s double")
    got = {r["column_name"]: (r["value"], r["diff"]) for r in kpi.drivers(marked, ["k", "g"], "s", kpi.compare_periods(marked, "s")).collect()}
    assert got == {"k": ("a", 4.0), "g": ("x", 50.0)}


def test_metric_formulas(sales):
    wanted = {"a": {"column": "s", "aggregation": "sum"}, "z": {"column": "p", "aggregation": "sum"},
              "r": {"formula": "a / z"}, "m": {"formula": "-(a - 5) / (2 * (a + 5))"}, "n": {"formula": "m * 2 + r2"}, "r2": {"formula": "a / a / a"}}
    got = {r["metric"]: r["value"] for r in metrics.evaluate(sales, wanted).collect()}
    assert got["r"] is None and got["m"] == pytest.approx(-60 / 140, abs=1e-4) and got["r2"] == pytest.approx(1 / 65, abs=1e-4)
    with pytest.raises(graphlib.CycleError):
        metrics.evaluate(sales, {"x": {"formula": "y"}, "y": {"formula": "x"}})
    with pytest.raises(ValueError):
        metrics.evaluate(sales, {"x": {"formula": "a; drop"}})


def test_filters(spark):
    df = spark.createDataFrame([(1, "North", "7"), (2, None, "12"), (3, "south", "x")], "id int, r string, t string")
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    assert ids(filters.matching(df, {"r": [], "nope": ["q"]})) == [1, 2, 3]
    assert ids(filters.matching(df, {"t": {"min": 7}})) == [1, 2]
    assert ids(filters.containing(df, "OUTH")) == [3] and ids(filters.containing(df, "")) == [1, 2, 3]
    assert ids(filters.containing(df, "2")) == [2]
    assert ids(filters.sparse_rows_dropped(df, 0.3)) == [1, 3]


def test_chart_labels_and_share(spark):
    df = spark.createDataFrame([(None, 1.0), ("", 2.0), ("a very long label that is cut", 3.0), ("z", -4.0)], "x string, y double")
    rows = {r["name"]: r["value"] for r in charts.aggregate(df, "x", "y", "sum").collect()}
    assert rows == {"a very long label ": 3.0, "Unknown": 3.0, "z": -4.0}
    assert [(r["name"], r["pct"]) for r in charts.share(df, "x", "y").collect()] == [("Unknown", 150.0), ("a very long label that is cut", 150.0)]
    assert charts.time_series(df.withColumn("d", F.current_timestamp()), "d", "y").count() == 4


def test_forecast_follows_a_known_process(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    level, change, rows = 100.0, 8.0, []
    for d in days:
        rows.append(("long", d, level))
        change *= 0.5
        level += change + 1e-9
    rows += [("short", d, 1.0) for d in days[:29]]
    df = spark.createDataFrame(rows, "g string, d timestamp_ntz, s double")
    out = forecast.forecast(df, "g", "d", "s").orderBy("step").collect()
    assert len(out) == 30 and {r["g"] for r in out} == {"long"}
    assert out[0]["day"] == dt.date(2024, 4, 30)
    assert out[-1]["forecast"] == pytest.approx(level, abs=0.01) and out[-1]["lower"] <= out[-1]["forecast"] <= out[-1]["upper"]
    reasons = {r["g"]: r["reason"] for r in forecast.status(series.daily(df, "d", "s", ["g"]), "g").collect()}
    assert reasons == {"long": None, "short": "insufficient_time_points_min_30"}


def test_training_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("y"))
    split = lambda d: {r["id"] for r in learning.training_rows(d, "y", ["id"])[0].filter("is_train").collect()}
    assert split(df.repartition(3)) == split(df.repartition(11)) and 700 < len(split(df)) < 900


def test_models_learn(spark, monkeypatch):
    monkeypatch.setattr(learning, "TREES", 5)
    monkeypatch.setattr(learning, "ROUNDS", 5)
    monkeypatch.setattr(learning, "TREE_DEPTH", 4)
    df = spark.range(600).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", F.col("a") * 10 + F.col("b"))
    scores = {(r["model"], r["metric"]): r["value"] for r in learning.compare(df, "y", ["id"]).collect()}
    assert scores[("random_forest", "r2")] > 0.7 and scores[("boosted_trees", "r2")] > 0.7
    assert learning.importance(df, "y", ["id"]).first()["feature"] == "a"
    two = df.withColumn("y", (F.col("y") > 5).cast("int"))
    assert {r["metric"] for r in learning.compare(two, "y", ["id"], classify=True).collect()} == {"accuracy", "f1"}


def _counted(df, seen):
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return df.mapInArrow(run, df.schema)


@pytest.mark.parametrize("classify", [False, True])
def test_models_read_their_input_once(spark, monkeypatch, classify):
    """Medians, classes and training share one written table, so what makes the rows (joins, sums) runs once."""
    for name in ("TREES", "ROUNDS", "TREE_DEPTH"):
        monkeypatch.setattr(learning, name, 2)
    df = spark.range(300).select("id", F.rand(1).alias("a"), F.when(F.col("id") % 9 > 0, F.rand(2)).alias("b"),
                                 ((F.col("id") % 2) if classify else F.rand(3)).alias("y"))
    for rows in (df, df.where("b IS NOT NULL")):
        n, seen = rows.count(), spark.sparkContext.accumulator(0)
        assert learning.compare(_counted(rows, seen), "y", ["id"], classify=classify).count()
        assert seen.value == n


def test_written_training_rows_have_medians_for_nulls(spark):
    """The same rows as from ``training_rows``; a column without values becomes 0, rows without a target are left out."""
    df = spark.range(500).select(
        "id", F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("a"), F.when(F.col("id") % 7 > 0, F.sqrt("id")).alias("b"),
        F.lit(None).cast("double").alias("c"), F.col("id").cast("int").alias("d"), F.when(F.col("id") % 11 > 0, F.col("id") * 1.5).alias("y"))
    expected, features = learning.training_rows(df, "y", ["id"])
    ready, names = learning.prepared(df, "y", ["id"])
    assert names == features == ["a", "b", "c", "d"] and ready.columns == ["features", "label", "is_train"]
    made = sorted((r.label, r.is_train, *r.features.toArray()) for r in ready.collect())
    assert made == sorted((r.y, r.is_train, r.a, r.b, r.c, r.d) for r in expected.collect()) and len(made) == 454


def test_scores_predict_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)
    pairs = spark.range(200).select((F.col("id") % 3).cast("double").alias("prediction"), (F.col("id") % 2).cast("double").alias("label"))
    for classify in (False, True):
        assert len(learning._scores(_counted(pairs, seen), classify)) == 2
    assert seen.value == 400


def test_names_that_would_look_alike_stay_whole(spark):
    long = "a name of more than twenty letters "
    df = spark.createDataFrame([(long + "one", 3.0), (long + "two", 2.0), ("another quite long name too", 1.0)], "k string, v double")
    assert [r["x"] for r in charts.top(df, "k", "v").orderBy(F.desc("y")).collect()] == [long + "one", long + "two", "another quite long n"]
    assert sorted(r["name"] for r in charts.aggregate(df, "k", "v", "sum").collect()) == sorted([long + "one", long + "two", "another quite long"])


def test_softmax_boosting_of_three_classes(spark):
    """Bounds: nine of ten held-out rows right on rings that no single split parts, and a loss that falls with every round."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, size=(900, 3))
    ring = np.digitize(np.hypot(x[:, 0], x[:, 1]), [0.45, 0.85])
    df = spark.createDataFrame([(i, *map(float, v), ["inner", "middle", "outer"][c]) for i, (v, c) in enumerate(zip(x, ring))], "id long, a double, b double, c double, ring string")
    rows, classes = learning.numbered_classes(df, "ring")
    ready, _ = learning.prepared(rows, "ring", ["id"])
    assert classes == 3
    losses = []
    for rounds in (1, 3, 6):
        model = boosting.SoftmaxBoosting(3, rounds, depth=4)
        done = model.fit(ready)
        losses.append(boosting.log_loss(done.where("is_train")))
    start = -sum(p * math.log(p) for p in np.bincount(ring) / 900)
    assert start + 0.02 > losses[0] > losses[1] > losses[2]
    held = boosting.predicted(done.where("NOT is_train"))
    assert held.where("prediction = label").count() >= 0.9 * held.count() > 100
    again = boosting.predicted(model.transform(ready.where("NOT is_train"), per_plan=4))
    assert sorted(r.prediction for r in again.collect()) == sorted(r.prediction for r in held.collect())
    with pytest.raises(ValueError):
        boosting.SoftmaxBoosting(3, 1).fit(ready.where("false"))


def test_boosting_on_segments_lowers_the_loss(spark, folder):
    """Segments are drawn at random, so held-out accuracy is near one in five; the training loss must be below that of no model."""
    got = {r["metric"]: r["value"] for r in models_plan.ml_segment_metrics(Tables(spark, folder)).collect()}
    assert set(got) == {"accuracy", "f1", "train_log_loss"} and got["train_log_loss"] < math.log(5) and got["accuracy"] < 0.6


def test_recommendations_sum_lines_before_parts_are_joined(tables, monkeypatch):
    from tabularium.plans import business
    asked, wide = [], business.sales_wide
    monkeypatch.setattr(business, "sales_wide", lambda t, columns: asked.append(list(columns)) or wide(t, columns))
    assert {r["rule"] for r in business.recommendations(tables).collect()} <= {1, 2, 3}
    assert asked and not any({"price", "product", "profit"} & set(columns) for columns in asked)
