import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import anomalies, forecast, insights, timeseries
from plumbline.operators.ask import EMPTY_ANSWER, NEEDS_ORDER, Abilities, Assistant, ask, route_questions
from plumbline.operators.coercion import prepare
from plumbline.operators.row_index import row_index
from plumbline.plans.analytics import Analytics
from plumbline.plans.report import report_lines


def test_bundle_of_a_small_table(t_sales):
    a = Analytics(t_sales, order_by=["date"])
    assert (a.measure, a.dimension, a.date) == ("revenue", "product", "date")
    assert a.trend().count() == 12
    facts = a.trend_facts().first()
    assert (facts.change_pct, facts.direction, str(facts.peak_date)) == (100.0, "up", "2024-07-31")
    assert {r.name for r in a.category_breakdown().collect()} == {"A", "B", "C"}
    assert a.geo_breakdown().count() == 4
    assert [r.column for r in a.anomaly_items().orderBy("rank").collect()] == ["revenue", "orders"]
    assert a.anomaly_points().filter("is_outlier").first().t == 6
    highlights = a.highlights().first()
    assert (highlights.primary_measure, highlights.primary_total, highlights.trend_change_pct) == ("revenue", 2550.0, 100.0)
    sections = {r.section for r in a.insights().collect()}
    assert sections == set(insights.SECTIONS)
    assert report_lines(a, "Report", "sales").filter("text LIKE '%**%'").count() == 0


def test_overrides_are_checked(t_sales):
    a = Analytics(t_sales, measure="orders", dimension="region")
    assert (a.measure, a.dimension) == ("orders", "region")
    b = Analytics(t_sales, measure="region", dimension="revenue")
    assert (b.measure, b.dimension) == ("revenue", "product")


def test_table_without_measure(spark):
    a = Analytics(spark.createDataFrame([("x",), ("y",), ("x",), ("z",)], "note string"))
    assert a.measure is None and a.trend() is None and a.segmentation() is None
    assert [(r.name, r.value) for r in a.category_breakdown().collect()][0] == ("x", 2.0)
    growth = a.insights().filter("section = 'growth_trends'").collect()
    assert [r.text for r in growth] == ["Attach a date column to unlock trend and growth analysis."]
    assert a.kpi_measures().count() == 0 and a.anomaly_items().count() == 0
    assert a.highlights().first().primary_measure is None


@pytest.mark.parametrize("frequency, rule", [("month", "ME"), ("week", "W"), ("day", "D")])
def test_trend_fills_gaps_like_pandas(spark, frequency, rule):
    rng = random.Random(4)
    start = dt.datetime(2023, 11, 28, 13, 30)
    data = [(start + dt.timedelta(days=rng.choice([0, 3, 40, 41, 100, 200]), hours=rng.randrange(48)), rng.choice([None, 1.5, 2.0, -3.0])) for _ in range(60)]
    df = spark.createDataFrame(data, "d timestamp_ntz, v double")
    got = [(r.bucket, r.value) for r in timeseries.trend(df, "d", "v", frequency).orderBy("bucket").collect()]
    pdf = pd.DataFrame(data, columns=["d", "v"]).dropna().set_index("d").sort_index()["v"].resample(rule).sum()
    assert got == [(i.date(), v) for i, v in pdf.items()]


def test_short_and_zero_trends(spark):
    one = spark.createDataFrame([(dt.date(2024, 1, 5), 3.0)], "d date, v double")
    assert timeseries.trend(one, "d", "v").count() == 0
    assert timeseries.trend_facts(timeseries.trend(one, "d", "v")).count() == 0
    zero = spark.createDataFrame([(dt.date(2024, 1, 5), 0.0), (dt.date(2024, 3, 5), 9.0)], "d date, v double")
    series = timeseries.trend(zero, "d", "v")
    assert timeseries.trend_facts(series).first().change_pct == 0.0
    assert insights.insight_growth(series).count() == 0
    assert timeseries.trend_window(series, "2024-02-29").count() == 2


def test_row_index_counts_every_row_once(spark):
    # A third of the rows share the leading key.
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 101).alias("k")).repartition(7)
    got = row_index(df, ["k", "id"]).orderBy("t").collect()
    assert [r.t for r in got] == list(range(5000))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_exact_line(spark):
    df = spark.createDataFrame([(m, 100 + 50 * i) for i, m in enumerate(range(1, 7))], "month bigint, sales bigint")
    series = forecast.numeric_series(df, "sales", ["month"])
    line = forecast.fit_line(series)
    rows = forecast.linear_forecast(series, line, 3).orderBy("t").collect()
    assert [(r.forecast, r.lower, r.upper) for r in rows] == [(400.0, 400.0, 400.0), (450.0, 450.0, 450.0), (500.0, 500.0, 500.0)]
    metrics = forecast.forecast_metrics(series, line).first()
    assert (metrics.points, metrics.slope, metrics.r2, metrics.mae, metrics.rmse) == (6, 50.0, 1.0, 0.0, 0.0)
    periods = [r.period for r in forecast.forecast_export(series, line, 2).collect()]
    assert sorted(periods) == sorted([f"T-{i}" for i in range(1, 7)] + ["T+1", "T+2"])


def test_forecast_errors_and_constant_series(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, "6")], "i int, v string")
    with pytest.raises(forecast.ForecastError, match="not found"):
        forecast.numeric_series(df, "nope", ["i"])
    with pytest.raises(forecast.ForecastError, match=r"too few numeric points \(2\)"):
        forecast.fit_line(forecast.numeric_series(df, "v", ["i"]), "v")
    flat = spark.range(5).select("id", F.lit(2.0).alias("v"))
    series = forecast.numeric_series(flat, "v", ["id"])
    assert forecast.forecast_metrics(series, forecast.fit_line(series)).first().r2 == 1.0
    with pytest.raises(forecast.ForecastError):
        forecast.linear_forecast(series, forecast.fit_line(series), 3651)


def test_many_forecasts_with_one_huge_series(spark):
    rng = np.random.default_rng(6)
    data = [("big", int(i), float(v)) for i, v in enumerate(rng.normal(50, 5, 3000))]
    data += [("small", i, 10.0 + 2 * i) for i in range(5)] + [("two", i, 1.0) for i in range(2)] + [("none", 0, None)]
    rng.shuffle(data)
    df = spark.createDataFrame([(k, int(i), None if v is None else float(v)) for k, i, v in data], "k string, i bigint, v double")
    found = {r.series: r for r in forecast.forecast_many(df.repartition(5), "k", "v", ["i"]).collect()}
    assert found["two"].status == "failed" and found["two"].error == "Column 'v' has too few numeric points (2) to forecast"
    assert found["none"].points == 0 and found["none"].status == "failed"
    assert (found["small"].slope, found["small"].forecast, found["small"].lower) == (2.0, 20.0, 20.0)
    y = np.array([v for k, i, v in sorted((k, int(i), v) for k, i, v in data if k == "big")], dtype=float)
    slope, intercept = np.polyfit(np.arange(3000), y, 1)
    assert found["big"].slope == pytest.approx(slope, abs=2e-6)
    assert found["big"].forecast == pytest.approx(intercept + slope * 3000, abs=1e-3)
    margin = 1.96 * np.std(y - (intercept + slope * np.arange(3000)))
    assert found["big"].upper - found["big"].forecast == pytest.approx(margin, abs=1e-3)


def test_forecast_many_on_a_steep_line(spark):
    df = spark.range(2000).select(F.lit("s").alias("margin %"), F.col("id").alias("y"), (1e6 + 3.7 * F.col("id")).alias("t %d"))
    rows = forecast.forecast_many(df.repartition(4), "margin %", "t %d", ["y"], horizon=3).orderBy("step").collect()
    assert [r.step for r in rows] == [1, 2, 3]
    for r in rows:
        want = round(1e6 + 3.7 * (1999 + r.step), 4)
        assert (r.forecast, r.lower, r.upper) == (want, want, want)
    assert forecast.numeric_series(df, "t %d", ["y"]).count() == 2000


def test_forecast_many_failures(spark):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(5)] + [("a", 0, 1.0), ("a", 1, 2.0)], "k string, i int, `x %` double")
    rows = {r.series: r for r in forecast.forecast_many(df, "k", "x %", ["i"]).collect()}
    assert rows[None].status == "failed" and rows[None].error == "Rows without a value in column 'k'"
    assert rows["a"].error == "Column 'x %' has too few numeric points (2) to forecast" and rows["a"].step is None
    unknown = forecast.forecast_many(df, "k", "nope", ["i"])
    assert unknown.columns == forecast.forecast_many(df, "k", "x %", ["i"]).columns
    assert {(r.series, r.status, r.error) for r in unknown.collect()} == {(k, "failed", "Column 'nope' not found in dataset") for k in (None, "a")}


def test_anomaly_wording(spark):
    calm = spark.range(10).withColumnRenamed("id", "v")
    items = anomalies.anomaly_items(calm)
    assert [r.recommendation for r in anomalies.anomaly_recommendations(items).collect()] == [anomalies.NO_ANOMALIES]
    assert tuple(anomalies.anomaly_totals(items).first()) == (0, 0)
    assert anomalies.anomaly_points(calm, ["v"]).count() == 0


QUESTIONS = {
    "Which region has the highest revenue?": ("ranking", "chart"),
    "Show revenue over time": ("trend", "chart"),
    "Find anomalies": ("anomaly", "chart"),
    "Forecast next quarter": ("forecast", "chart"),
    "Strongest correlations between metrics": ("correlation", "chart"),
    "revenue breakdown by region": ("breakdown", "chart"),
    "What is the average revenue?": ("aggregate", "text"),
    "Tell me something": ("summary", "chart"),
    "highest average": ("ranking", "chart"),
    "total by region": ("breakdown", "chart"),
    "monthly growth forecast": ("forecast", "chart"),
    "how is revenue spread": ("distribution", "chart"),
}


def test_each_question_reaches_its_intent(spark, t_sales):
    assistant = Assistant(t_sales, ["date"])
    for question, (intent, kind) in QUESTIONS.items():
        answer = assistant.ask(question)
        assert (answer.intent, answer.kind) == (intent, kind), question
        assert answer.text.first().answer
    prepared = prepare(t_sales)
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "q string")
    routed = {r.q: (r.intent, r.result_type) for r in route_questions(asked, "q", Abilities.of(prepared, ["date"])).collect()}
    assert routed == QUESTIONS


def test_answers_state_the_numbers(t_sales):
    assert ask(t_sales, "What is the average revenue?").text.first().answer == "The **average revenue** is **212.5** across 12 records."
    assert "**East** has the highest revenue at **1,210**, 47.5% of the total." in ask(t_sales, "highest revenue region").text.first().answer
    assert "has the lowest revenue at **410**, the smallest the total." in ask(t_sales, "lowest revenue region").text.first().answer
    trend = ask(t_sales, "revenue trend").text.first().answer
    assert "**revenue** increased by **+100.0%** (from 100 to 200)" in trend and "- Peak: **900** on 2024-07-31" in trend
    y = np.array([100, 110, 120, 130, 140, 150, 900, 160, 170, 180, 190, 200], dtype=float)
    slope, intercept = np.polyfit(np.arange(12), y, 1)
    answer = ask(t_sales, "forecast revenue").text.first().answer
    assert f"**{slope * 17 + intercept:.2f}** in 6 periods (growing ~{slope / y.mean() * 100:+.1f}% per period" in answer
    correlated = ask(t_sales, "correlations").text.first().answer
    assert "- **revenue** ↔ **orders**: +1.00 (strong positive)" in correlated


def test_intents_without_columns_fall_through(spark):
    notes = spark.createDataFrame([("x",), ("y",), ("x",)], "note string")
    assert ask(notes, "highest revenue trend").intent == "summary"
    assert ask(notes, "share of notes").intent == "breakdown"
    assert ask(notes.limit(0), "anything").text.first().answer == EMPTY_ANSWER


def test_routers_agree_on_what_a_question_names(spark, t_sales):
    """A measure without values, and one with a single value, beside good ones."""
    gaps = t_sales.withColumns({"w": F.lit(None).cast("double"), "z": F.when(F.col("revenue") == 900, 5.0)})
    asked = [f"{what} {name}" for what in ("trend of", "distribution of", "forecast", "highest", "total") for name in ("w", "z", "revenue")]
    asked += ["w by day", "weekly trend of z", "correlation of w", *QUESTIONS]
    assistant = Assistant(gaps, ["date"])
    single = {q: assistant.ask(q) for q in asked}
    can = Abilities.of(prepare(gaps), ["date"])
    routed = {r.q: r.intent for r in route_questions(spark.createDataFrame([(q,) for q in asked], "q string"), "q", can).collect()}
    assert routed == {q: a.intent for q, a in single.items()}
    assert routed["trend of w"] == routed["distribution of w"] == "summary"
    assert "- Mean: **5**, Std dev: **nan**" in single["distribution of z"].text.first().answer


def test_undated_forecast_asks_for_an_order(spark):
    rows = spark.createDataFrame([(i, float(3 * i)) for i in range(8)], "i int, sales double").select("sales", F.col("i").cast("string").alias("k"))
    assert ask(rows.select("sales"), "forecast sales").text.first().answer == NEEDS_ORDER
    assert ask(rows.withColumn("k", F.concat(F.lit("k"), "k")), "forecast sales", ["k"]).kind == "chart"
