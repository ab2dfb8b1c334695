from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import py_round
from plumbline.operators import forecast, seasonal, timeseries
from plumbline.operators.ask import ask_forecast as six_steps
from plumbline.operators.ask import forecast_growth, monthly_series
from workload.analytics import MONTHS
from workload.inputs import SALES, sales, table
from workload.registry import query, rnd

HORIZON = 30
ORDER = ["ts", "event_id"]


def _rounded(df, digits=2):
    return df.select("bucket", py_round(F.col("value"), digits).alias("value"))


def _buckets(source: str, date: str, value: str, bucket: str, step: str) -> str:
    return f"""SELECT bucket, {rnd("coalesce(value, 0)", 2)} AS value FROM (
  SELECT CAST(unnest(generate_series(CAST(min(b) AS TIMESTAMP), CAST(max(b) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS bucket
  FROM (SELECT {bucket} AS b FROM {source} WHERE {date} IS NOT NULL AND {value} IS NOT NULL))
LEFT JOIN (SELECT {bucket} AS bucket, fsum({value}) AS value FROM {source} WHERE {date} IS NOT NULL GROUP BY 1) USING (bucket)"""


@query("trend_monthly", f"WITH {SALES}, {MONTHS}\nSELECT bucket, {rnd('value', 2)} AS value FROM months WHERE (SELECT n FROM span) >= 2")
def trend_monthly(spark, sf_dir):
    return _rounded(timeseries.trend(sales(spark, sf_dir), "order_date", "revenue"))


@query(
    "trend_weekly",
    _buckets("orders", "o_orderdate", "o_totalprice", "CAST(o_orderdate AS DATE) + CAST((7 - isodow(o_orderdate)) AS INTEGER)", "7 DAYS"),
)
def trend_weekly(spark, sf_dir):
    return _rounded(timeseries.trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "week"))


@query("trend_daily", _buckets("orders", "o_orderdate", "o_totalprice", "CAST(o_orderdate AS DATE)", "1 DAY"))
def trend_daily(spark, sf_dir):
    return _rounded(timeseries.trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "day"))


@query(
    "trend_too_short",
    "SELECT last_day(CAST(ts AS DATE)) AS bucket, sum(value) AS value FROM events GROUP BY 1 HAVING (SELECT count(DISTINCT last_day(CAST(ts AS DATE))) FROM events) >= 2",
)
def trend_too_short(spark, sf_dir):
    """One month of events has no monthly trend."""
    return _rounded(timeseries.trend(table(spark, sf_dir, "events"), "ts", "value"))


@query(
    "trend_window",
    f"WITH {SALES}, {MONTHS}\nSELECT bucket, {rnd('value', 2)} AS value FROM months WHERE bucket BETWEEN DATE '1996-03-31' AND DATE '1998-12-31'",
)
def trend_window(spark, sf_dir):
    series = timeseries.trend(sales(spark, sf_dir), "order_date", "revenue")
    return _rounded(timeseries.trend_window(series, "1996-03-31", "1998-12-31"))


@query(
    "trend_facts",
    f"""WITH {SALES}, {MONTHS},
peak AS (SELECT bucket, value FROM months ORDER BY value DESC, bucket LIMIT 1),
low AS (SELECT bucket, value FROM months ORDER BY value, bucket LIMIT 1),
change AS (SELECT first, last, CASE WHEN first = 0 THEN 0 ELSE (last - first) / abs(first) * 100 END AS pct FROM span WHERE n >= 2)
SELECT {rnd("first", 2)} AS first, {rnd("last", 2)} AS last, {rnd("pct", 1)} AS change_pct,
       CASE WHEN pct > 1 THEN 'up' WHEN pct < -1 THEN 'down' ELSE 'flat' END AS direction,
       peak.bucket AS peak_date, {rnd("peak.value", 2)} AS peak_value, low.bucket AS low_date, {rnd("low.value", 2)} AS low_value
FROM change CROSS JOIN peak CROSS JOIN low""",
)
def trend_facts(spark, sf_dir):
    return timeseries.trend_facts(timeseries.trend(sales(spark, sf_dir), "order_date", "revenue"))


@query(
    "ask_forecast",
    f"""WITH {SALES}, {MONTHS},
fit AS (SELECT regr_slope(value, t) AS slope, regr_intercept(value, t) AS intercept, count(*) AS n, avg(value) AS mean
        FROM (SELECT value, row_number() OVER (ORDER BY bucket) - 1 AS t FROM months))
SELECT step, {rnd("intercept + slope * (n - 1 + step)", 2)} AS forecast,
       {rnd("slope / CASE WHEN mean = 0 THEN 1 ELSE abs(mean) END * 100", 4)} AS growth_pct
FROM fit CROSS JOIN range(1, 7) r(step)""",
)
def ask_forecast(spark, sf_dir):
    line = forecast.fit_line(monthly_series(sales(spark, sf_dir), "order_date", "revenue"))
    return six_steps(line, spark).select(
        "step", py_round(F.col("forecast"), 2).alias("forecast"), py_round(F.lit(forecast_growth(line)), 4).alias("growth_pct")
    )


FIT = """series AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS t, value AS y FROM events WHERE value IS NOT NULL),
fit AS (SELECT regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, count(*) AS n, avg(y) AS mean FROM series),
errors AS (SELECT y - (intercept + slope * t) AS e, y - mean AS d FROM series CROSS JOIN fit),
facts AS (SELECT sum(e * e) AS ss_res, sum(d * d) AS ss_tot, avg(abs(e)) AS mae, avg(e * e) AS mse, 1.96 * stddev_pop(e) AS margin FROM errors)"""
AHEAD = f"""SELECT n - 1 + h AS t, {rnd("intercept + slope * (n - 1 + h)", 6)} AS forecast,
  {rnd("intercept + slope * (n - 1 + h) - margin", 6)} AS lower, {rnd("intercept + slope * (n - 1 + h) + margin", 6)} AS upper
FROM fit CROSS JOIN facts CROSS JOIN range(1, {HORIZON + 1}) r(h)"""


def _series(spark, sf_dir):
    return forecast.numeric_series(table(spark, sf_dir, "events"), "value", ORDER)


@query("forecast_linear", f"WITH {FIT}\n{AHEAD}")
def forecast_linear(spark, sf_dir):
    series = _series(spark, sf_dir)
    return forecast.linear_forecast(series, forecast.fit_line(series), HORIZON)


@query(
    "forecast_metrics",
    f"""WITH {FIT}
SELECT n AS points, {rnd("slope", 6)} AS slope, {rnd("1 - ss_res / CASE WHEN ss_tot = 0 THEN 1 ELSE ss_tot END", 4)} AS r2,
       {rnd("mae", 4)} AS mae, {rnd("sqrt(mse)", 4)} AS rmse FROM fit CROSS JOIN facts""",
)
def forecast_metrics(spark, sf_dir):
    series = _series(spark, sf_dir)
    return forecast.forecast_metrics(series, forecast.fit_line(series))


@query(
    "forecast_fallback",
    f"""WITH {FIT}
SELECT *, 'sklearn_regression' AS model_used, 'Prophet is not installed; used linear regression instead.' AS note FROM ({AHEAD})""",
)
def forecast_fallback(spark, sf_dir):
    return forecast.forecast(table(spark, sf_dir, "events"), "value", ORDER, HORIZON, forecast.SEASONAL)


@query(
    "forecast_export",
    f"""WITH {FIT}
SELECT 'T-' || CAST(n - t AS VARCHAR) AS period, 'history' AS type, {rnd("y", 6)} AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
FROM series CROSS JOIN fit
UNION ALL SELECT 'T+' || CAST(t - (SELECT n FROM fit) + 1 AS VARCHAR), 'forecast', forecast, lower, upper FROM ({AHEAD})""",
)
def forecast_export(spark, sf_dir):
    series = _series(spark, sf_dir)
    return forecast.forecast_export(series, forecast.fit_line(series), HORIZON)


MANY = f"""lines AS (
  SELECT series, count(y) AS points, CASE WHEN count(y) >= 3 THEN regr_slope(y, t) END AS slope,
         CASE WHEN count(y) >= 3 THEN regr_intercept(y, t) END AS intercept
  FROM numbered GROUP BY series),
fits AS (
  SELECT l.series, points, any_value(slope) AS slope, any_value(intercept) AS intercept, sum((y - intercept - slope * t) ** 2) AS ss
  FROM numbered JOIN lines l USING (series) GROUP BY ALL),
steps AS (SELECT *, CASE WHEN points >= 3 THEN CAST(s AS INTEGER) END AS step FROM fits JOIN range(1, HORIZON + 1) r(s) ON points >= 3 OR s = 1)
SELECT series, CASE WHEN points >= 3 THEN 'done' ELSE 'failed' END AS status,
       CASE WHEN points < 3 THEN 'Column ''value'' has too few numeric points (' || CAST(points AS VARCHAR) || ') to forecast' END AS error,
       points, {rnd("slope", 6)} AS slope, step, {rnd("intercept + slope * (points + step - 1)", 4)} AS forecast,
       {rnd("intercept + slope * (points + step - 1) - 1.96 * sqrt(ss / points)", 4)} AS lower,
       {rnd("intercept + slope * (points + step - 1) + 1.96 * sqrt(ss / points)", 4)} AS upper
FROM steps"""


@query(
    "forecast_many",
    f"""WITH numbered AS (SELECT user_id AS series, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
{MANY.replace("HORIZON", "1")}""",
)
def forecast_many(spark, sf_dir):
    return forecast.forecast_many(table(spark, sf_dir, "events"), "user_id", "value", ORDER)


@query(
    "forecast_many_large_series",
    f"""WITH numbered AS (SELECT event_type AS series, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events),
{MANY.replace("HORIZON", "30")}""",
)
def forecast_many_large_series(spark, sf_dir):
    """A handful of series, each far larger than one partition should hold, thirty steps ahead."""
    return forecast.forecast_many(table(spark, sf_dir, "events"), "event_type", "value", ORDER, horizon=30)


PERIOD = 7
# A trend and the three pairs of waves that seven points tell apart span the same models as a trend and a level per place in the week.
SEASONS = f"""places AS (SELECT *, t % {PERIOD} AS place, avg(t) OVER w AS mt, avg(y) OVER w AS my, count(*) OVER (PARTITION BY series) AS n
  FROM numbered WINDOW w AS (PARTITION BY series, t % {PERIOD})),
slopes AS (SELECT series, sum((t - mt) * (y - my)) / sum((t - mt) * (t - mt)) AS slope FROM places WHERE n >= {2 * PERIOD} GROUP BY series),
levels AS (SELECT DISTINCT series, place, n, slope, my - slope * mt AS level FROM places JOIN slopes USING (series)),
spreads AS (SELECT series, 1.96 * sqrt(avg((y - level - slope * t) ** 2)) AS margin FROM places JOIN levels USING (series, place) GROUP BY series),
ahead AS (SELECT series, n, h, level + slope * (n - 1 + h) AS value, margin FROM levels JOIN spreads USING (series) JOIN range(1, {HORIZON + 1}) r(h)
  ON place = (n - 1 + h) % {PERIOD})"""


@query(
    "forecast_seasonal",
    f"""WITH numbered AS (SELECT 0 AS series, row_number() OVER (ORDER BY ts, event_id) - 1 AS t, value AS y FROM events WHERE value IS NOT NULL),
{SEASONS}
SELECT n - 1 + h AS t, {rnd("value", 6)} AS forecast, {rnd("value - margin", 6)} AS lower, {rnd("value + margin", 6)} AS upper FROM ahead""",
)
def forecast_seasonal(spark, sf_dir):
    series = _series(spark, sf_dir)
    return seasonal.seasonal_forecast(series, seasonal.fit_season(series, PERIOD), HORIZON)


@query(
    "forecast_seasonal_many",
    f"""WITH numbered AS (SELECT event_type AS series, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events WHERE value IS NOT NULL),
{SEASONS}
SELECT series, n AS points, CAST(h AS INTEGER) AS step, {rnd("value", 4)} AS forecast, {rnd("value - margin", 4)} AS lower, {rnd("value + margin", 4)} AS upper FROM ahead""",
)
def forecast_seasonal_many(spark, sf_dir):
    """A handful of series, each far larger than one partition should hold."""
    return seasonal.seasonal_many(table(spark, sf_dir, "events"), "event_type", "value", ORDER, PERIOD, HORIZON)


@query(
    "forecast_model_choice",
    f"""WITH every AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS t, value AS y, count(*) OVER () AS total FROM events WHERE value IS NOT NULL),
numbered AS (SELECT 0 AS series, t, y FROM every WHERE t < total - greatest(1, total // {seasonal.HELD_OUT})),
{SEASONS},
line AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM numbered),
errors AS (SELECT avg(abs(y - a - b * t)) AS le, avg(abs(y - level - slope * t)) AS se FROM every JOIN levels ON place = t % {PERIOD} CROSS JOIN line
  WHERE t >= total - greatest(1, total // {seasonal.HELD_OUT}))
SELECT CASE WHEN se < le THEN '{forecast.SEASONAL}' ELSE '{forecast.LINEAR}' END AS model_used, {rnd("le", 6)} AS line_error, {rnd("se", 6)} AS season_error,
  CASE WHEN se >= le THEN '{seasonal.NO_GAIN}' END AS note FROM errors""",
)
def forecast_model_choice(spark, sf_dir):
    return seasonal.compare_models(_series(spark, sf_dir), PERIOD)
