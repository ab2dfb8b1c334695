from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import py_round
from plumbline.operators import anomalies, breakdown, insights, profile
from plumbline.operators.timeseries import trend
from plumbline.plans.analytics import Analytics
from plumbline.plans.report import report_highlights as highlights_of
from plumbline.plans.report import report_lines as lines_of
from plumbline.plans.report import report_sections as sections_of
from workload.inputs import EVENTS_DIRTY, SALES, events_dirty, sales, table
from workload.profiling import DIRTY_FACTS, SUGGESTIONS
from workload.registry import query, rnd


def breakdown_sql(dimension: str, measure: str, k: int) -> str:
    return f"""SELECT name, {rnd("value", 2)} AS value, {rnd("value / CASE WHEN shown = 0 THEN 1 ELSE shown END * 100", 1)} AS pct
FROM (SELECT *, sum(value) OVER () AS shown FROM (
  SELECT {dimension} AS name, coalesce(fsum({measure}), 0) AS value FROM sales WHERE {dimension} IS NOT NULL
  GROUP BY 1 ORDER BY value DESC, name LIMIT {k}))"""


@query("category_breakdown", f"WITH {SALES}\n" + breakdown_sql("region", "revenue", 10))
def category_breakdown(spark, sf_dir):
    return breakdown.category_breakdown(sales(spark, sf_dir))


@query("breakdown_override", f"WITH {SALES}\n" + breakdown_sql("segment", "quantity", 10))
def breakdown_override(spark, sf_dir):
    return breakdown.category_breakdown(sales(spark, sf_dir), measure="quantity", dimension="segment")


@query(
    "pie_slice",
    f"""WITH {SALES}
SELECT country AS name, {rnd("fsum(revenue)", 2)} AS value FROM sales GROUP BY country ORDER BY fsum(revenue) DESC, name LIMIT 6""",
)
def pie_slice(spark, sf_dir):
    return breakdown.pie_slice(breakdown.breakdown(sales(spark, sf_dir), "country", "revenue"))


@query(
    "count_breakdown",
    f"""SELECT name, value, {rnd("value / sum(value) OVER () * 100", 1)} AS pct FROM (
  SELECT p_type AS name, CAST(count(*) AS DOUBLE) AS value FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY value DESC, name LIMIT 10)""",
)
def count_breakdown(spark, sf_dir):
    return breakdown.breakdown(table(spark, sf_dir, "part"), "p_type", None)


@query(
    "geo_breakdown",
    f"""WITH {SALES}
SELECT region AS name, {rnd("fsum(revenue)", 2)} AS value FROM sales GROUP BY region ORDER BY fsum(revenue) DESC, name LIMIT 12""",
)
def geo_breakdown(spark, sf_dir):
    return breakdown.geo_breakdown(sales(spark, sf_dir))


@query(
    "segmentation",
    f"""WITH {SALES}, q AS (SELECT quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.5) AS q2, quantile_cont(revenue, 0.75) AS q3 FROM sales)
SELECT segment, count(*) AS records FROM (
  SELECT CASE WHEN revenue <= q1 THEN 'Low' WHEN revenue <= q2 THEN 'Medium' WHEN revenue <= q3 THEN 'High' ELSE 'Top' END AS segment
  FROM sales CROSS JOIN q WHERE revenue IS NOT NULL) GROUP BY segment""",
)
def segmentation(spark, sf_dir):
    return breakdown.segmentation(sales(spark, sf_dir), "revenue")


@query(
    "kpi_measures",
    f"""WITH {SALES}, m AS (
  SELECT 0 AS i, 'revenue' AS name, var_samp(revenue) AS v, fsum(revenue) AS total, favg(revenue) AS mean, min(revenue) AS lo, max(revenue) AS hi FROM sales
  UNION ALL SELECT 1, 'quantity', var_samp(quantity), fsum(quantity), favg(quantity), min(quantity), max(quantity) FROM sales
  UNION ALL SELECT 2, 'discount', var_samp(discount), fsum(discount), favg(discount), min(discount), max(discount) FROM sales)
SELECT name, {rnd("total", 2)} AS total, {rnd("mean", 2)} AS mean, {rnd("lo", 2)} AS min, {rnd("hi", 2)} AS max, name = 'revenue' AS is_primary
FROM m ORDER BY v DESC, i LIMIT 4""",
)
def kpi_measures(spark, sf_dir):
    return breakdown.kpi_measures(sales(spark, sf_dir))


# The only measure of the given tables with outliers is events.value.
ITEMS = f"""fences AS (
  SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
    SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)),
outside AS (SELECT value, low, high FROM events CROSS JOIN fences WHERE value < low OR value > high),
extremes AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS place FROM (SELECT abs(value) AS size FROM outside) ORDER BY size DESC LIMIT 3),
number AS (
  SELECT low, high,
    CASE WHEN abs(low) >= 1000 THEN format('{{:,.0f}}', low) ELSE rtrim(rtrim(format('{{:,.2f}}', low), '0'), '.') END AS low_text,
    CASE WHEN abs(high) >= 1000 THEN format('{{:,.0f}}', high) ELSE rtrim(rtrim(format('{{:,.2f}}', high), '0'), '.') END AS high_text FROM fences),
items AS (
  SELECT 1 AS rank, 'value' AS "column", n AS count, n / total AS ratio, {rnd("n / total * 100", 1)} AS pct,
         CASE WHEN n / total > 0.1 THEN 'high' WHEN n / total > 0.03 THEN 'medium' ELSE 'low' END AS severity,
         {rnd("low", 2)} AS lower_bound, {rnd("high", 2)} AS upper_bound,
         CAST(n AS VARCHAR) || ' value(s) fall outside the expected range [' || low_text || ', ' || high_text || '].' AS root_cause
  FROM (SELECT count(*) AS n FROM outside) CROSS JOIN (SELECT count(*) AS total FROM events) CROSS JOIN number WHERE n > 0)"""


@query(
    "anomaly_items",
    f"""WITH {ITEMS}
SELECT rank, "column", count, pct, severity, lower_bound, upper_bound, root_cause,
       (SELECT {rnd("size", 2)} FROM extremes WHERE place = 1) AS extreme_1,
       (SELECT {rnd("size", 2)} FROM extremes WHERE place = 2) AS extreme_2,
       (SELECT {rnd("size", 2)} FROM extremes WHERE place = 3) AS extreme_3 FROM items""",
)
def anomaly_items(spark, sf_dir):
    items = anomalies.anomaly_items(table(spark, sf_dir, "events"))
    return items.select(
        *[c for c in items.columns if c != "extremes"], *[F.get("extremes", i).alias(f"extreme_{i + 1}") for i in range(3)]
    )


@query(
    "anomaly_points",
    f"""WITH {ITEMS}
SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS t, {rnd("value", 2)} AS value, value < low OR value > high AS is_outlier
FROM events CROSS JOIN fences WHERE value IS NOT NULL""",
)
def anomaly_points(spark, sf_dir):
    return anomalies.anomaly_points(table(spark, sf_dir, "events"), ["ts", "event_id"])


@query(
    "anomaly_recommendations",
    f"""WITH {ITEMS}
SELECT 0 AS ordinal, CASE WHEN severity = 'high'
  THEN 'Investigate **value** — ' || format('{{:.1f}}', pct) || '% of values are outliers; check for data-entry or process issues.'
  ELSE 'Review **value** outliers before aggregating; consider capping or excluding extreme values.' END AS recommendation FROM items
UNION ALL SELECT 0, 'No statistical anomalies detected — the numeric data is consistent.' WHERE NOT EXISTS (SELECT 1 FROM items)""",
)
def anomaly_recommendations(spark, sf_dir):
    return anomalies.anomaly_recommendations(anomalies.anomaly_items(table(spark, sf_dir, "events")))


@query(
    "anomaly_totals",
    f"""WITH {ITEMS}
SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS outliers, count(*) AS columns_affected FROM items""",
)
def anomaly_totals(spark, sf_dir):
    return anomalies.anomaly_totals(anomalies.anomaly_items(table(spark, sf_dir, "events")))


GROUPS = """groups AS (SELECT region AS name, coalesce(fsum(revenue), 0) AS value FROM sales GROUP BY region),
ends AS (
  SELECT (SELECT name FROM groups ORDER BY value DESC, name LIMIT 1) AS leader,
         (SELECT max(value) FROM groups) / (SELECT sum(value) FROM groups) * 100 AS leader_share,
         (SELECT name FROM groups ORDER BY value, name DESC LIMIT 1) AS laggard, (SELECT count(*) FROM groups) AS n)"""


@query(
    "insight_concentration",
    f"""WITH {SALES}, {GROUPS}
SELECT leader, {rnd("leader_share", 6)} AS leader_share, leader_share > 50 AS is_concentrated, CASE WHEN n > 2 THEN laggard END AS laggard FROM ends""",
)
def insight_concentration(spark, sf_dir):
    found = insights.insight_concentration(sales(spark, sf_dir), "region", "revenue")
    return found.withColumn("leader_share", py_round(F.col("leader_share"), 6))


@query(
    "insight_driver",
    """WITH r AS (
"""
    + "\nUNION ALL\n".join(
        f"SELECT {i} AS i, '{c}' AS driver, corr(l_extendedprice, CAST({c} AS DOUBLE)) AS r FROM lineitem"
        for i, c in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"])
    )
    + f""")
SELECT driver, {rnd("r", 6)} AS r, CASE WHEN r > 0 THEN 'moves with' ELSE 'moves against' END AS effect
FROM (SELECT * FROM r WHERE NOT isnan(r) ORDER BY abs(r) DESC, i LIMIT 1) WHERE abs(r) > 0.3""",
)
def insight_driver(spark, sf_dir):
    found = insights.insight_driver(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return found.withColumn("r", py_round(F.col("r"), 6))


@query(
    "insight_driver_found",
    f"""WITH net AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, -l_extendedprice * l_tax AS tax, l_quantity AS quantity FROM lineitem),
r AS (SELECT 0 AS i, 'net' AS driver, corr(price, net) AS r FROM net UNION ALL SELECT 1, 'tax', corr(price, tax) FROM net
      UNION ALL SELECT 2, 'quantity', corr(price, quantity) FROM net)
SELECT driver, {rnd("r", 6)} AS r, CASE WHEN r > 0 THEN 'moves with' ELSE 'moves against' END AS effect
FROM (SELECT * FROM r WHERE NOT isnan(r) ORDER BY abs(r) DESC, i LIMIT 1) WHERE abs(r) > 0.3""",
)
def insight_driver_found(spark, sf_dir):
    """Prices and what is derived from them: a strong driver and a negative one."""
    price = F.col("l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(
        price.alias("price"), (price * (1 - F.col("l_discount"))).alias("net"), (-price * F.col("l_tax")).alias("tax"), F.col("l_quantity").alias("quantity")
    )
    found = insights.insight_driver(lines, "price")
    return found.withColumn("r", py_round(F.col("r"), 6))


MONTHS = """months AS (
  SELECT bucket, coalesce(value, 0) AS value FROM (
    SELECT last_day(CAST(m AS DATE)) AS bucket FROM (
      SELECT unnest(generate_series(date_trunc('month', min(order_date)), date_trunc('month', max(order_date)), INTERVAL 1 MONTH)) AS m FROM sales))
  LEFT JOIN (SELECT last_day(order_date) AS bucket, fsum(revenue) AS value FROM sales GROUP BY 1) USING (bucket)),
span AS (SELECT arg_min(value, bucket) AS first, arg_max(value, bucket) AS last, count(*) AS n FROM months),
growth AS (SELECT (last - first) / abs(first) * 100 AS change FROM span WHERE n >= 2 AND first <> 0)"""


@query(
    "insight_growth",
    f"""WITH {SALES}, {MONTHS}
SELECT {rnd("change", 6)} AS change_pct, CASE WHEN change > 0 THEN 'grown' ELSE 'declined' END AS word,
       CASE WHEN change < 0 THEN 'risk' ELSE 'opportunity' END AS outlook FROM growth""",
)
def insight_growth(spark, sf_dir):
    found = insights.insight_growth(trend(sales(spark, sf_dir), "order_date", "revenue"))
    return found.withColumn("change_pct", py_round(F.col("change_pct"), 6))


@query(
    "insight_quality",
    f"""WITH {EVENTS_DIRTY}, {DIRTY_FACTS}
SELECT {rnd("missing_cells / total_cells * 100", 6)} AS missing_pct, missing_cells / total_cells * 100 > 5 AS is_incomplete, duplicate_rows FROM scored""",
)
def insight_quality(spark, sf_dir):
    return insights.insight_quality(events_dirty(spark, sf_dir)).withColumn("missing_pct", py_round(F.col("missing_pct"), 6))


SALES_COLUMNS = ["order_date", "region", "country", "segment", "revenue", "quantity", "discount"]
_NULL_CELLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in SALES_COLUMNS)


def number_sql(x: str) -> str:
    return (
        f"CASE WHEN abs({x}) >= 1000 THEN format('{{:,.0f}}', CAST({x} AS DOUBLE)) "
        f"ELSE rtrim(rtrim(format('{{:,.2f}}', CAST({x} AS DOUBLE)), '0'), '.') END"
    )


INSIGHTS = f"""{GROUPS}, {MONTHS},
drivers AS (
  SELECT * FROM (
    SELECT 1 AS i, 'quantity' AS name, corr(revenue, quantity) AS r FROM sales
    UNION ALL SELECT 2, 'discount', corr(revenue, discount) FROM sales) WHERE NOT isnan(r) ORDER BY abs(r) DESC, i LIMIT 1),
driver AS (SELECT * FROM drivers WHERE abs(r) > 0.3),
quality AS (
  SELECT count(*) AS records, ({_NULL_CELLS}) / (count(*) * 7) * 100 AS missing_pct, fsum(revenue) AS total, favg(revenue) AS mean,
         (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM sales GROUP BY {", ".join(SALES_COLUMNS)})) AS copies FROM sales),
found AS (
  SELECT 0 AS s, 0 AS o, format('{{:,}}', records) || ' records across 7 columns.' AS text FROM quality
  UNION ALL SELECT 0, 1, 'Total revenue is ' || {number_sql("total")} || ' (avg ' || {number_sql("mean")} || ').' FROM quality
  UNION ALL SELECT 0, 2, '**' || leader || '** leads region with ' || format('{{:.0f}}', leader_share) || '% of revenue.' FROM ends
  UNION ALL SELECT 1, 0, '**' || laggard || '** underperforms in revenue — targeted growth here could lift the total.' FROM ends WHERE n > 2
  UNION ALL SELECT 1, 1, 'Positive momentum in revenue (+' || format('{{:.0f}}', change) || '%) — consider scaling what''s working.' FROM growth WHERE change >= 0
  UNION ALL SELECT 2, 0, 'Revenue is concentrated: **' || leader || '** alone drives ' || format('{{:.0f}}', leader_share) || '% of revenue — a single-point dependency.'
            FROM ends WHERE leader_share > 50
  UNION ALL SELECT 2, 1, 'revenue is trending down (' || format('{{:+.0f}}', change) || '%) — investigate the drivers.' FROM growth WHERE change < 0
  UNION ALL SELECT 2, 2, format('{{:.0f}}', missing_pct) || '% of cells are missing — clean the data before high-stakes decisions.' FROM quality WHERE missing_pct > 5
  UNION ALL SELECT 2, 3, CAST(copies AS VARCHAR) || ' duplicate row(s) may inflate aggregates.' FROM quality WHERE copies > 0
  UNION ALL SELECT 3, 0, '**' || name || '** ' || CASE WHEN r > 0 THEN 'moves with' ELSE 'moves against' END || ' revenue (r=' || format('{{:+.2f}}', r) || ') — a key lever.' FROM driver
  UNION ALL SELECT 4, 0, 'revenue has ' || CASE WHEN change > 0 THEN 'grown' ELSE 'declined' END || ' ' || format('{{:+.0f}}', change) || '% over the observed period.' FROM growth
  UNION ALL SELECT 5, 0, 'Run smart cleaning to impute or drop missing values.' FROM quality WHERE missing_pct > 5
  UNION ALL SELECT 5, 1, 'Double down on ' || name || ' to influence revenue.' FROM driver),
defaults(s, section, text) AS (VALUES
  (0, 'key_insights', NULL),
  (1, 'opportunities', 'Explore correlations and segments to surface untapped growth areas.'),
  (2, 'risks', 'No major risks detected in the current data.'),
  (3, 'revenue_drivers', 'Add more numeric metrics to reveal statistical revenue drivers.'),
  (4, 'growth_trends', 'Attach a date column to unlock trend and growth analysis.'),
  (5, 'recommendations', 'Data looks healthy — proceed to forecasting and scenario analysis.')),
insights AS (
  SELECT s, section, CAST(row_number() OVER (PARTITION BY s ORDER BY o) - 1 AS INTEGER) AS ordinal, text FROM (
    SELECT f.s, d.section, f.o, f.text FROM found f JOIN defaults d ON f.s = d.s
    UNION ALL SELECT s, section, 0, text FROM defaults WHERE s NOT IN (SELECT s FROM found)))"""


@query("insights", f"WITH {SALES}, {INSIGHTS}\nSELECT section, ordinal, text FROM insights")
def all_insights(spark, sf_dir):
    return Analytics(sales(spark, sf_dir), keep=True).insights()


@query(
    "report_highlights",
    f"""WITH {SALES}, {MONTHS},
size AS (
  SELECT count(*) AS records, {_NULL_CELLS} AS missing, fsum(revenue) AS total,
         (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM sales GROUP BY {", ".join(SALES_COLUMNS)})) AS copies FROM sales),
outliers AS (
  SELECT sum(n) AS n FROM ({" UNION ALL ".join(f'''
    SELECT count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n FROM sales
    CROSS JOIN (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM sales)''' for c in ("revenue", "quantity", "discount"))}))
SELECT CAST(greatest(0, least(100, round_even(100.0 - missing / (7 * records) * 40 - copies / records * 35 - outliers.n / (7 * records) * 2500, 0))) AS INTEGER) AS quality_score,
       'revenue' AS primary_measure, {rnd("CASE WHEN first = 0 THEN 0 ELSE (last - first) / abs(first) * 100 END", 1)} AS trend_change_pct,
       {rnd("total", 2)} AS primary_total
FROM size CROSS JOIN outliers CROSS JOIN span""",
)
def report_highlights(spark, sf_dir):
    return highlights_of(Analytics(sales(spark, sf_dir), keep=True))


@query(
    "report_sections",
    f"""WITH {EVENTS_DIRTY}, {DIRTY_FACTS}, {SUGGESTIONS}
SELECT 'overview' AS section, 0 AS ordinal, 'dataset_name' AS key, 'events' AS value
UNION ALL SELECT 'overview', 1, 'source_type', 'csv'
UNION ALL SELECT 'overview', 2, 'row_count', CAST(total_rows AS VARCHAR) FROM facts
UNION ALL SELECT 'overview', 3, 'column_count', '4'
UNION ALL SELECT 'overview', 4, 'status', 'cleaned'
UNION ALL SELECT 'data_quality', 0, 'total_rows', CAST(total_rows AS VARCHAR) FROM facts
UNION ALL SELECT 'data_quality', 1, 'duplicate_rows', CAST(duplicate_rows AS VARCHAR) FROM facts
UNION ALL SELECT 'data_quality', 2, 'columns_with_missing_values', coalesce(names, '') FROM gaps
UNION ALL SELECT 'data_quality', 3, 'columns_with_outliers', CASE WHEN outlier_cells > 0 THEN 'value' ELSE '' END FROM facts
UNION ALL SELECT 'data_quality', 4, 'recommendations', string_agg(suggestion, '; ' ORDER BY ordinal) FROM suggestions
UNION ALL SELECT 'schema', i, name, dtype FROM (VALUES (0, 'event_type', 'string'), (1, 'value', 'double'), (2, 'user_text', 'string'), (3, 'day_text', 'string')) t(i, name, dtype)""",
)
def report_sections(spark, sf_dir):
    return sections_of(events_dirty(spark, sf_dir), "events")


@query(
    "report_lines",
    f"""WITH {SALES}, {INSIGHTS},
titles(section_no, section, title) AS (VALUES (2, 'key_insights', 'Key insights'), (3, 'revenue_drivers', 'Revenue drivers'), (4, 'growth_trends', 'Growth trends'),
  (5, 'opportunities', 'Opportunities'), (6, 'risks', 'Risks'), (7, 'recommendations', 'Executive recommendations'))
SELECT * FROM (VALUES (0, 0, '# Sales report'), (0, 1, ''), (0, 2, '_Executive report_'), (0, 3, ''), (1, 0, '## Overview'), (1, 1, ''), (1, 2, '- Dataset: sales'), (1, 4, '')) t(section_no, item_no, text)
UNION ALL SELECT 1, 3, '- Rows: ' || CAST(count(*) AS VARCHAR) || ' · Columns: 7' FROM sales
UNION ALL SELECT section_no, 0, '## ' || title FROM titles WHERE section IN (SELECT section FROM insights)
UNION ALL SELECT section_no, 1, '' FROM titles WHERE section IN (SELECT section FROM insights)
UNION ALL SELECT section_no, max(ordinal) + 3, '' FROM insights JOIN titles USING (section) GROUP BY section_no
UNION ALL SELECT section_no, ordinal + 2, '- ' || replace(text, '**', '') FROM insights JOIN titles USING (section)""",
)
def report_lines(spark, sf_dir):
    return lines_of(Analytics(sales(spark, sf_dir), keep=True), "Sales report", "sales")


@query(
    "quality_report",
    f"""WITH {EVENTS_DIRTY}, {DIRTY_FACTS}, {SUGGESTIONS}
SELECT total_rows, duplicate_rows, (SELECT coalesce(names, '') FROM gaps) AS missing_columns,
       CASE WHEN outlier_cells > 0 THEN 'value' ELSE '' END AS outlier_columns,
       (SELECT string_agg(suggestion, '; ' ORDER BY ordinal) FROM suggestions) AS suggestions FROM facts""",
)
def quality_report(spark, sf_dir):
    report = profile.quality_report(events_dirty(spark, sf_dir))
    lists = {"missing_columns": ", ", "outlier_columns": ", ", "suggestions": "; "}
    return report.withColumns({c: F.array_join(c, sep) for c, sep in lists.items()})
