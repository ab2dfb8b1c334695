from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import py_round
from plumbline.operators import association, coercion, profile, profile_state, quantiles, roles
from plumbline.operators.breakdown import kpi_summary
from plumbline.session import materialize
from workload.inputs import EVENTS_DIRTY, SALES, events_dirty, sales, table
from workload.registry import query, rnd

DIRTY_COLUMNS = ["event_type", "value", "user_text", "day_text"]
LINE_MEASURES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]

MISSING_CELLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in DIRTY_COLUMNS)
_DUPLICATE_GROUPS = (
    "(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT event_type, value, user_text, day_text, count(*) AS n "
    "FROM events_dirty GROUP BY event_type, value, user_text, day_text))"
)
DIRTY_FACTS = f"""fences AS (
  SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high
  FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events_dirty)),
facts AS (
  SELECT count(*) AS total_rows, {MISSING_CELLS} AS missing_cells,
         {_DUPLICATE_GROUPS} AS duplicate_rows,
         count(*) FILTER (WHERE value < low OR value > high) AS outlier_cells
  FROM events_dirty CROSS JOIN fences),
scored AS (
  SELECT *, 4 * total_rows AS total_cells,
         CAST(greatest(0, least(100, CAST(format('{{:.0f}}', CAST(100.0 - missing_cells / (4 * total_rows) * 40
              - duplicate_rows / total_rows * 35 - outlier_cells / (4 * total_rows) * 25 * 100 AS DOUBLE)) AS DOUBLE))) AS INTEGER) AS quality_score
  FROM facts)"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


@query(
    "prepare_coercion",
    f"""WITH {EVENTS_DIRTY}
SELECT event_type, value, TRY_CAST(user_text AS DOUBLE) AS user_text,
       CASE WHEN day_text LIKE '%/%' THEN CAST(strptime(day_text, '%m/%d/%Y') AS DATE) ELSE CAST(day_text AS DATE) END AS day_text
FROM events_dirty""",
)
def prepare_coercion(spark, sf_dir):
    prepared = coercion.prepare(events_dirty(spark, sf_dir))
    return prepared.withColumn("day_text", F.col("day_text").cast("date"))


@query(
    "column_roles",
    f"""WITH {SALES}, sizes AS (
  SELECT count(*) AS n, count(DISTINCT region) AS region, count(DISTINCT country) AS country, count(DISTINCT segment) AS segment FROM sales),
texts AS (
  SELECT 0 AS place, 'region' AS name, region AS d, n FROM sizes
  UNION ALL SELECT 1, 'country', country, n FROM sizes
  UNION ALL SELECT 2, 'segment', segment, n FROM sizes),
dimensions AS (SELECT place, name FROM texts WHERE d > 1 AND d <= greatest(50, n // 2 + 1))
SELECT 'measure' AS role, CAST(i AS INTEGER) AS ordinal, name AS "column" FROM (VALUES (0, 'revenue'), (1, 'quantity'), (2, 'discount')) t(i, name)
UNION ALL SELECT 'dimension', CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER), name FROM dimensions
UNION ALL SELECT 'date', 0, 'order_date'""",
)
def column_roles(spark, sf_dir):
    return roles.column_roles(sales(spark, sf_dir))


@query(
    "pick_measure",
    f"""WITH v AS (
  SELECT 0 AS i, 'c_custkey' AS measure, var_samp(c_custkey) AS v FROM customer
  UNION ALL SELECT 1, 'c_nationkey', var_samp(c_nationkey) FROM customer
  UNION ALL SELECT 2, 'c_acctbal', var_samp(c_acctbal) FROM customer)
SELECT measure, CAST(format('{{:.2f}}', CAST(v AS DOUBLE)) AS DOUBLE) AS variance FROM v ORDER BY v DESC, i LIMIT 1""",
)
def pick_measure(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    name = roles.pick_measure(df)
    return df.agg(F.var_samp(name).alias("variance")).select(F.lit(name).alias("measure"), py_round(F.col("variance"), 2).alias("variance"))


@query(
    "pick_dimension",
    f"""WITH {SALES}, d AS (
  SELECT 0 AS i, 'region' AS dimension, count(DISTINCT region) AS distinct_values FROM sales
  UNION ALL SELECT 1, 'country', count(DISTINCT country) FROM sales
  UNION ALL SELECT 2, 'segment', count(DISTINCT segment) FROM sales)
SELECT dimension, distinct_values FROM d ORDER BY distinct_values, i LIMIT 1""",
)
def pick_dimension(spark, sf_dir):
    df = sales(spark, sf_dir)
    name = roles.pick_dimension(df)
    return df.agg(F.countDistinct(name).alias("distinct_values")).select(F.lit(name).alias("dimension"), "distinct_values")


@query(
    "schema_snapshot",
    """SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS ordinal, column_name AS name,
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
       WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' ELSE 'timestamp_ntz' END AS dtype
FROM (DESCRIBE SELECT * FROM lineitem)""",
)
def schema_snapshot(spark, sf_dir):
    return roles.schema_snapshot(table(spark, sf_dir, "lineitem"))


@query(
    "schema_context",
    "SELECT 'Dataset ''sales'' with columns: order_date, region, country, segment, revenue, quantity, discount' AS context",
)
def schema_context(spark, sf_dir):
    return roles.schema_context(sales(spark, sf_dir), "sales")


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "orders"), ["o_orderkey"], limit=100)


@query("preview_size", "SELECT count(*) AS total_rows, least(count(*), 100) AS previewed_rows FROM orders")
def preview_size(spark, sf_dir):
    return profile.preview_size(table(spark, sf_dir, "orders"), limit=100)


@query(
    "missing_values",
    f"WITH {EVENTS_DIRTY}\nSELECT * FROM ("
    + _union(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
            f"CAST(format('{{:.2f}}', CAST(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100 AS DOUBLE)) AS DOUBLE) AS missing_pct FROM events_dirty"
            for c in DIRTY_COLUMNS
        ]
    )
    + ") WHERE missing_count > 0",
)
def missing_values(spark, sf_dir):
    return profile.missing_values(events_dirty(spark, sf_dir))


@query("duplicate_rows", f"WITH {EVENTS_DIRTY}\nSELECT {_DUPLICATE_GROUPS} AS duplicate_rows")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(events_dirty(spark, sf_dir))


@query(
    "duplicate_texts",
    "SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicate_rows FROM documents",
)
def duplicate_texts(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "documents").select("text"))


@query(
    "column_stats",
    _union(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS count, CAST(format('{{:.4f}}', CAST(avg({c}) AS DOUBLE)) AS DOUBLE) AS mean, CAST(format('{{:.4f}}', CAST(stddev_samp({c}) AS DOUBLE)) AS DOUBLE) AS std, "
            f"CAST(format('{{:.4f}}', CAST(CAST(min({c}) AS DOUBLE) AS DOUBLE)) AS DOUBLE) AS min, CAST(format('{{:.4f}}', CAST(quantile_cont(CAST({c} AS DOUBLE), 0.25) AS DOUBLE)) AS DOUBLE) AS q25, "
            f"CAST(format('{{:.4f}}', CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE)) AS DOUBLE) AS median, CAST(format('{{:.4f}}', CAST(quantile_cont(CAST({c} AS DOUBLE), 0.75) AS DOUBLE)) AS DOUBLE) AS q75, "
            f"CAST(format('{{:.4f}}', CAST(CAST(max({c}) AS DOUBLE) AS DOUBLE)) AS DOUBLE) AS max FROM lineitem"
            for c in LINE_MEASURES
        ]
    ),
)
def column_stats(spark, sf_dir):
    return profile.column_stats(table(spark, sf_dir, "lineitem"))


def _outliers_sql(columns: list[str], source: str) -> str:
    return _union(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count, "
            f"any_value(q3 - q1) AS iqr FROM {source} CROSS JOIN (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
            f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})"
            for c in columns
        ]
    )


@query(
    "iqr_outliers",
    f"""SELECT "column", outlier_count FROM ({_outliers_sql(["event_id", "user_id", "value"], "events")}) WHERE outlier_count > 0 AND iqr <> 0""",
)
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(table(spark, sf_dir, "events"))


@query(
    "iqr_outliers_none",
    f"""SELECT "column", outlier_count FROM ({_outliers_sql(LINE_MEASURES, "lineitem")}) WHERE outlier_count > 0 AND iqr <> 0""",
)
def iqr_outliers_none(spark, sf_dir):
    return profile.iqr_outliers(table(spark, sf_dir, "lineitem"))


@query("quality_score", f"WITH {EVENTS_DIRTY}, {DIRTY_FACTS}\nSELECT quality_score FROM scored")
def quality_score(spark, sf_dir):
    return profile.quality_score(events_dirty(spark, sf_dir))


SUGGESTIONS = f"""gaps AS (SELECT string_agg(name, ', ' ORDER BY place) AS names FROM (
{_union([f"SELECT {i} AS place, '{c}' AS name FROM events_dirty HAVING count(*) FILTER (WHERE {c} IS NULL) > 0" for i, c in enumerate(DIRTY_COLUMNS)])})),
lines AS (
  SELECT 0 AS place, 'Impute or drop missing values in: ' || names AS suggestion FROM gaps WHERE names IS NOT NULL
  UNION ALL SELECT 1, 'Remove ' || CAST(duplicate_rows AS VARCHAR) || ' duplicate row(s)' FROM facts WHERE duplicate_rows > 0
  UNION ALL SELECT 2, 'Review outliers detected via IQR in: value' FROM facts WHERE outlier_cells > 0),
suggestions AS (
  SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS ordinal, suggestion FROM (
    SELECT * FROM lines UNION ALL SELECT 3, 'No major data quality issues detected' WHERE NOT EXISTS (SELECT 1 FROM lines)))"""


@query("quality_suggestions", f"WITH {EVENTS_DIRTY}, {DIRTY_FACTS}, {SUGGESTIONS}\nSELECT ordinal, suggestion FROM suggestions")
def quality_suggestions(spark, sf_dir):
    return profile.quality_suggestions(events_dirty(spark, sf_dir))


def _corr(a: str, b: str, digits: int) -> str:
    both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return (
        f"CASE WHEN stddev_pop({a}) {both} > 0 AND stddev_pop({b}) {both} > 0 "
        f"THEN CAST(format('{{:.{digits}f}}', CAST(covar_pop({a}, {b}) / (stddev_pop({a}) {both} * stddev_pop({b}) {both}) AS DOUBLE)) AS DOUBLE) END"
    )


@query(
    "correlation_matrix",
    _union(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, {_corr(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)', 4)} AS corr FROM lineitem"
            for a in LINE_MEASURES
            for b in LINE_MEASURES
        ]
    ),
)
def correlation_matrix(spark, sf_dir):
    return association.correlation_matrix(table(spark, sf_dir, "lineitem"))


PAIRS = _union(
    [
        f"SELECT {i * 10 + j} AS place, '{a}' AS a, '{b}' AS b, {_corr(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)', 12)} AS r FROM lineitem"
        for i, a in enumerate(LINE_MEASURES)
        for j, b in enumerate(LINE_MEASURES)
        if i < j
    ]
)


@query(
    "correlation_pairs",
    f"""SELECT a, b, CAST(format('{{:.3f}}', CAST(r AS DOUBLE)) AS DOUBLE) AS value,
  CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({PAIRS}) WHERE r IS NOT NULL ORDER BY abs(CAST(format('{{:.3f}}', CAST(r AS DOUBLE)) AS DOUBLE)) DESC, place LIMIT 5""",
)
def correlation_pairs(spark, sf_dir):
    return association.correlation_pairs(table(spark, sf_dir, "lineitem"))


def histogram_sql(column: str, source: str, most: int = 10, least: int = 1) -> str:
    """Bins of one column: each row falls between the edges around it, the last bin is closed."""
    return f"""SELECT '{column}' AS "column", CAST(b AS INTEGER) AS bin, CAST(format('{{:.3f}}', CAST(lo + b * step AS DOUBLE)) AS DOUBLE) AS start,
  CAST(format('{{:.3f}}', CAST(CASE WHEN b = bins - 1 THEN hi ELSE lo + (b + 1) * step END AS DOUBLE)) AS DOUBLE) AS "end", count(v) AS count
FROM (SELECT *, (hi - lo) / bins AS step FROM (
  SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi, bins FROM (
    SELECT min(CAST({column} AS DOUBLE)) AS mn, max(CAST({column} AS DOUBLE)) AS mx,
           least({most}, greatest({least}, count(DISTINCT {column}))) AS bins FROM {source}))) e
CROSS JOIN range(0, 64) g(b)
LEFT JOIN (SELECT CAST({column} AS DOUBLE) AS v FROM {source}) x
  ON v >= lo + b * step AND (v < lo + (b + 1) * step OR b = bins - 1)
WHERE b < bins GROUP BY b, lo, hi, bins, step"""


@query(
    "histogram",
    _union([histogram_sql(c, "lineitem") for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount")]),
)
def histogram(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return profile.histogram(df, ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount"])


@query(
    "category_distribution",
    f"WITH {EVENTS_DIRTY}\n"
    + _union(
        [
            f"(SELECT '{c}' AS \"column\", coalesce({c}, '—') AS value, count(*) AS count FROM events_dirty "
            f"GROUP BY 2 ORDER BY count DESC, value LIMIT 8)"
            for c in ("event_type", "user_text", "day_text")
        ]
    ),
)
def category_distribution(spark, sf_dir):
    return profile.category_distribution(events_dirty(spark, sf_dir))


@query(
    "kpi_summary",
    f"""WITH {EVENTS_DIRTY}, {DIRTY_FACTS}
SELECT total_rows AS row_count, 4 AS column_count, quality_score,
       CAST(format('{{:.1f}}', CAST(100 - missing_cells / total_cells * 100 AS DOUBLE)) AS DOUBLE) AS completeness, 1 AS numeric_count FROM scored""",
)
def kpis(spark, sf_dir):
    return kpi_summary(events_dirty(spark, sf_dir))


PROBS = (0.01, 0.25, 0.5, 0.75, 0.999)


@query(
    "quantiles_narrowed",
    f"""WITH p AS (SELECT unnest({list(PROBS)}) AS prob),
v AS (SELECT 'l_extendedprice' AS "column", l_extendedprice AS x FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem
      UNION ALL SELECT 'l_orderkey', CAST(l_orderkey AS DOUBLE) FROM lineitem),
s AS (SELECT "column", list_sort(list(x)) AS xs FROM v GROUP BY 1)
SELECT "column", CAST(prob AS DOUBLE) AS prob, {rnd("xs[1 + CAST(floor(pos) AS BIGINT)] + (xs[1 + CAST(ceil(pos) AS BIGINT)] - xs[1 + CAST(floor(pos) AS BIGINT)]) * (pos - floor(pos))", 6)} AS value
FROM (SELECT "column", prob, xs, CAST(prob AS DOUBLE) * (len(xs) - 1) AS pos FROM s, p)""",
)
def quantiles_narrowed(spark, sf_dir):
    """Brackets that may sort no more than 100 rows, and a coarse sketch: every step of the narrowing runs."""
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", F.col("l_orderkey").cast("double").alias("l_orderkey"))
    found = quantiles.exact_quantiles(lines, lines.columns, PROBS, settle_rows=100, accuracy=200)
    rows = [(name, prob, value) for name, values in found.items() for prob, value in zip(PROBS, values)]
    df = spark.createDataFrame(rows, "column string, prob double, value double")
    return df.withColumn("value", py_round(F.col("value"), 6))


@query(
    "event_props",
    """SELECT event_type, count(*) AS events, count(k) AS keyed, CAST(min(k) AS BIGINT) AS low, CAST(max(k) AS BIGINT) AS high
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def event_props(spark, sf_dir):
    """Values inside JSON text, read with a declared schema."""
    events = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return events.groupBy("event_type").agg(
        F.count("*").alias("events"), F.count("k").alias("keyed"), F.min("k").alias("low"), F.max("k").alias("high")
    )


@query(
    "profile_merged",
    """WITH long AS (
  UNPIVOT (SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem)
  ON l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount INTO NAME "column" VALUE v)
SELECT "column", count(*) AS rows, CAST(0 AS BIGINT) AS missing, count(v) AS numbers, CAST(format('{:.6f}', fsum(v) / count(v)) AS DOUBLE) AS mean, min(v) AS least, max(v) AS most,
  TRUE AS quartiles_near, TRUE AS different_near FROM long GROUP BY 1""",
)
def profile_merged(spark, sf_dir):
    """States of the line items of each flag and status, stored, then merged; quartiles and different values are held against the table."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    states = materialize(profile_state.profile_states(items, ["l_returnflag", "l_linestatus"]), "states")
    found = profile_state.merged_profile(states).where(F.col("column") != profile_state.ROWS)
    names = items.columns[2:]
    marks = {r["column"]: r for r in found.collect()}
    checks = [
        c.alias(f"{name}_{mark}_{i}")
        for name in names
        for mark in ("q1", "median", "q3")
        for i, c in enumerate((F.avg((F.col(name) < marks[name][mark]).cast("int")), F.avg((F.col(name) <= marks[name][mark]).cast("int"))))
    ]
    real = items.agg(*checks, *[F.countDistinct(name).alias(f"{name}_different") for name in names]).first()
    near = {
        name: all(real[f"{name}_{mark}_0"] - profile_state.RANK_ERROR <= rank <= real[f"{name}_{mark}_1"] + profile_state.RANK_ERROR for mark, rank in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
        for name in names
    }
    alike = {name: abs(marks[name]["different"] / real[f"{name}_different"] - 1) <= 2 * profile_state.DISTINCT_ERROR for name in names}
    held = spark.createDataFrame([(name, near[name], alike[name]) for name in names], "column string, quartiles_near boolean, different_near boolean")
    return found.select("column", "rows", "missing", "numbers", py_round(F.col("mean"), 6).alias("mean"), "least", "most").join(held, "column")
