from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.functions import byte_text, compact_text, number_text, py_round
from plumbline.operators import ask, conversations
from plumbline.operators.breakdown import scalar_aggregates
from plumbline.operators.coercion import prepare
from plumbline.session import materialize
from workload.analytics import GROUPS, _NULL_CELLS, SALES_COLUMNS, number_sql
from workload.inputs import SALES, sales, table
from workload.profiling import histogram_sql
from workload.registry import query, rnd

# Phrases appended to the given user turns, so that every intent occurs among the questions.
PHRASES = [
    "Summarize the key business insights.", "Which regions have the highest revenue?", "Show the revenue trend over time.",
    "Find anomalies and outliers.", "Predict the next quarter.", "What are the strongest correlations?",
    "Show the distribution of quantity.", "Share of revenue by segment", "What is the average discount?", "weekly revenue growth",
    "lowest country by quantity", "daily quantity trend", "how many records are there", "Is it almost there?", "maximum revenue per day",
]


def questions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    return turns.select("conv_id", "turn", F.concat(F.col("text"), F.lit(" "), phrase).alias("question"))


_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
QUESTIONS = f"""questions AS (
  SELECT conv_id, turn, text || ' ' || {_LIST}[CAST((conv_id * 7 + turn) % {len(PHRASES)} + 1 AS INTEGER)] AS question
  FROM conversations WHERE role = 'user')"""


def _match(pattern: str) -> str:
    return f"regexp_matches(question, '{pattern}', 'i')"


def _chosen(choices, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_match(p)} THEN '{n}'" for n, p in choices) + f" ELSE '{default}' END"


def _mentioned(names) -> str:
    ordered = sorted(names, key=lambda n: -len(n))
    return "CASE " + " ".join(f"WHEN contains(lower(question), '{n}') THEN '{n}'" for n in ordered) + " END"


@query(
    "ask_route",
    f"""WITH {QUESTIONS}
SELECT conv_id, turn, intent, granularity, aggregate, lowest_first, measure, dimension,
       CASE WHEN intent IN ('anomaly', 'aggregate') THEN 'text' ELSE 'chart' END AS result_type
FROM (SELECT *, {_chosen(ask.INTENTS, "summary")} AS intent, {_chosen(ask.GRANULARITY, "month")} AS granularity,
        {_chosen(ask.AGGREGATES, "total")} AS aggregate, {_match(ask.LOWEST)} AS lowest_first,
        {_mentioned(["revenue", "quantity", "discount"])} AS measure, {_mentioned(["region", "country", "segment"])} AS dimension FROM questions)""",
)
def ask_route(spark, sf_dir):
    """The sales table answers every intent and has no outliers."""
    can = ask.Abilities.of(materialize(sales(spark, sf_dir), "sales"))
    return ask.route_questions(questions(spark, sf_dir), "question", can).drop("question")


def _ranking_sql(order: str) -> str:
    return f"""WITH {SALES}
SELECT CAST(row_number() OVER (ORDER BY value {order}, name) AS INTEGER) AS rank, name, {rnd("value", 2)} AS value FROM (
  SELECT country AS name, fsum(revenue) AS value FROM sales GROUP BY 1 ORDER BY value {order}, name LIMIT 10)"""


@query("ask_ranking", _ranking_sql("DESC"))
def ask_ranking(spark, sf_dir):
    return ask.ask_ranking(sales(spark, sf_dir), "country", "revenue").withColumn("value", py_round(F.col("value"), 2))


@query("ask_ranking_lowest", _ranking_sql("ASC"))
def ask_ranking_lowest(spark, sf_dir):
    rows = ask.ask_ranking(sales(spark, sf_dir), "country", "revenue", lowest=True)
    return rows.withColumn("value", py_round(F.col("value"), 2))


@query(
    "ask_breakdown",
    f"""WITH {SALES}
SELECT name, {rnd("value", 2)} AS value, {rnd("value / sum(value) OVER () * 100", 4)} AS pct FROM (
  SELECT country AS name, fsum(quantity) AS value FROM sales GROUP BY 1 ORDER BY value DESC, name LIMIT 8)""",
)
def ask_breakdown(spark, sf_dir):
    rows = ask.ask_breakdown(sales(spark, sf_dir), "country", "quantity")
    return rows.withColumns({"value": py_round(F.col("value"), 2), "pct": py_round(F.col("pct"), 4)})


@query(
    "ask_aggregate",
    f"WITH {SALES}\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{name}' AS operation, {rnd(f'{f}(revenue)', 2)} AS value, count(revenue) AS records FROM sales"
        for name, f in (("average", "favg"), ("count", "count"), ("maximum", "max"), ("minimum", "min"), ("total", "fsum"))
    ),
)
def ask_aggregate(spark, sf_dir):
    rows = scalar_aggregates(sales(spark, sf_dir), "revenue", ("average", "count", "maximum", "minimum", "total"))
    return rows.withColumn("value", py_round(F.col("value"), 2))


@query("ask_distribution", histogram_sql("value", "events", most=12, least=3))
def ask_distribution(spark, sf_dir):
    return ask.ask_distribution(table(spark, sf_dir, "events"), "value")


@query(
    "ask_distribution_facts",
    f"""SELECT {", ".join(f"{rnd(f, 4)} AS {n}" for n, f in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("low", "min(value)"),
        ("high", "max(value)"), ("median", "quantile_cont(value, 0.5)")))} FROM events""",
)
def ask_distribution_facts(spark, sf_dir):
    facts = ask.distribution_facts(table(spark, sf_dir, "events"), "value")
    return facts.select(*[py_round(F.col(c), 4).alias(c) for c in facts.columns])


SUMMARY = f"""{GROUPS},
size AS (
  SELECT count(*) AS records, ({_NULL_CELLS}) / (count(*) * 7) * 100 AS missing_pct, fsum(revenue) AS total, favg(revenue) AS mean,
         (SELECT max(value) FROM groups) AS best, (SELECT leader FROM ends) AS leader,
         (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM sales GROUP BY {", ".join(SALES_COLUMNS)})) AS copies FROM sales),
lines AS (
  SELECT 0 AS place, '### Key insights' AS text
  UNION ALL SELECT 1, ''
  UNION ALL SELECT 2, '- **' || format('{{:,}}', records) || ' rows** across **7 columns**' FROM size
  UNION ALL SELECT 3, '- Total **revenue**: **' || {number_sql("total")} || '** (avg ' || {number_sql("mean")} || ')' FROM size
  UNION ALL SELECT 4, '- Top **region**: **' || leader || '** (' || {number_sql("best")} || ')' FROM size
  UNION ALL SELECT 5, '- Data completeness: **' || format('{{:.1f}}', 100 - missing_pct) || '%**' ||
    CASE WHEN copies > 0 THEN ', ' || CAST(copies AS VARCHAR) || ' duplicate row(s)' ELSE '' END FROM size
  UNION ALL SELECT 6, ''
  UNION ALL SELECT 7, '### Recommendations'
  UNION ALL SELECT 8, ''
  UNION ALL SELECT 9, '- Address missing data (' || format('{{:.1f}}', missing_pct) || '% of cells) before deeper modeling.' FROM size WHERE missing_pct > 5
  UNION ALL SELECT 10, '- Remove ' || CAST(copies AS VARCHAR) || ' duplicate row(s) to avoid skewed aggregates.' FROM size WHERE copies > 0
  UNION ALL SELECT 11, '- Focus on the leading **region** segments driving **revenue**.'
  UNION ALL SELECT 12, '- Explore correlations between numeric metrics to find growth drivers.')"""


@query(
    "ask_summary",
    f"WITH {SALES}, {SUMMARY}\nSELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS line, text FROM lines",
)
def ask_summary(spark, sf_dir):
    return ask.ask_summary(sales(spark, sf_dir), "region", "revenue", 3)


# One question per intent; the answers are compared as text.
ANSWERS = [
    ("ranking", "Which country has the highest revenue?"),
    ("aggregate", "What is the average discount?"),
    ("breakdown", "revenue split by segment"),
    ("summary", "Give me an overview"),
]
_RANKED = "(SELECT country AS name, fsum(revenue) AS value FROM sales GROUP BY 1 ORDER BY value DESC, name LIMIT 10)"
_SHARES = "(SELECT *, value / sum(value) OVER () * 100 AS pct FROM (SELECT segment AS name, fsum(revenue) AS value FROM sales GROUP BY 1 ORDER BY value DESC, name LIMIT 8))"


@query(
    "ask_answers",
    f"""WITH {SALES}, {SUMMARY},
top AS (SELECT * FROM {_RANKED} ORDER BY value DESC, name LIMIT 1)
SELECT 'ranking' AS intent, 'chart' AS kind,
  '### Revenue by country' || chr(10) || chr(10) || '| country | revenue |' || chr(10) || '| --- | ---: |' || chr(10) ||
  (SELECT string_agg('| ' || name || ' | ' || {number_sql("value")} || ' |', chr(10) ORDER BY value DESC, name) FROM {_RANKED}) ||
  chr(10) || chr(10) || '**' || name || '** has the highest revenue at **' || {number_sql("value")} || '**, ' ||
  format('{{:.1f}}', value / (SELECT fsum(revenue) FROM sales) * 100) || '% of the total.' AS answer FROM top
UNION ALL SELECT 'aggregate', 'text', 'The **average discount** is **' || {number_sql("favg(discount)")} || '** across ' || CAST(count(discount) AS VARCHAR) || ' records.' FROM sales
UNION ALL SELECT 'breakdown', 'chart', '### Revenue share by segment' || chr(10) || chr(10) ||
  (SELECT string_agg('- **' || name || '**: ' || {number_sql("value")} || ' (' || format('{{:.1f}}', pct) || '%)', chr(10) ORDER BY value DESC, name) FROM {_SHARES})
UNION ALL SELECT 'summary', 'chart', (SELECT string_agg(text, chr(10) ORDER BY place) FROM lines)""",
)
def ask_answers(spark, sf_dir):
    assistant, out = ask.Assistant(materialize(sales(spark, sf_dir), "sales")), None
    for intent, question in ANSWERS:
        answer = assistant.ask(question)
        row = answer.text.select(F.lit(answer.intent).alias("intent"), F.lit(answer.kind).alias("kind"), "answer")
        out = row if out is None else out.unionByName(row)
    return out


_BREAK = "chr(10) || chr(10)"
#: Events without their JSON text, and the columns that are measures there.
_EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, value FROM events)"
_MEASURES = ("event_id", "user_id", "value")


def _long_sql(measures=_MEASURES) -> str:
    """Values of all measures, one below the other, as the table ``v``."""
    return "v AS (" + " UNION ALL ".join(f"SELECT {i} AS place, '{m}' AS name, CAST({m} AS DOUBLE) AS x FROM e" for i, m in enumerate(measures)) + ")"


def _distribution_sql(measure: str, source: str) -> str:
    bold = lambda x: f"'**' || coalesce({number_sql(x)}, 'nan') || '**'"
    return (
        f"(SELECT '### Distribution of {measure}' || {_BREAK} || '- Mean: ' || {bold(f'avg({measure})')} || ', Std dev: ' || {bold(f'stddev_samp({measure})')} "
        f"|| chr(10) || '- Range: ' || {bold(f'min({measure})')} || ' to ' || {bold(f'max({measure})')} || chr(10) || '- Median: ' "
        f"|| {bold(f'quantile_cont({measure}, 0.5)')} FROM {source})"
    )


_ANOMALY_SQL = f"""(SELECT '### Anomaly detection' || {_BREAK} || 'Outliers found using the IQR (1.5×) rule:' || {_BREAK} || string_agg(
    '- **' || name || '**: ' || CAST(n AS VARCHAR) || ' outlier(s) outside [' || {number_sql("low")} || ', ' || {number_sql("high")} || ']', chr(10) ORDER BY n DESC, place)
  FROM (SELECT place, name, any_value(low) AS low, any_value(high) AS high, count(*) AS n FROM v JOIN (
    SELECT place, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
      SELECT place, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY place)) f USING (place) WHERE x < low OR x > high GROUP BY ALL))"""
_TREND_SQL = f"""(SELECT '### Value trend' || {_BREAK} || 'Over the period, **value** ' ||
    CASE WHEN change > 1 THEN 'increased' WHEN change < -1 THEN 'decreased' ELSE 'stayed flat' END || ' by **' || format('{{:+.1f}}', change) ||
    '%** (from ' || {number_sql("first")} || ' to ' || {number_sql("last")} || ').' || {_BREAK} ||
    '- Peak: **' || {number_sql("peak.y")} || '** on ' || CAST(peak.d AS VARCHAR) || chr(10) || '- Low: **' || {number_sql("low.y")} || '** on ' || CAST(low.d AS VARCHAR)
  FROM (SELECT *, CASE WHEN first = 0 THEN 0 ELSE (last - first) / abs(first) * 100 END AS change FROM (
    SELECT min_by(y, d) AS first, max_by(y, d) AS last, min_by({{'d': d, 'y': y}}, (-y, d)) AS peak, min_by({{'d': d, 'y': y}}, (y, d)) AS low FROM days)))"""
_DAYS = """days AS (SELECT CAST(r.d AS DATE) AS d, coalesce(sum(value), 0) AS y FROM (
  SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM e) r LEFT JOIN e ON CAST(e.ts AS DATE) = r.d GROUP BY 1)"""
_CORRELATION_SQL = f"""(SELECT '### Correlation analysis' || {_BREAK} || 'Strongest relationships between numeric columns:' || {_BREAK} || string_agg(
    '- **' || a || '** ↔ **' || b || '**: ' || format('{{:+.2f}}', r) || ' (' || CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END
    || CASE WHEN r > 0 THEN ' positive)' ELSE ' negative)' END, chr(10) ORDER BY abs(r) DESC, place) FROM (
  {" UNION ALL ".join(f"SELECT {i} AS place, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM e" for i, (a, b) in enumerate(combinations(_MEASURES, 2)))}))"""
_OVERVIEW_SQL = f"""(SELECT '### Key insights' || {_BREAK} || '- **' || format('{{:,}}', n) || ' rows** across **5 columns**' || chr(10) ||
    '- Total **value**: **' || {number_sql("total")} || '** (avg ' || {number_sql("total / filled")} || ')' || chr(10) ||
    '- Top **event_type**: **' || top.name || '** (' || {number_sql("top.y")} || ')' || chr(10) ||
    '- Data completeness: **' || format('{{:.1f}}', 100 - missing / (n * 5) * 100) || '%**' || {_BREAK} || '### Recommendations' || {_BREAK} ||
    '- Focus on the leading **event_type** segments driving **value**.' || chr(10) || '- Explore correlations between numeric metrics to find growth drivers.'
  FROM (SELECT count(*) AS n, sum(value) AS total, count(value) AS filled,
    5 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) AS missing FROM e),
    (SELECT max_by({{'name': event_type, 'y': y}}, y) AS top FROM (SELECT event_type, sum(value) AS y FROM e GROUP BY 1)))"""
#: Questions beyond the first four, with what answers them. The events span a month, too little for a forecast.
MORE = {
    "Find anomalies": ("anomaly", _ANOMALY_SQL),
    "daily trend of value": ("trend", _TREND_SQL),
    "strongest correlations": ("correlation", _CORRELATION_SQL),
    "distribution of value": ("distribution", _distribution_sql("value", "e")),
    "forecast value": ("summary", _OVERVIEW_SQL),
}


def _answers(assistant, asked):
    out = None
    for question in asked:
        answer = assistant.ask(question)
        row = answer.text.select(F.lit(question).alias("question"), F.lit(answer.intent).alias("intent"), F.lit(answer.kind).alias("kind"), "answer")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "ask_more_answers",
    f"WITH {_EVENTS}, {_long_sql()}, {_DAYS}\n"
    + "\nUNION ALL\n".join(f"SELECT '{q}' AS question, '{i}' AS intent, 'chart' AS kind, {sql} AS answer" for q, (i, sql) in MORE.items()),
)
def ask_more_answers(spark, sf_dir):
    """The remaining intents, on events with a row order."""
    events = prepare(table(spark, sf_dir, "events").drop("props"))
    return _answers(ask.Assistant(events, ["ts", "event_id"]), MORE)


_MONTHLY = """m AS (SELECT CAST(r.d AS DATE) AS d, row_number() OVER (ORDER BY r.d) - 1 AS t, coalesce(y, 0) AS y FROM (
  SELECT unnest(generate_series(date_trunc('month', min(order_date)), date_trunc('month', max(order_date)), INTERVAL 1 MONTH)) AS d FROM sales) r
  LEFT JOIN (SELECT date_trunc('month', order_date) AS d, fsum(revenue) AS y FROM sales GROUP BY 1) s ON s.d = r.d)"""


@query(
    "ask_answer_forecast",
    f"""WITH {SALES}, {_MONTHLY}, line AS (SELECT regr_slope(y, t) AS slope, regr_intercept(y, t) AS start, count(*) AS n, avg(y) AS mean FROM m)
SELECT 'forecast revenue' AS question, 'forecast' AS intent, 'chart' AS kind,
  '### Revenue forecast' || {_BREAK} || 'Projecting a linear trend, **revenue** is expected to reach **' || {number_sql("(slope * (n + 5) + start)")} ||
  '** in 6 periods (' || CASE WHEN slope > 0 THEN 'growing' ELSE 'declining' END || ' ~' || format('{{:+.1f}}', slope / abs(mean) * 100) ||
  '% per period on average).' || {_BREAK} || '_Method: ordinary least-squares trend fit on ' || CAST(n AS VARCHAR) || ' observed periods._' AS answer FROM line""",
)
def ask_answer_forecast(spark, sf_dir):
    return _answers(ask.Assistant(sales(spark, sf_dir).select("order_date", "revenue")), ["forecast revenue"])


@query(
    "ask_answer_gaps",
    f"""WITH e AS (SELECT ts, CASE WHEN event_id = 7 THEN value END AS once, value FROM events)
SELECT 'distribution of once' AS question, 'distribution' AS intent, 'chart' AS kind, {_distribution_sql("once", "e")} AS answer
UNION ALL SELECT 'distribution of value', 'distribution', 'chart', {_distribution_sql("value", "e")}
UNION ALL SELECT 'total never', 'aggregate', 'text', 'The **total value** is **' || {number_sql("fsum(value)")} || '** across ' || CAST(count(value) AS VARCHAR) || ' records.' FROM e""",
)
def ask_answer_gaps(spark, sf_dir):
    """A measure with a single value, and a question that names none."""
    once = F.when(F.col("event_id") == 7, F.col("value"))
    events = table(spark, sf_dir, "events").select("ts", once.alias("once"), "value")
    return _answers(ask.Assistant(events), ["distribution of once", "distribution of value", "total never"])


@query(
    "format_value",
    f"""SELECT l_orderkey, l_linenumber, {number_sql("l_extendedprice")} AS price, {number_sql("l_quantity")} AS quantity,
       {number_sql("-l_extendedprice * l_discount")} AS rebate FROM lineitem""",
)
def format_value(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select(
        "l_orderkey",
        "l_linenumber",
        number_text(F.col("l_extendedprice")).alias("price"),
        number_text(F.col("l_quantity")).alias("quantity"),
        number_text(-F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"),
    )


def _short_sql(x: str, base: float, power: int) -> str:
    """One decimal, rounded half up, without a trailing zero."""
    return f"regexp_replace(format('{{:.1f}}', floor({x} / {base}::DOUBLE ** {power} * 10 + 0.5) / 10), '\\.0$', '')"


def _compact_sql(x: str) -> str:
    fits = lambda p: f"floor(abs({x}) / 1000.0::DOUBLE ** {p} * 10 + 0.5) / 10 < 1000"
    units = " ".join(f"WHEN {fits(p)} THEN {_short_sql(f'abs({x})', 1000.0, p)} || '{u}'" for p, u in enumerate(["", "K", "M", "B"]))
    return f"CASE WHEN {x} IS NULL THEN '—' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE {units} END END"


def _bytes_sql(x: str) -> str:
    units = " ".join(f"WHEN {x} >= 1024.0::DOUBLE ** {p} THEN {_short_sql(x, 1024.0, p)} || ' {u}'" for p, u in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))))
    return f"CASE {units} ELSE '0 B' END"


@query(
    "short_numbers",
    f"""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_totalprice - 30000) * (o_orderkey % 50 + 1) END AS x,
  CAST(o_totalprice * o_totalprice AS BIGINT) // (o_orderkey % 999 + 1) AS size FROM orders)
SELECT o_orderkey, {_compact_sql("x")} AS compact, {_bytes_sql("size")} AS bytes FROM n""",
)
def short_numbers(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    x = F.when(key % 5 != 0, (price - 30000) * (key % 50 + 1))
    size = F.floor(F.rint(price * price) / (key % 999 + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", compact_text(x).alias("compact"), byte_text(size).alias("bytes"))


TITLES = """titles AS (
  SELECT conv_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS title FROM (
    SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id))"""


@query("conversation_titles", f"WITH {TITLES}\nSELECT conv_id, title FROM titles")
def conversation_titles(spark, sf_dir):
    return conversations.conversation_titles(table(spark, sf_dir, "conversations"))


@query(
    "conversation_markdown",
    f"""WITH {TITLES}
SELECT conv_id, CAST(0 AS BIGINT) AS position, '# ' || title || chr(10) || chr(10) || '_Exported conversation_' || chr(10) AS markdown FROM titles
UNION ALL SELECT conv_id, turn + 1, CASE WHEN role = 'user' THEN '## 🧑 You' ELSE '## 🤖 Assistant' END || chr(10) || chr(10) || text || chr(10) FROM conversations""",
)
def conversation_markdown(spark, sf_dir):
    return conversations.conversation_markdown(table(spark, sf_dir, "conversations"))


@query(
    "chunk_words",
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(i AS INTEGER) AS ordinal, array_to_string(words[i * 4 + 1 : i * 4 + 4], ' ') || CASE WHEN i * 4 + 4 < len(words) THEN ' ' ELSE '' END AS chunk
FROM (SELECT *, unnest(range(0, (len(words) + 3) // 4)) AS i FROM w)""",
)
def chunk_words(spark, sf_dir):
    return conversations.chunk_words(table(spark, sf_dir, "documents"), ["doc_id"])


@query(
    "pinned_split",
    """SELECT c.conv_id, c.turns, p.doc_id IS NOT NULL AS is_pinned
FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) c
LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) p ON c.conv_id = p.doc_id""",
)
def pinned_split(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    pinned = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return conversations.pinned_split(chats, pinned, "conv_id")
