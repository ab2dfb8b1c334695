"""Plain-English questions, routed to the computations that answer them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import accurate_avg, accurate_sum, month_end, number_text, side_by_side, week_end
from plumbline.functions.numbers import fixed_text, signed_text
from plumbline.operators.anomalies import anomaly_items, anomaly_points
from plumbline.operators.association import correlation_matrix, direction, ranked_pairs, strength
from plumbline.operators.breakdown import group_extremes, grouped_totals, scalar_aggregate, share_of_shown, top_groups
from plumbline.operators.coercion import prepare
from plumbline.operators.forecast import MIN_POINTS, ForecastError, Line, fit_line, numeric_series
from plumbline.operators.profile import duplicate_rows, histogram, iqr_bounds, missing_pct, table_size
from plumbline.operators.quantiles import quantiles
from plumbline.operators.roles import Roles, pick_date, pick_dimension, pick_measure
from plumbline.operators.timeseries import Frequency, trend, trend_ends

# The intents in order of precedence, with their patterns.
INTENTS = [
    ("forecast", r"forecast|predict|projection|next (quarter|month|year|week)|future|will .* be"),
    ("anomaly", r"anomal|outlier|unusual|abnormal|suspicious|fraud"),
    ("trend", r"trend|over time|monthly|weekly|daily|seasonal|growth|time.?series|by month|by day|by week"),
    ("ranking", r"top|highest|lowest|best|worst|most|least|rank|leading"),
    ("correlation", r"correlat|relationship|related|associat|driver|depend"),
    ("distribution", r"distribution|spread|histogram|frequency|how .* spread"),
    ("breakdown", r"breakdown|share|proportion|split|by (category|region|product|segment|type)|compare|composition"),
    ("aggregate", r"total|sum|average|mean|count|how many|how much|maximum|minimum"),
    ("summary", r"summar|overview|insight|key (finding|metric)|executive|recommend|tell me about|analy"),
]
# Words that turn a ranking round, choose buckets or choose an aggregate, and answer texts here and below.
LOWEST = r"lowest|worst|least|bottom|smallest"
GRANULARITY: list[tuple[Frequency, str]] = [("week", r"week"), ("day", r"daily|per day")]
AGGREGATES = [
    ("average", r"average|mean"),
    ("count", r"count|how many"),
    ("maximum", r"max|highest|peak"),
    ("minimum", r"min|lowest"),
]
EMPTY_ANSWER = "The dataset appears to be empty, so there is nothing to analyze."
NEEDS_ORDER = "A forecast needs a date column or an order of the rows."
HORIZON = 6


def _says(question: str, pattern: str) -> bool:
    return re.search(pattern, question, re.IGNORECASE) is not None


def _first(question: str, choices: Sequence[tuple[str, str]], default: str) -> str:
    return next((name for name, pattern in choices if _says(question, pattern)), default)


def granularity(question: str) -> Frequency:
    return _first(question, GRANULARITY, "month")


def aggregate_kind(question: str) -> str:
    return _first(question, AGGREGATES, "total")


# --- Computations behind the answers -----------------------------------------------------


def ask_ranking(df: DataFrame, dimension: str, measure: str, lowest: bool = False, k: int = 10) -> DataFrame:
    """Rows ``(rank, name, value)``."""
    shown = top_groups(grouped_totals(df, dimension, measure), k, lowest)
    value = F.asc("value") if lowest else F.desc("value")
    place = F.row_number().over(Window.orderBy(value, "name"))  # at most k rows
    return shown.select(place.alias("rank"), "name", "value")


def ask_breakdown(df: DataFrame, dimension: str, measure: str | None, k: int = 8) -> DataFrame:
    """Rows ``(name, value, pct)``, as shares of the groups shown."""
    return share_of_shown(top_groups(grouped_totals(df, dimension, measure), k))


def ask_distribution(df: DataFrame, measure: str) -> DataFrame:
    """Three to twelve bins of the measure."""
    return histogram(df, [measure], most=12, least=3)


def distribution_facts(df: DataFrame, measure: str, exact: bool = True) -> DataFrame:
    """One row ``(mean, std, low, high, median)``."""
    x = F.col(f"`{measure}`").cast("double")
    median = quantiles(df, [measure], [0.5], exact)[measure]
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")).withColumn(
        "median", F.lit(median[0] if median else None).cast("double")
    )


def monthly_series(df: DataFrame, date: str, measure: str) -> DataFrame:
    """Rows ``(t, bucket, y)``: the monthly sums by position (one row per month)."""
    series = trend(df, date, measure, "month", min_buckets=1)
    place = F.row_number().over(Window.orderBy("bucket")) - 1
    return series.select(place.cast("bigint").alias("t"), "bucket", F.col("value").alias("y"))


def ask_forecast(line: Line, spark) -> DataFrame:
    """Rows ``(step, forecast)`` for the six periods after the series."""
    steps = spark.range(1, HORIZON + 1).withColumnRenamed("id", "step")
    return steps.select("step", line.at(F.col("step") + (line.points - 1)).alias("forecast"))


def forecast_growth(line: Line) -> float:
    return line.slope / (abs(line.mean) or 1) * 100


def ask_summary(df: DataFrame, dimension: str | None, measure: str | None, measures: int) -> DataFrame:
    """Rows ``(line, text)``: headline figures, then recommendations."""
    totals: list[Column] = []
    if measure:
        x = F.col(f"`{measure}`").cast("double")
        totals = [accurate_sum(x).alias("total"), accurate_avg(x).alias("mean")]
    parts = [table_size(df, *totals).withColumn("missing_pct", missing_pct()), duplicate_rows(df)]
    if measure and dimension:
        parts.append(group_extremes(grouped_totals(df, dimension, measure)).select("leader", "leader_value"))
    facts = side_by_side(*parts)
    duplicates = F.when(F.col("duplicate_rows") > 0, F.concat(F.lit(", "), F.col("duplicate_rows").cast("string"), F.lit(" duplicate row(s)"))).otherwise("")
    lines: list[Column] = [
        F.concat(F.lit("- **"), F.format_number("total_rows", 0), F.lit(f" rows** across **{len(df.columns)} columns**"))
    ]
    if measure:
        lines.append(F.concat(F.lit(f"- Total **{measure}**: **"), number_text(F.col("total")), F.lit("** (avg "), number_text(F.col("mean")), F.lit(")")))
    if measure and dimension:
        lines.append(F.concat(F.lit(f"- Top **{dimension}**: **"), F.col("leader"), F.lit("** ("), number_text(F.col("leader_value")), F.lit(")")))
    lines.append(F.concat(F.lit("- Data completeness: **"), fixed_text(100 - F.col("missing_pct"), 1), F.lit("%**"), duplicates))
    advice: list[Column] = [
        F.when(
            F.col("missing_pct") > 5,
            F.concat(F.lit("- Address missing data ("), fixed_text(F.col("missing_pct"), 1), F.lit("% of cells) before deeper modeling.")),
        ),
        F.when(
            F.col("duplicate_rows") > 0,
            F.concat(F.lit("- Remove "), F.col("duplicate_rows").cast("string"), F.lit(" duplicate row(s) to avoid skewed aggregates.")),
        ),
    ]
    if measure and dimension:
        advice.append(F.lit(f"- Focus on the leading **{dimension}** segments driving **{measure}**."))
    if measures >= 2:
        advice.append(F.lit("- Explore correlations between numeric metrics to find growth drivers."))
    given = F.filter(F.array(*advice), lambda t: t.isNotNull())
    clean = F.array(F.lit("- The dataset looks clean — proceed to trend and forecast analysis."))
    text = F.concat(
        F.array(F.lit("### Key insights"), F.lit("")),
        F.filter(F.array(*lines), lambda t: t.isNotNull()),
        F.array(F.lit(""), F.lit("### Recommendations"), F.lit("")),
        F.when(F.size(given) > 0, given).otherwise(clean),
    )
    return facts.select(F.posexplode(text).alias("line", "text"))


# --- One question ------------------------------------------------------------------------


@dataclass
class Answer:
    """The answer text (one row ``answer``) and the data of its chart, both lazy."""

    intent: str
    text: DataFrame
    chart: DataFrame | None = None

    @property
    def kind(self) -> str:
        return "text" if self.chart is None else "chart"


class Assistant:
    """Answers questions about one table; column roles are found once."""

    def __init__(self, df: DataFrame, order_by: Sequence[str] | None = None):
        self.df = prepare(df)
        self.order_by = list(order_by) if order_by else None

    @cached_property
    def roles(self) -> Roles:
        return Roles.of(self.df)

    @cached_property
    def is_empty(self) -> bool:
        return not self.df.columns or self.df.isEmpty()

    def ask(self, question: str) -> Answer:
        if self.is_empty:
            return Answer("empty", self._line(F.lit(EMPTY_ANSWER)))
        for intent, pattern in INTENTS:
            if _says(question, pattern):
                try:
                    answer = getattr(self, f"_{intent}")(question)
                except (PySparkException, ForecastError):  # the next intent may still have an answer
                    answer = None
                if answer is not None:
                    return answer
        return self._summary(question)

    @cached_property
    def value_counts(self) -> dict[str, int]:
        """Values of each measure, from one scan."""
        return value_counts(self.df, self.roles.measures)

    def _measure(self, question: str) -> str | None:
        return pick_measure(self.df, question)

    def _dimension(self, question: str) -> str | None:
        return pick_dimension(self.df, question, self.roles)

    def _line(self, text: Column) -> DataFrame:
        return self.df.sparkSession.range(1).select(text.alias("answer"))

    def _ranking(self, question: str) -> Answer | None:
        dimension, measure = self._dimension(question), self._measure(question)
        if not dimension or not measure:
            return None
        lowest = _says(question, LOWEST)
        totals = grouped_totals(self.df, dimension, measure)
        rows = ask_ranking(self.df, dimension, measure, lowest)
        table = rows.agg(_joined(F.concat(F.lit("| "), F.col("name"), F.lit(" | "), number_text(F.col("value")), F.lit(" |"))).alias("table"),
                         F.min_by(F.struct("name", "value"), "rank").alias("first"))
        whole = totals.agg(F.sum("value").alias("whole"))
        share = F.col("first.value") / F.when(F.col("whole") == 0, 1.0).otherwise(F.col("whole")) * 100
        part = F.lit("the smallest") if lowest else F.concat(fixed_text(share, 1), F.lit("% of"))
        text = F.concat(
            F.lit(f"### {measure.title()} by {dimension}\n\n| {dimension} | {measure} |\n| --- | ---: |\n"),
            F.col("table"),
            F.lit("\n\n**"),
            F.col("first.name"),
            F.lit(f"** has the {'lowest' if lowest else 'highest'} {measure} at **"),
            number_text(F.col("first.value")),
            F.lit("**, "),
            part,
            F.lit(" the total."),
        )
        return Answer("ranking", side_by_side(table, whole).select(text.alias("answer")), rows)

    def _trend(self, question: str) -> Answer | None:
        date, measure = pick_date(self.df, question), self._measure(question)
        if not date or not measure:
            return None
        series = trend(self.df, date, measure, granularity(question))
        if series.isEmpty():
            return None
        change = F.when(F.col("first") == 0, 0.0).otherwise((F.col("last") - F.col("first")) / F.abs("first") * 100)
        word = F.when(F.col("change") > 1, "increased").when(F.col("change") < -1, "decreased").otherwise("stayed flat")
        text = F.concat(
            F.lit(f"### {measure.title()} trend\n\nOver the period, **{measure}** "),
            word,
            F.lit(" by **"),
            signed_text(F.col("change"), 1),
            F.lit("%** (from "),
            number_text(F.col("first")),
            F.lit(" to "),
            number_text(F.col("last")),
            F.lit(").\n\n- Peak: **"),
            number_text(F.col("peak.value")),
            F.lit("** on "),
            F.col("peak.bucket").cast("string"),
            F.lit("\n- Low: **"),
            number_text(F.col("low.value")),
            F.lit("** on "),
            F.col("low.bucket").cast("string"),
        )
        return Answer("trend", trend_ends(series).withColumn("change", change).select(text.alias("answer")), series)

    def _forecast(self, question: str) -> Answer | None:
        measure, date = self._measure(question), pick_date(self.df, question)
        if not measure:
            return None
        if date:
            series = monthly_series(self.df, date, measure)
        elif self.order_by:
            series = numeric_series(self.df, measure, self.order_by)
        elif self.value_counts[measure] < MIN_POINTS:
            return None
        else:  # rows of a table have no order of their own
            return Answer("forecast", self._line(F.lit(NEEDS_ORDER)))
        line = fit_line(series, measure)
        rows = ask_forecast(line, self.df.sparkSession)
        text = F.concat(
            F.lit(f"### {measure.title()} forecast\n\nProjecting a linear trend, **{measure}** is expected to reach **"),
            number_text(F.lit(line.slope * (line.points + HORIZON - 1) + line.intercept)),
            F.lit(f"** in {HORIZON} periods ({'growing' if line.slope > 0 else 'declining'} ~"),
            signed_text(F.lit(forecast_growth(line)), 1),
            F.lit(f"% per period on average).\n\n_Method: ordinary least-squares trend fit on {line.points} observed periods._"),
        )
        label = F.col("bucket").cast("string") if date else F.col("t").cast("string")
        history = series.select(F.lit("History").alias("series"), F.col("t"), label.alias("x"), F.col("y").alias("value"))
        ahead = rows.select(
            F.lit("Forecast").alias("series"),
            (F.col("step") + (line.points - 1)).alias("t"),
            F.concat(F.lit("+"), F.col("step").cast("string")).alias("x"),
            F.col("forecast").alias("value"),
        )
        return Answer("forecast", self._line(text), history.unionByName(ahead))

    def _anomaly(self, question: str) -> Answer | None:
        if not self.roles.measures:
            return None
        fences = iqr_bounds(self.df)
        items = anomaly_items(self.df, fences)
        if items.isEmpty():
            calm = (
                "### Anomaly scan\n\nNo statistical outliers were detected across the numeric "
                "columns using the IQR (1.5×) rule. The data looks consistent."
            )
            return Answer("anomaly", self._line(F.lit(calm)))
        names = list(fences)
        low = F.element_at(F.create_map(*[x for c in names for x in (F.lit(c), F.lit(fences[c][0]))]), F.col("column"))
        high = F.element_at(F.create_map(*[x for c in names for x in (F.lit(c), F.lit(fences[c][1]))]), F.col("column"))
        line = F.concat(
            F.lit("- **"), F.col("column"), F.lit("**: "), F.col("count").cast("string"), F.lit(" outlier(s) outside ["),
            number_text(low), F.lit(", "), number_text(high), F.lit("]"),
        )
        head = F.lit("### Anomaly detection\n\nOutliers found using the IQR (1.5×) rule:\n\n")
        text = items.agg(F.concat(head, _joined(line)).alias("answer"))
        points = anomaly_points(self.df, self.order_by, fences) if self.order_by else items
        return Answer("anomaly", text, points)

    def _correlation(self, question: str) -> Answer | None:
        if len(self.roles.measures) < 2:
            return None
        ranked = ranked_pairs(self.df, self.roles.measures)
        if ranked.isEmpty():
            return None
        r = F.col("corr")
        line = F.concat(
            F.lit("- **"), F.col("a"), F.lit("** ↔ **"), F.col("b"), F.lit("**: "), signed_text(r, 2),
            F.lit(" ("), strength(r), F.lit(" "), direction(r), F.lit(")"),
        )
        head = F.lit("### Correlation analysis\n\nStrongest relationships between numeric columns:\n\n")
        return Answer("correlation", ranked.agg(F.concat(head, _joined(line)).alias("answer")), correlation_matrix(self.df, digits=3))

    def _distribution(self, question: str) -> Answer | None:
        measure = self._measure(question)
        if not measure or not self.value_counts[measure]:
            return None
        facts = distribution_facts(self.df, measure)
        # One value has no deviation; the text says so instead of vanishing.
        value = lambda c: F.concat(F.lit("**"), F.coalesce(number_text(F.col(c)), F.lit("nan")), F.lit("**"))
        text = F.concat(
            F.lit(f"### Distribution of {measure}\n\n- Mean: "), value("mean"), F.lit(", Std dev: "), value("std"),
            F.lit("\n- Range: "), value("low"), F.lit(" to "), value("high"), F.lit("\n- Median: "), value("median"),
        )
        return Answer("distribution", facts.select(text.alias("answer")), ask_distribution(self.df, measure))

    def _breakdown(self, question: str) -> Answer | None:
        dimension, measure = self._dimension(question), self._measure(question)
        if not dimension:
            return None
        rows = ask_breakdown(self.df, dimension, measure)
        title = f"{measure.title()} share by {dimension}" if measure else f"Distribution of {dimension}"
        line = F.concat(
            F.lit("- **"), F.col("name"), F.lit("**: "), number_text(F.col("value")), F.lit(" ("), fixed_text(F.col("pct"), 1), F.lit("%)")
        )
        ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "name")))
        return Answer("breakdown", ranked.agg(F.concat(F.lit(f"### {title}\n\n"), _joined(line)).alias("answer")), rows)

    def _aggregate(self, question: str) -> Answer | None:
        measure = self._measure(question)
        if not measure:
            return None
        operation = aggregate_kind(question)
        result = scalar_aggregate(self.df, measure, operation)
        text = F.concat(
            F.lit(f"The **{operation} {measure}** is **"), number_text(F.col("value")), F.lit("** across "),
            F.col("records").cast("string"), F.lit(" records."),
        )
        return Answer("aggregate", result.select(text.alias("answer")))

    def _summary(self, question: str) -> Answer:
        dimension, measure = self._dimension(question), self._measure(question)
        lines = ask_summary(self.df, dimension, measure, len(self.roles.measures))
        text = lines.agg(_joined(F.col("text"), "line").alias("answer"))
        chart = top_groups(grouped_totals(self.df, dimension, measure), 6) if dimension and measure else None
        return Answer("summary", text, chart)


def _joined(line: Column, by: str = "rank") -> Column:
    """The lines of a short ranked list, one below the other."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(by).alias("at"), line.alias("said"))))
    return F.array_join(F.transform(ordered, lambda s: s["said"]), "\n")


def ask(df: DataFrame, question: str, order_by: Sequence[str] | None = None) -> Answer:
    return Assistant(df, order_by).ask(question)


# --- Many questions ----------------------------------------------------------------------


@dataclass(frozen=True)
class Abilities:
    """What a table can answer, which decides between intents that match a question."""

    measures: tuple[str, ...]
    dimensions: tuple[str, ...]
    dates: tuple[str, ...]
    measure: str | None  # of a question that names none
    date: str | None
    values: dict[str, int]  # of each measure
    trends: dict[tuple[str, str], tuple[Frequency, ...]]  # of each measure and date
    forecasts: frozenset[tuple[str, str | None]]
    ordered: bool
    has_outliers: bool
    has_pairs: bool

    @classmethod
    def of(cls, df: DataFrame, order_by: Sequence[str] | None = None) -> Abilities:
        """For an already prepared table. Bucket counts follow from the first and last month.

        One scan looks at every pair of a measure and a date, since a question may name either.
        """
        roles = Roles.of(df)
        values = value_counts(df, roles.measures)
        pairs = [(m, d) for m in roles.measures for d in roles.dates]
        edges = []
        for i, (m, d) in enumerate(pairs):
            day = F.when(F.col(f"`{m}`").isNotNull(), F.col(f"`{d}`")).cast("date")
            edges += [F.min(day).alias(f"first{i}"), F.max(day).alias(f"last{i}")]
        row = df.agg(F.lit(0), *edges).select(
            F.lit(0),
            *[
                c
                for i in range(len(pairs))
                for first, last in [(F.col(f"first{i}"), F.col(f"last{i}"))]
                for c in (
                    (F.months_between(F.trunc(last, "MM"), F.trunc(first, "MM")) + 1).alias(f"months{i}"),
                    (month_end(last) > month_end(first)).alias(f"month{i}"),
                    (week_end(last) > week_end(first)).alias(f"week{i}"),
                    (last > first).alias(f"day{i}"),
                )
            ],
        ).first()
        trends = {p: tuple(f for f in ("month", "week", "day") if row[f"{f}{i}"]) for i, p in enumerate(pairs)}
        forecasts = {p for i, p in enumerate(pairs) if (row[f"months{i}"] or 0) >= MIN_POINTS}
        if not roles.dates:
            forecasts = {(m, None) for m, n in values.items() if n >= MIN_POINTS}
        fences = iqr_bounds(df)
        counted = df.agg(F.lit(0), *[F.count_if((F.col(f"`{c}`") < lo) | (F.col(f"`{c}`") > hi)) for c, (lo, hi) in fences.items()]).first()
        has_pairs = len(roles.measures) > 1 and not ranked_pairs(df, roles.measures).isEmpty()
        return cls(
            roles.measures, roles.dimensions, roles.dates, pick_measure(df), pick_date(df), values, trends,
            frozenset(forecasts), bool(order_by), any(counted), has_pairs,
        )


def value_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Non-null values of each column, from one scan."""
    row = df.agg(F.lit(0), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(columns)}


def _matches(question: Column, pattern: str) -> Column:
    return question.rlike(f"(?iud){pattern}")


def _choose(question: Column, choices: Sequence[tuple[str, str]], default: str) -> Column:
    chosen = None
    for name, pattern in choices:
        hit = _matches(question, pattern)
        chosen = F.when(hit, name) if chosen is None else chosen.when(hit, name)
    return chosen.otherwise(default)


def mentioned_column(question: Column, names: Sequence[str]) -> Column:
    """The longest of the names found in the question, null if none."""
    chosen = F.lit(None).cast("string")
    for name in sorted(reversed(names), key=len):  # the first of equally long names is applied last
        chosen = F.when(F.contains(F.lower(question), F.lit(name.lower())), name).otherwise(chosen)
    return chosen


def route_questions(questions: DataFrame, text: str, can: Abilities) -> DataFrame:
    """Adds intent, granularity, aggregate, mentioned columns and result type per question.

    One projection over the questions: the table's columns are known beforehand, so there
    is nothing to join.
    """
    q = F.col(text)
    frequency = _choose(q, GRANULARITY, "month")
    # What the question names decides, as it does for a single question.
    measure = F.coalesce(mentioned_column(q, can.measures), F.lit(can.measure).cast("string"))
    date = F.coalesce(mentioned_column(q, can.dates), F.lit(can.date).cast("string"))
    none = F.lit(False)
    trends, forecasts = none, none
    for (m, d), found in can.trends.items():
        trends = trends | ((measure == m) & (date == d) & frequency.isin(list(found)) if found else none)
    for m, d in can.forecasts:
        forecasts = forecasts | ((measure == m) & (date == d if d else F.lit(True)))
    able = {
        "forecast": F.coalesce(forecasts, none),
        "anomaly": F.lit(bool(can.measures)),
        "trend": F.coalesce(trends, none),
        "ranking": F.lit(bool(can.measures and can.dimensions)),
        "correlation": F.lit(can.has_pairs),
        "distribution": F.coalesce(measure.isin([m for m, n in can.values.items() if n]), none),
        "breakdown": F.lit(bool(can.dimensions)),
        "aggregate": F.lit(bool(can.measures)),
        "summary": F.lit(True),
    }
    chosen = F.when(F.lit(False), "")
    for name, pattern in INTENTS:
        chosen = chosen.when(_matches(q, pattern) & able[name], name)
    intent = chosen.otherwise("summary")
    charted = [name for name in able if name not in ("anomaly", "aggregate", "summary", "forecast")]
    charted += ["anomaly"] if can.has_outliers else []
    charted += ["summary"] if can.measures and can.dimensions else []
    charted += ["forecast"] if can.dates or can.ordered else []
    return questions.withColumn("intent", intent).withColumns(
        {
            "granularity": frequency,
            "aggregate": _choose(q, AGGREGATES, "total"),
            "lowest_first": _matches(q, LOWEST),
            "measure": mentioned_column(q, can.measures),
            "dimension": mentioned_column(q, can.dimensions),
            "result_type": F.when(F.col("intent").isin(charted), "chart").otherwise("text"),
        }
    )
