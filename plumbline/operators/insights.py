"""Findings about a table as short sentences, computed from a few one-row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import accurate_avg, accurate_sum, number_text, side_by_side
from plumbline.functions.numbers import fixed_text, signed_text
from plumbline.operators.association import strongest_driver
from plumbline.operators.breakdown import group_extremes, grouped_totals
from plumbline.operators.profile import duplicate_rows, missing_pct, table_size
from plumbline.operators.timeseries import trend, trend_ends

# Fixed thresholds.
MISSING_RISK_PCT = 5
CONCENTRATION_PCT = 50
DRIVER_R = 0.3

# Sections and the sentences of each.
SECTIONS = ["key_insights", "opportunities", "risks", "revenue_drivers", "growth_trends", "recommendations"]


def insight_concentration(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """One row: leading and last group, the leader's share of everything, and the two flags."""
    ends = group_extremes(grouped_totals(df, dimension, measure))
    share = F.col("leader_value") / F.col("all_groups") * 100
    return ends.select(
        "leader",
        share.alias("leader_share"),
        F.coalesce(share > CONCENTRATION_PCT, F.lit(False)).alias("is_concentrated"),
        F.when(F.col("groups") > 2, F.col("laggard")).alias("laggard"),
    )


def insight_driver(df: DataFrame, primary: str) -> DataFrame:
    """At most one row ``(driver, r, effect)``, for a correlation above 0.3."""
    found = strongest_driver(df, primary).filter(F.abs("driver_r") > DRIVER_R)
    effect = F.when(F.col("driver_r") > 0, "moves with").otherwise("moves against")
    return found.select("driver", F.col("driver_r").alias("r"), effect.alias("effect"))


def insight_growth(series: DataFrame) -> DataFrame:
    """At most one row ``(change_pct, word, outlook)``; none when the first bucket is 0."""
    ends = trend_ends(series).filter("buckets >= 2 AND first != 0")
    change = (F.col("last") - F.col("first")) / F.abs("first") * 100
    return ends.select(
        change.alias("change_pct"),
        F.when(change > 0, "grown").otherwise("declined").alias("word"),
        F.when(change < 0, "risk").otherwise("opportunity").alias("outlook"),
    )


def insight_quality(df: DataFrame) -> DataFrame:
    """One row ``(missing_pct, is_incomplete, duplicate_rows)``."""
    size = table_size(df).select(missing_pct().alias("missing_pct"))
    return _with_risk(side_by_side(size, duplicate_rows(df))).select("missing_pct", "is_incomplete", "duplicate_rows")


def _with_risk(facts: DataFrame) -> DataFrame:
    return facts.withColumn("is_incomplete", F.col("missing_pct") > MISSING_RISK_PCT)


def insights(df: DataFrame, primary: str | None, dimension: str | None, date: str | None) -> DataFrame:
    """Rows ``(section, ordinal, text)`` in six sections, each with at least one line."""
    totals: list[Column] = []
    if primary:
        x = F.col(f"`{primary}`").cast("double")
        totals = [accurate_sum(x).alias("measure_total"), accurate_avg(x).alias("measure_mean")]
    size = table_size(df, *totals).withColumns({"missing_pct": missing_pct(), "records": F.col("total_rows")})
    parts = [size, duplicate_rows(df)]
    if primary:
        parts.append(insight_driver(df, primary))
    if primary and dimension:
        parts.append(insight_concentration(df, dimension, primary))
    if primary and date:
        parts.append(insight_growth(trend(df, date, primary)))
    facts = _with_risk(side_by_side(*parts))
    blanks = {
        "measure_total": "double", "measure_mean": "double", "driver": "string", "r": "double", "effect": "string",
        "leader": "string", "leader_share": "double", "is_concentrated": "boolean", "laggard": "string",
        "change_pct": "double", "word": "string", "outlook": "string",
    }
    facts = facts.withColumns({c: F.lit(None).cast(t) for c, t in blanks.items() if c not in facts.columns})
    lines = _lines(primary or "", dimension or "", len(df.columns))
    sections = [
        F.struct(F.lit(i).alias("place"), F.lit(name).alias("section"), _or_default(lines[name]).alias("texts"))
        for i, name in enumerate(SECTIONS)
    ]
    return (
        facts.select(F.inline(F.array(*sections)))
        .select("section", F.posexplode("texts").alias("ordinal", "text"))
    )


def _or_default(lines: tuple[list[Column], str]) -> Column:
    candidates, default = lines
    kept = F.filter(F.array(*candidates), lambda t: t.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default))) if default else kept


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(measure: str, dimension: str, width: int) -> dict[str, tuple[list[Column], str]]:
    """Candidate lines per section (null when they do not apply) and the default line."""
    share = fixed_text(F.col("leader_share"), 0)
    change = signed_text(F.col("change_pct"), 0)
    falling = F.col("outlook") == "risk"
    rising = F.col("outlook") == "opportunity"
    incomplete = F.col("is_incomplete")
    return {
        "key_insights": (
            [
                _say(F.format_number("records", 0), f" records across {width} columns."),
                _say(f"Total {measure} is ", number_text(F.col("measure_total")), " (avg ", number_text(F.col("measure_mean")), ")."),
                _say("**", F.col("leader"), f"** leads {dimension} with ", share, f"% of {measure}."),
            ],
            "",
        ),
        "opportunities": (
            [
                _say("**", F.col("laggard"), f"** underperforms in {measure} — targeted growth here could lift the total."),
                F.when(rising, _say(f"Positive momentum in {measure} (+", fixed_text(F.col("change_pct"), 0), "%) — consider scaling what's working.")),
            ],
            "Explore correlations and segments to surface untapped growth areas.",
        ),
        "risks": (
            [
                F.when(
                    F.col("is_concentrated"),
                    _say("Revenue is concentrated: **", F.col("leader"), "** alone drives ", share, f"% of {measure} — a single-point dependency."),
                ),
                F.when(falling, _say(f"{measure} is trending down (", change, "%) — investigate the drivers.")),
                F.when(incomplete, _say(fixed_text(F.col("missing_pct"), 0), "% of cells are missing — clean the data before high-stakes decisions.")),
                F.when(F.col("duplicate_rows") > 0, _say(F.col("duplicate_rows").cast("string"), " duplicate row(s) may inflate aggregates.")),
            ],
            "No major risks detected in the current data.",
        ),
        "revenue_drivers": (
            [_say("**", F.col("driver"), "** ", F.col("effect"), f" {measure} (r=", signed_text(F.col("r"), 2), ") — a key lever.")],
            "Add more numeric metrics to reveal statistical revenue drivers.",
        ),
        "growth_trends": (
            [_say(f"{measure} has ", F.col("word"), " ", change, "% over the observed period.")],
            "Attach a date column to unlock trend and growth analysis.",
        ),
        "recommendations": (
            [
                F.when(incomplete, F.lit("Run smart cleaning to impute or drop missing values.")),
                _say("Double down on ", F.col("driver"), f" to influence {measure}."),
            ],
            "Data looks healthy — proceed to forecasting and scenario analysis.",
        ),
    }
