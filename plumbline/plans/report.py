"""An executive report: sections as rows, and its markdown lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import quality_report
from plumbline.operators.roles import schema_snapshot
from plumbline.plans.analytics import Analytics

# Fixed order and titles of the insight sections in the document.
INSIGHT_TITLES = [
    ("key_insights", "Key insights"),
    ("revenue_drivers", "Revenue drivers"),
    ("growth_trends", "Growth trends"),
    ("opportunities", "Opportunities"),
    ("risks", "Risks"),
    ("recommendations", "Executive recommendations"),
]
SUBTITLE = "_Executive report_"


def report_sections(df: DataFrame, name: str, source_type: str = "csv", status: str = "cleaned") -> DataFrame:
    """Rows ``(section, ordinal, key, value)``: overview, schema and data quality."""
    width = len(df.columns)
    report = quality_report(df)
    facts = [
        ("overview", 0, "dataset_name", F.lit(name)),
        ("overview", 1, "source_type", F.lit(source_type)),
        ("overview", 2, "row_count", F.col("total_rows").cast("string")),
        ("overview", 3, "column_count", F.lit(str(width))),
        ("overview", 4, "status", F.lit(status)),
        ("data_quality", 0, "total_rows", F.col("total_rows").cast("string")),
        ("data_quality", 1, "duplicate_rows", F.col("duplicate_rows").cast("string")),
        ("data_quality", 2, "columns_with_missing_values", F.array_join("missing_columns", ", ")),
        ("data_quality", 3, "columns_with_outliers", F.array_join("outlier_columns", ", ")),
        ("data_quality", 4, "recommendations", F.array_join("suggestions", "; ")),
    ]
    rows = [
        F.struct(F.lit(s).alias("section"), F.lit(i).alias("ordinal"), F.lit(k).alias("key"), v.alias("value"))
        for s, i, k, v in facts
    ]
    schema = schema_snapshot(df).select(
        F.lit("schema").alias("section"), "ordinal", F.col("name").alias("key"), F.col("dtype").alias("value")
    )
    return report.select(F.inline(F.array(*rows))).unionByName(schema)


def report_highlights(analytics: Analytics) -> DataFrame:
    return analytics.highlights()


def plain(text):
    """Without bold marks."""
    return F.regexp_replace(text, r"\*\*(.*?)\*\*", "$1")


def report_lines(analytics: Analytics, title: str, name: str) -> DataFrame:
    """Rows ``(section_no, item_no, text)``; in that order they are the markdown document.

    A section has a heading and ends in a blank line; one without items is left out.
    """
    spark = analytics.df.sparkSession
    size = analytics.df.agg(F.count("*").alias("rows"))
    head = spark.createDataFrame(
        [(0, 0, f"# {title}"), (0, 1, ""), (0, 2, SUBTITLE), (0, 3, ""), (1, 0, "## Overview"), (1, 1, ""), (1, 2, f"- Dataset: {name}"), (1, 4, "")],
        "section_no int, item_no int, text string",
    )
    overview = size.select(
        F.lit(1).alias("section_no"),
        F.lit(3).alias("item_no"),
        F.concat(F.lit("- Rows: "), F.col("rows").cast("string"), F.lit(f" · Columns: {len(analytics.df.columns)}")).alias("text"),
    )
    place = F.array_position(F.array(*[F.lit(key) for key, _ in INSIGHT_TITLES]), F.col("section"))
    items = analytics.insights().select(
        (place + 1).cast("int").alias("section_no"),
        (F.col("ordinal") + 2).alias("item_no"),
        F.concat(F.lit("- "), plain(F.col("text"))).alias("text"),
    )
    titles = F.array(*[F.lit(f"## {label}") for _, label in INSIGHT_TITLES])
    line = lambda at, text: F.struct(F.col("section_no"), at.cast("int").alias("item_no"), text.alias("text"))
    around = F.array(
        line(F.lit(0), F.element_at(titles, F.col("section_no") - 1)), line(F.lit(1), F.lit("")), line(F.col("last") + 1, F.lit(""))
    )
    frames = items.groupBy("section_no").agg(F.max("item_no").alias("last")).select(F.inline(around))
    return head.unionByName(overview).unionByName(frames).unionByName(items)
