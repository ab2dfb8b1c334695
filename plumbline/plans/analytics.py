"""All analytics of one table over a shared preparation.

Column roles and outlier fences are found once and reused. The blocks are lazy and each
reads only its own columns, so the table is not persisted by default: re-reading a few
columns of a columnar file is cheaper than keeping a whole large table. For text sources
and joins, which every block would parse or join again, ``keep=True`` writes the
table to scratch once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import side_by_side
from plumbline.operators import anomalies, association, breakdown, insights, profile, timeseries
from plumbline.operators.coercion import prepare
from plumbline.operators.roles import Roles, pick_date, pick_dimension, pick_measure
from plumbline.session import materialize


class Analytics:
    def __init__(
        self,
        df: DataFrame,
        measure: str | None = None,
        dimension: str | None = None,
        order_by: Sequence[str] | None = None,
        keep: bool = False,
    ):
        self.df = prepare(materialize(df, "analysed") if keep else df)
        self.order_by = list(order_by) if order_by else None
        self._measure, self._dimension = measure, dimension

    @cached_property
    def roles(self) -> Roles:
        return Roles.of(self.df)

    @cached_property
    def measure(self) -> str | None:
        return self._measure if self._measure in self.roles.measures else pick_measure(self.df)

    @cached_property
    def dimension(self) -> str | None:
        if self._dimension in self.roles.dimensions:
            return self._dimension
        return pick_dimension(self.df, roles=self.roles)

    @cached_property
    def date(self) -> str | None:
        return pick_date(self.df)

    @cached_property
    def fences(self) -> dict[str, tuple[float, float]]:
        return profile.iqr_bounds(self.df, self.roles.measures)

    def kpi_summary(self) -> DataFrame:
        return breakdown.kpi_summary(self.df, self.fences)

    def kpi_measures(self) -> DataFrame:
        return breakdown.kpi_measures(self.df, self.measure)

    def trend(self) -> DataFrame | None:
        return timeseries.trend(self.df, self.date, self.measure) if self.date and self.measure else None

    def trend_facts(self) -> DataFrame | None:
        series = self.trend()
        return None if series is None else timeseries.trend_facts(series)

    def category_breakdown(self) -> DataFrame | None:
        return breakdown.breakdown(self.df, self.dimension, self.measure) if self.dimension else None

    def segmentation(self) -> DataFrame | None:
        return breakdown.segmentation(self.df, self.measure) if self.measure else None

    def geo_breakdown(self) -> DataFrame:
        return breakdown.geo_breakdown(self.df, self.measure)

    def correlation_matrix(self) -> DataFrame:
        return association.correlation_matrix(self.df, self.roles.measures)

    def correlation_pairs(self) -> DataFrame:
        return association.correlation_pairs(self.df, self.roles.measures)

    def histogram(self) -> DataFrame:
        return profile.histogram(self.df, self.roles.measures)

    def category_distribution(self) -> DataFrame:
        return profile.category_distribution(self.df)

    def missing_values(self) -> DataFrame:
        return profile.missing_values(self.df)

    def quality_report(self) -> DataFrame:
        return profile.quality_report(self.df, self.fences)

    def anomaly_items(self) -> DataFrame:
        return anomalies.anomaly_items(self.df, self.fences)

    def anomaly_points(self) -> DataFrame:
        if not self.order_by:
            raise ValueError("anomaly points are numbered by row: give order_by")
        return anomalies.anomaly_points(self.df, self.order_by, self.fences)

    def insights(self) -> DataFrame:
        return insights.insights(self.df, self.measure, self.dimension, self.date)

    def highlights(self) -> DataFrame:
        """One row: quality score, primary measure, trend change and primary total."""
        parts = [self.kpi_summary().select("quality_score")]
        facts = self.trend_facts()
        if facts is not None:
            parts.append(facts.select("change_pct"))
        if self.measure:
            order = F.struct(~F.col("is_primary"), F.col("place"))
            ranked = self.kpi_measures().withColumn("place", F.monotonically_increasing_id())
            parts.append(ranked.agg(F.min_by("total", order).alias("primary_total")))
        row = side_by_side(*parts)
        missing = {c: F.lit(None).cast("double") for c in ("change_pct", "primary_total") if c not in row.columns}
        return row.withColumns(missing).select(
            "quality_score",
            F.lit(self.measure).alias("primary_measure"),
            F.col("change_pct").alias("trend_change_pct"),
            "primary_total",
        )
