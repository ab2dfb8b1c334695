"""Parquet copies of parsed tables, and reading by source type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.csv_files import read_csv
from plumbline.sources.sql_dumps import read_sql_table


class UnsupportedSource(ValueError):
    """No reader for this kind of file."""


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": read_csv,
    "sql": read_sql_table,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def read_source(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read files by kind, which defaults to the extension of the path."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise UnsupportedSource(f"No parser registered for source type {kind}")
    return READERS[kind](spark, path)


def write_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_artifact(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet copy, or ``None`` when there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def load_table(
    spark: SparkSession, artifact: str, durable: str | None, parse: Callable[[], DataFrame]
) -> DataFrame:
    """The artifact if present, else the durable copy, else the parsed original.

    Either of the last two is written as the artifact again.
    """
    found = read_artifact(spark, artifact)
    if found is not None:
        return found
    source = read_artifact(spark, durable) if durable else None
    write_artifact(parse() if source is None else source, artifact)
    return spark.read.parquet(artifact)
