"""Versions of a stored table: the original, and at most one cleaned copy of it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.clean import CleaningOptions, clean
from plumbline.operators.profile import quality_report

CLEANED_SUFFIX = ".cleaned"


class NothingToUndo(ValueError):
    """The table is already the original."""


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class StoredTable:
    """A table in parquet under ``path``; the cleaned copy lies beside the original."""

    name: str
    path: str

    @property
    def is_cleaned(self) -> bool:
        return self.path.endswith(CLEANED_SUFFIX)

    @property
    def original(self) -> str:
        return self.path.removesuffix(CLEANED_SUFFIX)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def profile(self, spark: SparkSession) -> DataFrame:
        return quality_report(self.read(spark))

    def apply(self, spark: SparkSession, options: CleaningOptions) -> tuple[StoredTable, list[str]]:
        """Clean the original (never a cleaned copy) and point to the result."""
        result = clean(spark.read.parquet(self.original), options)
        cleaned = replace(self, path=self.original + CLEANED_SUFFIX)
        result.frame.write.mode("overwrite").parquet(cleaned.path)
        return cleaned, result.operations

    def undo(self, spark: SparkSession) -> StoredTable:
        """Point back to the original and drop the cleaned copy."""
        if not self.is_cleaned:
            raise NothingToUndo("This dataset has no cleaning to undo")
        _delete(spark, self.path)
        return replace(self, path=self.original)

    def copy(self, spark: SparkSession, path: str) -> StoredTable:
        """A snapshot of the current version under a new name."""
        self.read(spark).write.parquet(path)
        return StoredTable(f"{self.name} (copy)", path)


def store(df: DataFrame, name: str, path: str) -> StoredTable:
    df.write.parquet(path)
    return StoredTable(name, path)
