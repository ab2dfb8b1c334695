"""Text files by the splits in which Spark reads them, for formats whose records may reach over lines and splits.

Whether a line begins a record depends on all text before it. A lexer has few states, so a split is a small
table: the state at its end for each state at its start. Tables of all splits are put together in file
order on the driver (a few numbers per split of some hundred MB); then every split knows its start
state and is cut into records where it is read. What reaches over the edge of a split comes as
fragments, at most two per split, which are joined in file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of pieces: whole; end of a record of an earlier split; beginning of one that goes on; inside of one; beginning of a header.
WHOLE, END, BEGIN, INSIDE, HEADER = range(5)


def split_lines(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """Rows (path, file, split, value): lines as they stand between line feeds; ``file`` is the path's hash and
    ``split`` the first byte. Rows of a split come together and in order, as long as they are not shuffled."""
    lines = spark.read.option("lineSep", "\n").text(files)
    path = F.col("_metadata.file_path")
    return lines.select(path.alias("path"), F.xxhash64(F.replace(path, F.lit(":///"), F.lit(":/"))).alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def runs(first: list, second: list) -> list[tuple[int, int]]:
    """Start and end of the stretches in which both lists keep their values."""
    cuts = [i for i in range(1, len(first)) if first[i] != first[i - 1] or second[i] != second[i - 1]]
    return list(zip([0, *cuts], [*cuts, len(first)])) if first else []


def joined_fragments(pieces: DataFrame) -> DataFrame:
    """Rows (file, split, kind, text) of records over several splits: the fragments of (file, split, kind, text) put together."""
    begins = F.col("kind").isin(BEGIN, HEADER)
    order = Window.partitionBy("file").orderBy("split", begins.cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    owned = pieces.where(F.col("kind") != WHOLE).withColumns({"begins": begins.cast("int"), "record": F.sum(begins.cast("int")).over(order)})
    parts = F.array_sort(F.collect_list(F.struct("split", "begins", "text")))
    whole = owned.groupBy("file", "record").agg(parts.alias("parts"), F.max("kind").alias("most"))
    return whole.select(
        "file",
        F.col("parts")[0]["split"].alias("split"),
        F.when(F.col("most") == HEADER, HEADER).otherwise(WHOLE).alias("kind"),
        F.array_join(F.col("parts.text"), "\n").alias("text"),
    )
