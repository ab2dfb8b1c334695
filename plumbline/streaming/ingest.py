"""Profiles of files as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions import is_missing
from plumbline.sources.csv_files import null_tokens

CORRUPT = "_corrupt_record"
LISTED = "__listed"
LISTING = "path string, modificationTime timestamp, length bigint, content binary"
PARSE_ERROR = "Some records do not fit the declared columns"


def file_profile(batch: DataFrame, columns: list[T.StructField]) -> DataFrame:
    """Rows ``(path, status, error, row_count, column_count, missing_cells, duplicate_rows)`` per file."""
    names = [f"`{f.name}`" for f in columns]
    missing = sum((F.when(is_missing(F.col(f"`{f.name}`"), f.dataType), 1).otherwise(0) for f in columns), F.lit(0))
    # One row per different row first: a row that fills a file is counted before it is shuffled.
    different = batch.groupBy("path", *names, missing.alias("__missing")).agg(F.count("*").alias("__copies"), F.count(CORRUPT).alias("__broken"))
    broken = F.sum("__broken")
    return different.groupBy("path").agg(
        F.when(broken > 0, "error").otherwise("cleaned").alias("status"),
        F.when(broken > 0, PARSE_ERROR).alias("error"),
        F.sum("__copies").alias("row_count"),
        F.lit(len(columns)).alias("column_count"),
        F.sum(F.col("__missing") * F.col("__copies")).alias("missing_cells"),
        F.sum(F.col("__copies") - 1).alias("duplicate_rows"),
    )


def column_profile(batch: DataFrame, columns: list[T.StructField]) -> DataFrame:
    """Rows ``(path, column, dtype, missing_count)`` per file and column."""
    counts = batch.groupBy("path").agg(
        *[F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f"m{i}") for i, f in enumerate(columns)]
    )
    rows = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"m{i}").alias("missing_count"))
        for i, f in enumerate(columns)
    ]
    return counts.select("path", F.inline(F.array(*rows)))


def ingest_profile(
    spark: SparkSession, landing: str, out: str, checkpoint: str, schema: T.StructType, files_per_batch: int = 1000
) -> StreamingQuery:
    """Profile every file not seen before, then stop.

    The checkpoint remembers the files. Each batch overwrites its own folder, so a batch
    that is run again after a failure leaves the same result. A second source lists the files
    without opening them, so a file without rows is known too; see ``file_profiles``.
    """
    columns = list(schema.fields)
    read_schema = T.StructType([*columns, T.StructField(CORRUPT, T.StringType())])
    arrivals = (
        spark.readStream.schema(read_schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(landing)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    texts = {f.name: null_tokens(F.col(f"`{f.name}`")) for f in columns if isinstance(f.dataType, T.StringType)}
    arrivals = (arrivals.withColumns(texts) if texts else arrivals).withColumn(LISTED, F.lit(False))
    listing = spark.readStream.format("binaryFile").schema(LISTING).option("maxFilesPerTrigger", files_per_batch).load(landing)
    listed = listing.select("path", F.lit(True).alias(LISTED))

    def profile_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # parsed once for all outputs
        rows = batch.filter(~F.col(LISTED))
        for name, frame in (
            ("arrivals", batch.filter(LISTED).select("path")),
            ("files", file_profile(rows, columns)),
            ("columns", column_profile(rows, columns)),
        ):
            frame.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        batch.unpersist()

    return (
        arrivals.unionByName(listed, allowMissingColumns=True)
        .writeStream.foreachBatch(profile_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def file_profiles(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The profile of each file that has arrived; a file without rows has counts of zero."""
    plain = F.regexp_replace("path", "^(\\w+):/{3,}", "$1:/")
    files = spark.read.parquet(f"{out}/files").drop("batch").withColumn("path", plain)
    arrived = spark.read.parquet(f"{out}/arrivals").select(plain.alias("path")).distinct()
    zero = F.lit(0).cast("bigint")
    return arrived.join(files, "path", "full").select(
        "path",
        F.coalesce("status", F.lit("cleaned")).alias("status"),
        "error",
        F.coalesce("row_count", zero).alias("row_count"),
        F.lit(len(schema)).alias("column_count"),
        F.coalesce("missing_cells", zero).alias("missing_cells"),
        F.coalesce("duplicate_rows", zero).alias("duplicate_rows"),
    )


def ingest_once(spark: SparkSession, landing: str, schema: T.StructType, out: str) -> DataFrame:
    """Run the stream over what has arrived and return the file profiles."""
    query = ingest_profile(spark, landing, f"{out}/profiles", f"{out}/checkpoint", schema)
    query.awaitTermination()
    return file_profiles(spark, f"{out}/profiles", schema)
