"""CSV files of any header as they land: each is profiled on its own, and one that cannot be read holds up no other.

A stream lists what has landed; a batch reads its files together, whatever their columns, and finds names, types and
a mergeable profile of each in one pass. What is wrong inside a file (bytes that are not UTF-8, a quote that is never
closed, records longer than the header, no header) is a result like others: a permanent error of that file. What stops the read itself
stops a first, cheap scan of the batch, which is then halved until the file that did it stands alone, so that n files cost about
2·log2(n) scans of parts more per unreadable one. Such an error is permanent if another read cannot help (the file is gone), else
transient: the file waits for ``retry_landed`` and fails for good after ``attempts`` reads.

Three tables grow by a folder per batch under ``out``: ``log`` has a row per file and attempt (``file_outcomes`` takes the last,
``dead_letters`` those that failed for good), ``states`` the profile states. A batch that runs again after a failure of the
driver overwrites its folders, and counts the attempts of other batches only. A file that changes is a new file.

Defined cases: a file without bytes has not landed yet, one of blank lines only is a permanent error, a file with a header only has no rows and is cleaned; blank lines are no records;
records shorter than the header end in missing cells; empty names are numbered, repeated ones get a suffix; repeated rows are those whose
cells have equal texts. The driver holds a row and a header per file of a batch, at most ``files_per_batch``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions import accurate_sum, parse_number
from plumbline.functions.numbers import NUMBER_PATTERN
from plumbline.operators.profile_state import HLL_BITS, KLL_SIZE, ROWS, merged_profile, merged_quality
from plumbline.operators.profile import score_expression
from plumbline.session import materialize
from plumbline.sources.csv_files import (
    FALSE_TOKENS, INTEGER_PATTERN, TRUE_TOKENS, WIDE, has_open_record, header_names, null_tokens,
    number_of_fields, parsed_fields, plain_path, split_records, without_return,
)
from plumbline.sources.splits import split_lines
from plumbline.streaming.ingest import LISTING

CLEANED, RETRY, ERROR = "cleaned", "retry", "error"
PERMANENT, TRANSIENT = "permanent", "transient"
EMPTY, NOT_UTF8 = "No columns to parse from file", "The file is not UTF-8"
OPEN_QUOTE, LONG_RECORD = "A quoted field is not closed", "Some records have more fields than the header"

LOG = (
    "path string, modified timestamp, attempt int, status string, kind string, error string, "
    "row_count bigint, column_count int, missing_cells bigint, duplicate_rows bigint"
)
STATES = (
    "path string, modified timestamp, ordinal int, column string, dtype string, rows bigint, missing bigint, numbers bigint, "
    "total double, squares double, least double, most double, quantiles binary, distinct binary"
)


@dataclass
class _File:
    """A file of a batch: what the log will say of it."""

    path: str
    modified: object
    attempt: int
    error: str | None = None
    kind: str | None = None
    key: int | None = None
    broken: bool = False
    names: list[str] = field(default_factory=list)
    counts: tuple = (None, None, None)

    def fail(self, error: str, kind: str) -> None:
        self.error, self.kind = error, kind

    def row(self, attempts: int) -> tuple:
        if self.error is None:
            return self.path, self.modified, self.attempt, CLEANED, None, None, self.counts[0], len(self.names), *self.counts[1:]
        again = self.kind == TRANSIENT and self.attempt < attempts
        return self.path, self.modified, self.attempt, RETRY if again else ERROR, self.kind, self.error, None, None, None, None


def _reason(error: Exception) -> str:
    """The first line of what went wrong at the bottom."""
    if not isinstance(error, Py4JJavaError):
        return str(error).strip().split("\n")[0]
    cause = error.java_exception
    while cause.getCause() is not None:
        cause = cause.getCause()
    return cause.toString().split("\n")[0]


def error_kind(error: Exception) -> str:
    """Permanent if another read cannot help: there is no such file, or the plan itself is wrong."""
    gone = any(sign in str(error) for sign in ("FILE_NOT_EXIST", "FileNotFoundException"))
    return PERMANENT if gone or isinstance(error, AnalysisException) else TRANSIENT


def _fault_free(spark: SparkSession, files: list[_File]) -> list[_File]:
    """Names of the columns of each file; those without a header or with broken bytes fail here. One scan."""
    lines = split_lines(spark, [f.path for f in files]).withColumn("row", F.monotonically_increasing_id())
    filled = (F.col("split") == 0) & (F.trim("value") != "")
    found = lines.groupBy("path", "file").agg(
        F.min_by("value", F.when(filled, F.col("row"))).alias("header"),
        F.max(has_open_record("value")).alias("broken"),
        F.count_if(~F.is_valid_utf8("value")).alias("invalid"),
    )
    facts = {plain_path(row["path"]): row for row in found.collect()}
    sound = []
    for f in files:
        fact = facts.get(f.path)
        if fact is None or not (fact["header"] or "").strip("\r\ufeff "):
            f.fail(EMPTY, PERMANENT)
        elif fact["invalid"]:
            f.fail(NOT_UTF8, PERMANENT)
        else:
            f.names, f.key, f.broken = header_names(spark, f.path, fact["header"]), fact["file"], fact["broken"]
            sound.append(f)
    return sound


def _plain_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows (file, text) of files whose records are lines; stays in generated code."""
    lines = split_lines(spark, files).select("file", "split", "value", F.monotonically_increasing_id().alias("row"))
    lines = lines.where(F.trim("value") != "").where(F.trim("value") != "\r")
    # One row per file, and so small enough to be sent to every task.
    headers = lines.where(F.col("split") == 0).groupBy("file").agg(F.min("row").alias("header"))
    return lines.join(F.broadcast(headers), "file").where(F.col("row") != F.col("header")).select("file", without_return("value").alias("text"))


def _cell_state(cell: Column) -> Column:
    number = parse_number(cell)
    trimmed = F.trim(cell)
    return F.struct(
        F.count("*").alias("rows"),
        F.count(cell).alias("present"),
        F.count_if(cell.rlike(INTEGER_PATTERN)).alias("whole"),
        F.count(trimmed.try_cast("bigint")).alias("long"),
        F.count(trimmed.try_cast(WIDE)).alias("wide"),
        F.count_if(cell.rlike(NUMBER_PATTERN)).alias("number"),
        F.count_if(cell.isin(TRUE_TOKENS + FALSE_TOKENS)).alias("flags"),
        F.count(number).alias("numbers"),
        accurate_sum(number).alias("total"),
        accurate_sum(number * number).alias("squares"),
        F.min(number).alias("least"),
        F.max(number).alias("most"),
        F.kll_sketch_agg_double(number, KLL_SIZE).alias("quantiles"),
        F.hll_sketch_agg(F.xxhash64(cell), HLL_BITS).alias("distinct"),
    )


def _dtype() -> Column:
    """The narrowest type that every value of the column fits, as the reader infers it."""
    known = F.col("present") > 0
    fits = lambda name: known & (F.col(name) == F.col("present"))
    digits = fits("whole") & fits("wide")
    return (
        F.when(digits & fits("long"), "bigint").when(digits, WIDE).when(fits("number"), "double").when(fits("flags"), "boolean").otherwise("string")
    )


def _profiled(spark: SparkSession, sound: list[_File]) -> list[DataFrame]:
    """States of the files; those with open quotes or long records fail. Errors of reading are raised."""
    lines = [f.path for f in sound if not f.broken]
    broken = [f.path for f in sound if f.broken]
    parts, unclosed = [], set()
    if lines:
        parts.append(_plain_records(spark, lines))
    if broken:
        records, unclosed = split_records(spark, broken)
        parts.append(records)
    texts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    width = max(len(f.names) for f in sound)
    cells = [F.col(f"c{i}") for i in range(width)]
    parsed = texts.select("file", number_of_fields("text").alias("fields"), parsed_fields("text", width, "PERMISSIVE").alias("cells"))
    parsed = parsed.select("file", "fields", *[null_tokens(F.col(f"cells.c{i}")).alias(f"c{i}") for i in range(width)])
    shown = [F.coalesce(c, F.lit("\0")) for c in cells]
    whole = F.struct(F.count("*").alias("rows"), F.max("fields").alias("fields"), F.hll_sketch_agg(F.xxhash64(*shown), HLL_BITS).alias("distinct"))
    wide = materialize(parsed.groupBy("file").agg(whole.alias("whole"), *[_cell_state(c).alias(f"s{i}") for i, c in enumerate(cells)]), "landed")
    # Two hashes stand for a row, so that rows are counted exactly without being shuffled.
    copies = parsed.groupBy("file", F.xxhash64(*shown).alias("a"), F.xxhash64(F.lit(1), *shown).alias("b")).agg(F.count("*").alias("n"))
    repeats = copies.groupBy("file").agg(F.sum(F.col("n") - 1).alias("repeats"))
    missing = sum((F.col(f"s{i}.rows") - F.col(f"s{i}.present") for i in range(width)), F.lit(0))
    facts = wide.join(repeats, "file").select("file", "whole.rows", "whole.fields", missing.alias("missing"), "repeats")
    counted = {row["file"]: row for row in facts.collect()}

    heads = []
    for f in sound:
        fact = counted.get(f.key)
        if f.key in unclosed:
            f.fail(OPEN_QUOTE, PERMANENT)
        elif fact and fact["fields"] > len(f.names):
            f.fail(LONG_RECORD, PERMANENT)
        elif fact:
            # Cells beyond a file's own columns are missing in every row.
            f.counts = (fact["rows"], fact["missing"] - (width - len(f.names)) * fact["rows"], fact["repeats"])
            heads += [(f.path, f.modified, f.key, i, name) for i, name in enumerate([ROWS, *f.names], start=-1)]
        else:
            f.counts = (0, 0, 0)
    return [materialize(_states(wide, heads, width), "landed-states")] if heads else []


def _states(wide: DataFrame, heads: list[tuple], width: int) -> DataFrame:
    """A row per file and column in the shape of ``profile_states``; numbers count where all values of the column are."""
    none = F.lit(None).cast("double")
    rows = F.struct(
        F.lit(-1).alias("ordinal"), F.lit("row").alias("dtype"), F.col("whole.rows").alias("rows"), F.lit(0).cast("bigint").alias("missing"),
        F.lit(0).cast("bigint").alias("numbers"), *[none.alias(c) for c in ("total", "squares", "least", "most")],
        F.lit(None).cast("binary").alias("quantiles"), F.col("whole.distinct").alias("distinct"),
    )
    cells = wide.select("file", F.posexplode(F.array(*[F.col(f"s{i}") for i in range(width)])).alias("ordinal", "cell")).select("file", "ordinal", "cell.*")
    typed = cells.withColumn("dtype", _dtype())
    numeric = F.col("dtype").isin("bigint", WIDE, "double")
    cells = typed.select(
        "file", "ordinal", "dtype", "rows", (F.col("rows") - F.col("present")).alias("missing"), F.when(numeric, F.col("numbers")).otherwise(0).alias("numbers"),
        *[F.when(numeric, F.col(c)).alias(c) for c in ("total", "squares", "least", "most", "quantiles")], "distinct",
    )
    found = wide.select("file", F.inline(F.array(rows))).select("file", "ordinal", *[c for c in cells.columns if c not in ("file", "ordinal")]).unionByName(cells)
    named = wide.sparkSession.createDataFrame(heads, "path string, modified timestamp, file bigint, ordinal int, column string")
    return found.join(named, ["file", "ordinal"]).select(*[c.split()[0] for c in STATES.split(", ")])


def _isolated[T](read: Callable[[SparkSession, list[_File]], list[T]], spark: SparkSession, files: list[_File]) -> list[T]:
    """What ``read`` returns for the files that can be read; halves a group until what stops the read stands alone."""
    if not files:
        return []
    try:
        return read(spark, files)
    except (PySparkException, Py4JJavaError) as error:
        if len(files) == 1:
            files[0].fail(_reason(error), error_kind(error))
            return []
    half = len(files) // 2
    for f in files:  # what a stopped read has found of a file is found again
        f.error, f.kind = None, None
    return _isolated(read, spark, files[:half]) + _isolated(read, spark, files[half:])


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batches; empty before the first one."""
    try:
        return spark.read.schema(f"{schema}, batch string").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch string")


def _land(spark: SparkSession, listed: Sequence[tuple], out: str, batch: str, attempts: int) -> None:
    """Read the files of a batch (path, modified) and write what became of them."""
    if not listed:
        return
    wanted = spark.createDataFrame([tuple(x) for x in listed], "path string, modified timestamp")
    log = _stored(spark, f"{out}/log", LOG).where(F.col("batch") != batch)
    before = log.join(wanted, ["path", "modified"], "left_semi").groupBy("path", "modified").agg(F.max("attempt").alias("attempt")).collect()
    made = {(row["path"], row["modified"]): row["attempt"] for row in before}
    files = [_File(path, modified, made.get((path, modified), 0) + 1) for path, modified in sorted(map(tuple, listed))]
    # The cheap scan meets what cannot be read; the profile is then as a rule made of all files at once.
    parts = _isolated(_profiled, spark, _isolated(_fault_free, spark, files))
    states = spark.createDataFrame([], STATES)
    for part in parts:
        states = states.unionByName(part)
    states.write.mode("overwrite").parquet(f"{out}/states/batch={batch}")
    # The log comes last: only states of files that it calls cleaned count.
    spark.createDataFrame([f.row(attempts) for f in files], LOG).coalesce(1).write.mode("overwrite").parquet(f"{out}/log/batch={batch}")


def land_files(spark: SparkSession, landing: str, out: str, checkpoint: str, files_per_batch: int = 1000, attempts: int = 3) -> StreamingQuery:
    """Read and profile every file that has landed since the last run, then stop. The checkpoint remembers the files."""
    listing = spark.readStream.format("binaryFile").schema(LISTING).option("maxFilesPerTrigger", files_per_batch).load(landing)

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("path", "modificationTime").collect()
        _land(spark, [(plain_path(r[0]), r[1]) for r in rows], out, f"landed-{batch_id}", attempts)

    return (
        listing.select("path", "modificationTime")
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def retry_landed(spark: SparkSession, out: str, files_per_batch: int = 1000, attempts: int = 3) -> int:
    """Read the files that wait for another attempt once more; returns their number."""
    waiting = file_outcomes(spark, out).where(F.col("status") == RETRY).select("path", "modified").orderBy("path", "modified").collect()
    for at in range(0, len(waiting), files_per_batch):
        _land(spark, waiting[at : at + files_per_batch], out, f"retried-{uuid.uuid4().hex}", attempts)
    return len(waiting)


def file_outcomes(spark: SparkSession, out: str) -> DataFrame:
    """What became of each file at last: a row per path, of its latest change and attempt."""
    log = _stored(spark, f"{out}/log", LOG).drop("batch")
    last = F.max_by(F.struct(*log.columns), F.struct("modified", "attempt"))
    return log.groupBy("path").agg(last.alias("last")).select("last.*")


def dead_letters(spark: SparkSession, out: str) -> DataFrame:
    """Files that failed for good: (path, modified, attempt, kind, error)."""
    return file_outcomes(spark, out).where(F.col("status") == ERROR).select("path", "modified", "attempt", "kind", "error")


def landed_states(spark: SparkSession, out: str) -> DataFrame:
    """Profile states of the files that are cleaned, by (path, ordinal)."""
    current = file_outcomes(spark, out).where(F.col("status") == CLEANED).select("path", "modified")
    return _stored(spark, f"{out}/states", STATES).drop("batch").join(current, ["path", "modified"], "left_semi")


def landed_quality(spark: SparkSession, out: str) -> DataFrame:
    """Counts and quality score of each file with rows; missing and repeated rows are exact, outliers as ``profile_state`` says."""
    scored = merged_quality(merged_profile(landed_states(spark, out), ["path"]), ["path"]).select("path", "total_cells", "outlier_cells")
    exact = file_outcomes(spark, out).select("path", F.col("row_count").alias("total_rows"), "missing_cells", "duplicate_rows")
    return scored.join(exact, "path").withColumn("quality_score", score_expression())


def landed_profile(spark: SparkSession, out: str) -> DataFrame:
    """The profile of each column over all files, from their states alone.

    A column has the widest of its types; where files differ beyond numbers it is text, and its numbers do not count.
    """
    states = landed_states(spark, out)
    numeric, kinds = F.col("dtype").isin("bigint", WIDE, "double"), F.collect_set(F.when(F.col("rows") > F.col("missing"), F.col("dtype")))
    types = states.withColumn("numeric", numeric).groupBy("column").agg(kinds.alias("kinds"))
    numbers = F.forall("kinds", lambda k: k.isin("bigint", WIDE, "double"))
    widest = (
        F.when(F.size("kinds") == 0, "string").when(F.size("kinds") == 1, F.col("kinds")[0])
        .when(numbers & F.array_contains("kinds", "double"), "double").when(numbers, WIDE).otherwise("string")
    )
    typed = states.drop("dtype").join(types.select("column", widest.alias("dtype")), "column")
    kept = F.when(numeric, F.col("numbers")).otherwise(0)
    return merged_profile(typed.withColumn("numbers", kept))
