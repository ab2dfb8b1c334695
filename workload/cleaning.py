from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clean
from plumbline.operators.profile import duplicate_rows, table_size
from plumbline.functions import py_round, side_by_side
from plumbline.plans.history import VersionConflict, VersionedTable
from plumbline.plans.versions import store
from plumbline.session import materialize, scratch_path
from workload.inputs import EVENTS_DIRTY, events_dirty, table
from workload.registry import query, rnd

TRIMMED = "trimmed AS (SELECT trim(event_type, ' ') AS event_type, value, user_text, day_text FROM events_dirty)"
ISO_DAY = """CASE WHEN day_text LIKE '%/%' THEN strftime(strptime(day_text, '%m/%d/%Y'), '%Y-%m-%d') ELSE day_text END"""
CONVERTED = "converted AS (SELECT event_type, value, TRY_CAST(user_text AS DOUBLE) AS user_text, day_text FROM trimmed)"
DATED = f"dated AS (SELECT event_type, value, user_text, {ISO_DAY} AS day_text FROM converted)"
PACKED = """packed AS (SELECT * FROM dated WHERE event_type IS NOT NULL OR value IS NOT NULL OR user_text IS NOT NULL OR day_text IS NOT NULL)"""
UNIQUE_ROWS = "unique_rows AS (SELECT DISTINCT * FROM packed)"
MODE = "(SELECT event_type FROM {0} WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)"
FILLED = f"""filled AS (
  SELECT coalesce(event_type, {MODE.format("unique_rows")}) AS event_type,
         coalesce(value, (SELECT quantile_cont(value, 0.5) FROM unique_rows)) AS value,
         coalesce(user_text, (SELECT quantile_cont(user_text, 0.5) FROM unique_rows)) AS user_text, day_text FROM unique_rows)"""
ALL_STEPS = f"{EVENTS_DIRTY}, {TRIMMED}, {CONVERTED}, {DATED}, {PACKED}, {UNIQUE_ROWS}, {FILLED}"


@query("clean_trim", f"WITH {EVENTS_DIRTY}, {TRIMMED}\nSELECT * FROM trimmed")
def clean_trim(spark, sf_dir):
    return clean.trim_whitespace(events_dirty(spark, sf_dir))


@query(
    "clean_convert",
    f"WITH {EVENTS_DIRTY}\nSELECT event_type, value, TRY_CAST(user_text AS DOUBLE) AS user_text, day_text FROM events_dirty",
)
def clean_convert(spark, sf_dir):
    return clean.convert_types(events_dirty(spark, sf_dir))


@query("clean_dates", f"WITH {EVENTS_DIRTY}\nSELECT event_type, value, user_text, {ISO_DAY} AS day_text FROM events_dirty")
def clean_dates(spark, sf_dir):
    return clean.normalize_dates(events_dirty(spark, sf_dir))


@query("clean_drop_empty", f"WITH {EVENTS_DIRTY}\nSELECT * FROM events_dirty WHERE coalesce(event_type, CAST(value AS VARCHAR), user_text, day_text) IS NOT NULL")
def clean_drop_empty(spark, sf_dir):
    return clean.drop_empty_rows(events_dirty(spark, sf_dir))


@query("clean_dedup", f"WITH {EVENTS_DIRTY}\nSELECT DISTINCT * FROM events_dirty")
def clean_dedup(spark, sf_dir):
    return clean.remove_duplicates(events_dirty(spark, sf_dir))


def _fill_sql(value: str) -> str:
    return f"""WITH {EVENTS_DIRTY}
SELECT event_type, {rnd(f"coalesce(value, {value})", 6)} AS value FROM events_dirty"""


def _fill(spark, sf_dir, strategy):
    df = events_dirty(spark, sf_dir)
    filled = clean.fill_missing(df, strategy, clean.fill_values(df.select("value"), strategy))
    return filled.select("event_type", py_round(F.col("value"), 6).alias("value"))


@query("clean_fill_median", _fill_sql("(SELECT quantile_cont(value, 0.5) FROM events_dirty)"))
def clean_fill_median(spark, sf_dir):
    return _fill(spark, sf_dir, "auto")


@query("clean_fill_mean", _fill_sql("(SELECT avg(value) FROM events_dirty)"))
def clean_fill_mean(spark, sf_dir):
    return _fill(spark, sf_dir, "mean")


@query("clean_fill_zero", _fill_sql("0"))
def clean_fill_zero(spark, sf_dir):
    return _fill(spark, sf_dir, "zero")


_DIRTY_MODE = "(SELECT {0} FROM events_dirty WHERE {0} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {0} LIMIT 1)"


@query(
    "clean_fill_mode",
    f"WITH {EVENTS_DIRTY}\nSELECT "
    + ", ".join(f"coalesce({c}, {_DIRTY_MODE.format(c)}) AS {c}" for c in ("event_type", "user_text", "day_text"))
    + " FROM events_dirty",
)
def clean_fill_mode(spark, sf_dir):
    return clean.fill_missing(events_dirty(spark, sf_dir).select("event_type", "user_text", "day_text"))


def _facts_sql(source: str) -> str:
    cells = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ("event_type", "value", "user_text", "day_text"))
    return f"""SELECT count(*) AS row_count, {cells} AS missing,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {source} GROUP BY event_type, value, user_text, day_text)) AS copies FROM {source}"""


OPERATIONS = """(SELECT string_agg(text, '; ' ORDER BY place) FROM (
  SELECT 0 AS place, 'Trimmed whitespace' AS text
  UNION ALL SELECT 1, 'Converted to numeric: user_text'
  UNION ALL SELECT 2, 'Normalized dates: day_text'
  UNION ALL SELECT 3, 'Removed ' || CAST((SELECT count(*) FROM dated) - (SELECT count(*) FROM packed) AS VARCHAR) || ' empty row(s)'
  UNION ALL SELECT 4, 'Removed ' || CAST((SELECT count(*) FROM packed) - (SELECT count(*) FROM unique_rows) AS VARCHAR) || ' duplicate row(s)'
  UNION ALL SELECT 5, 'Filled missing values in: event_type, value, user_text'))"""


@query(
    "clean_summary",
    f"""WITH {ALL_STEPS}, b AS ({_facts_sql("events_dirty")}), a AS ({_facts_sql("filled")})
SELECT b.row_count AS rows_before, a.row_count AS rows_after, b.row_count - a.row_count AS rows_removed,
       b.missing AS missing_before, a.missing AS missing_after, b.copies AS duplicates_before, a.copies AS duplicates_after,
       {OPERATIONS} AS operations_applied FROM b CROSS JOIN a""",
)
def clean_summary(spark, sf_dir):
    df = events_dirty(spark, sf_dir)
    summary = clean.cleaning_summary(df, clean.clean(df, clean.CleaningOptions.everything()))
    return summary.withColumn("operations_applied", F.array_join("operations_applied", "; "))


@query("clean_all", f"WITH {ALL_STEPS}\nSELECT event_type, {rnd('value', 6)} AS value, user_text, day_text FROM filled")
def clean_all(spark, sf_dir):
    cleaned = clean.clean(events_dirty(spark, sf_dir), clean.CleaningOptions.everything()).frame
    return cleaned.withColumn("value", py_round(F.col("value"), 6))


@query(
    "clean_preview",
    f"""WITH {EVENTS_DIRTY}, {TRIMMED}
SELECT DISTINCT event_type, value, user_text, {ISO_DAY} AS day_text FROM trimmed
WHERE event_type IS NOT NULL OR value IS NOT NULL OR user_text IS NOT NULL OR day_text IS NOT NULL
ORDER BY day_text NULLS FIRST, event_type NULLS FIRST, value NULLS FIRST, user_text NULLS FIRST LIMIT 100""",
)
def clean_preview(spark, sf_dir):
    options = clean.CleaningOptions(trim_whitespace=True, normalize_dates=True, drop_empty_rows=True, remove_duplicates=True)
    return clean.cleaning_preview(events_dirty(spark, sf_dir), options, ["day_text", "event_type", "value", "user_text"])


@query(
    "clean_apply_undo",
    f"""WITH {ALL_STEPS}, b AS ({_facts_sql("events_dirty")}), a AS ({_facts_sql("filled")})
SELECT 'original' AS version, row_count, missing, copies FROM b
UNION ALL SELECT 'cleaned', row_count, missing, copies FROM a
UNION ALL SELECT 'copy of cleaned', row_count, missing, copies FROM a
UNION ALL SELECT 'undone', row_count, missing, copies FROM b""",
)
def clean_apply_undo(spark, sf_dir):
    root = scratch_path(spark, "versions")
    original = store(events_dirty(spark, sf_dir), "events", f"{root}/events")
    cleaned, _ = original.apply(spark, clean.CleaningOptions.everything())
    # The cleaned version is gone after the undo, so its facts are taken before.
    facts = materialize(_version_facts(spark, "cleaned", cleaned), "facts")
    snapshot = cleaned.copy(spark, f"{root}/copy")
    undone = cleaned.undo(spark)
    for name, version in {"original": original, "copy of cleaned": snapshot, "undone": undone}.items():
        facts = facts.unionByName(_version_facts(spark, name, version))
    return facts


def _version_facts(spark, name, version):
    df = version.read(spark)
    return side_by_side(table_size(df), duplicate_rows(df)).select(
        F.lit(name).alias("version"),
        F.col("total_rows").alias("row_count"),
        F.col("missing_cells").alias("missing"),
        F.col("duplicate_rows").alias("copies"),
    )


SHAPES = ["M/d/yy", "MMM d yyyy", "yyyy.MM.dd", "M/d/yyyy h:mm a", "d-MMM-yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy/M/d H:mm", "EEE, d MMM yyyy"]


@query("clean_dates_mixed", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day_text FROM events")
def clean_dates_mixed(spark, sf_dir):
    """Dates written in nine ways become one."""
    written = F.array(*[F.date_format("ts", shape) for shape in SHAPES])[(F.col("event_id") % len(SHAPES)).cast("int")]
    return clean.normalize_dates(table(spark, sf_dir, "events").select("event_id", written.alias("day_text")))


@query(
    "version_history",
    f"""WITH {ALL_STEPS}, b AS ({_facts_sql("events_dirty")}), a AS ({_facts_sql("filled")})
SELECT 'events' AS name, 1 AS version, 'stored' AS kind, row_count, missing, copies FROM b
UNION ALL SELECT 'events', 2, 'cleaned', row_count, missing, copies FROM a
UNION ALL SELECT 'events', 3, 'undone', row_count, missing, copies FROM b
UNION ALL SELECT 'events (copy)', 1, 'copied', row_count, missing, copies FROM a
UNION ALL SELECT 'late writer', 0, 'refused', row_count, missing, copies FROM b""",
)
def version_history(spark, sf_dir):
    """Stored, cleaned, undone and copied versions with the profiles of their commits; a writer that is late changes nothing."""
    root = scratch_path(spark, "history")
    events = VersionedTable.create(events_dirty(spark, sf_dir), "events", f"{root}/events")
    pinned = events.read()
    events.apply(clean.CleaningOptions.everything())
    snapshot = events.copy(f"{root}/copy")
    events.undo()
    try:
        events.apply(clean.CleaningOptions(trim_whitespace=True), seen=1)
    except VersionConflict:
        refused = side_by_side(table_size(pinned), duplicate_rows(pinned)).select(
            F.lit("late writer").alias("name"), F.lit(0).alias("version"), F.lit("refused").alias("kind"), "total_rows", "missing_cells", "duplicate_rows"
        )
    columns = ["name", "version", "kind", "total_rows", "missing_cells", "duplicate_rows"]
    found = events.history().select(*columns).unionByName(snapshot.history().select(*columns)).unionByName(refused)
    return found.withColumnsRenamed({"total_rows": "row_count", "missing_cells": "missing", "duplicate_rows": "copies"})
