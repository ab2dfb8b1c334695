"""Joins, pages, counts and feeds over catalog tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.row_index import row_index

REPORTS_PER_PAGE = 9
#: Rows up to which a page is cut from one end by a sorted limit; deeper pages number the rows instead.
SHALLOW = 10_000


def owned_join(facts: DataFrame, owned: DataFrame, key: str, owner: str, owner_value: object | None = None) -> DataFrame:
    """Rows of ``facts`` whose parent exists and, if given, belongs to one owner."""
    parents = owned if owner_value is None else owned.filter(F.col(owner) == F.lit(owner_value))
    return facts.join(parents, key, "inner")


def lookup(requests: DataFrame, table: DataFrame, key: str, flag: str = "is_found") -> DataFrame:
    """Every request with its match, or nulls and ``flag`` false."""
    return requests.join(table.withColumn(flag, F.lit(True)), key, "left").withColumn(
        flag, F.coalesce(flag, F.lit(False))
    )


def contains_search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Case-insensitive substring match; a blank query matches everything."""
    q = query.strip().lower()
    return df.filter(F.contains(F.lower(F.col(column)), F.lit(q))) if q else df


def catalog_page(
    df: DataFrame,
    order_by: Sequence[Column],
    limit: int | None = None,
    offset: int = 0,
    owner: tuple[str, object] | None = None,
    statuses: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rows of one owner and some statuses in the given order; all of them, or one page.

    A page that starts or ends deep in the table numbers the rows, so that no task keeps all before it.
    """
    if limit is not None and limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset not below 0")
    out = df
    if owner:
        out = out.filter(F.col(owner[0]) == F.lit(owner[1]))
    if statuses:
        out = out.filter(F.col(statuses[0]).isin(list(statuses[1])))
    if limit is None and not offset:
        return out.orderBy(*order_by)
    if limit is not None and offset + limit <= SHALLOW:
        return out.orderBy(*order_by).offset(offset).limit(limit)
    return _numbered_rows(out, order_by, offset, None if limit is None else offset + limit)


def _numbered_rows(df: DataFrame, order_by: Sequence[Column], start: int, end: int | None) -> DataFrame:
    """Rows from ``start`` to before ``end`` of the order, without keeping those before them in one task."""
    numbered = row_index(df, order_by, "__at")
    inside = F.col("__at") >= start
    return numbered.filter(inside if end is None else inside & (F.col("__at") < end)).drop("__at").orderBy(*order_by)


def ordering(keys: Sequence[tuple[str, bool]], backwards: bool = False) -> list[Column]:
    """Sort columns for ``(name, ascending)`` keys; ``backwards`` gives exactly the reversed order."""
    return [F.col(name).asc() if ascending != backwards else F.col(name).desc() for name, ascending in keys]


def numbered_page(df: DataFrame, keys: Sequence[tuple[str, bool]], page: int, size: int = REPORTS_PER_PAGE) -> DataFrame:
    """A page by number from 0; numbers beyond the last page give the last page.

    The order is given as ``(name, ascending)`` and ends in a unique column. A page near the end is cut
    from the reversed order, one deep in the middle by row numbers.
    """
    if page < 0 or size < 1:
        raise ValueError("page must not be below 0 and size at least 1")
    rows = df.count()
    start = min(page, max(1, -(-rows // size)) - 1) * size
    end = min(rows, start + size)
    if end <= SHALLOW:
        return df.orderBy(*ordering(keys)).offset(start).limit(size)
    if rows - start <= SHALLOW:
        return df.orderBy(*ordering(keys, backwards=True)).offset(rows - end).limit(end - start).orderBy(*ordering(keys))
    return _numbered_rows(df, ordering(keys), start, end)


def multi_sort(df: DataFrame, keys: Sequence[tuple[str, bool]], tie: str, zero_for_null: Sequence[str] = ()) -> list[Column]:
    """Sort columns for ``(name, ascending)`` keys, nulls as 0 where asked, then a unique tie-break."""
    columns = []
    for name, ascending in keys:
        c = F.coalesce(F.col(name), F.lit(0)) if name in zero_for_null else F.col(name)
        columns.append(c.asc() if ascending else c.desc())
    return [*columns, F.col(tie).asc()]


def metric_counts(df: DataFrame, conditions: Mapping[str, Column | None]) -> DataFrame:
    """Rows ``(metric, value)``; all conditions are counted in one scan."""
    counts = df.agg(
        *[(F.count("*") if c is None else F.count_if(c)).alias(f"c{i}") for i, c in enumerate(conditions.values())]
    )
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"c{i}").alias("value")) for i, m in enumerate(conditions)]
    return counts.select(F.inline(F.array(*rows)))


def owner_stats(entities: Mapping[str, DataFrame], owner: str) -> DataFrame:
    """Counts of several entities per owner, 0 where an owner has none.

    Each entity is reduced to one row per owner first; the small results meet in one
    grouped sum, so no large frames are joined.
    """
    counted = None
    for name, df in entities.items():
        part = df.filter(F.col(owner).isNotNull()).groupBy(owner).agg(F.count("*").alias(name))
        counted = part if counted is None else counted.unionByName(part, allowMissingColumns=True)
    return counted.groupBy(owner).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in entities])


def activity_feed(feeds: Sequence[DataFrame], k: int = 6) -> DataFrame:
    """The newest items of several feeds ``(id, label, time)``; each feed is cut first."""
    newest = [F.desc("time"), F.asc("id")]
    merged = None
    for feed in feeds:
        part = feed.select("id", "label", "time").orderBy(*newest).limit(k)
        merged = part if merged is None else merged.unionByName(part)
    return merged.orderBy(*newest).limit(k)


def ingestion_curve(df: DataFrame, created: str) -> DataFrame:
    """Rows ``(day, created, total)``: items per day and all items so far.

    The running total is taken over one row per day.
    """
    days = df.groupBy(F.col(created).cast("date").alias("day")).agg(F.count("*").alias("created"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.filter(F.col("day").isNotNull()).withColumn("total", F.sum("created").over(so_far))


def daily_spark(df: DataFrame, created: str, now: Column, days: int = 7) -> DataFrame:
    """Rows ``(bucket, items, height)`` for the last days up to ``now``, heights scaled to 100."""
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))) / 86_400_000_000)
    bucket = (F.lit(days - 1) - age).cast("int")
    counts = df.agg(*[F.count_if(bucket == i).alias(f"b{i}") for i in range(days)])
    tallest = F.greatest(*[F.col(f"b{i}") for i in range(days)], F.lit(1).cast("bigint"))
    # Half up, as the source's rounding of positive numbers.
    rows = [
        F.struct(
            F.lit(i).alias("bucket"),
            F.col(f"b{i}").alias("items"),
            F.floor(F.col(f"b{i}") / tallest * 100 + 0.5).cast("int").alias("height"),
        )
        for i in range(days)
    ]
    return counts.select(F.inline(F.array(*rows)))


def short_name(name: Column) -> Column:
    return F.when(F.length(name) > 14, F.concat(F.left(name, F.lit(12)), F.lit("…"))).otherwise(name)


def rows_per_dataset(df: DataFrame, order_by: Sequence[Column], k: int = 8) -> DataFrame:
    """The first ``k`` datasets with a row count, names shortened."""
    return df.filter(F.col("row_count") > 0).orderBy(*order_by).limit(k).select(short_name(F.col("name")).alias("name"), "row_count")


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def audit_page(events: DataFrame, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Entries, newest first; ``limit=None`` gives all from the offset on."""
    return catalog_page(events, [F.desc("created_at"), F.asc("id")], limit, offset)
