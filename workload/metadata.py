from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import relational
from workload.inputs import ACTIVITY, CATALOG, NOW, activity, catalog, table
from workload.registry import query

WEEK_AGO = "TIMESTAMP '2024-01-24 00:00:00'"


def newest():
    return [F.desc("created_at"), F.asc("id")]


@query(
    "owned_join",
    """SELECT o_custkey, o_orderkey, o_totalprice, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING'""",
)
def owned_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", "c_mktsegment")
    return relational.owned_join(orders, customers, "o_custkey", "c_mktsegment", "BUILDING").drop("c_mktsegment")


@query(
    "lookup_missing",
    """SELECT d.doc_id, d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AS is_found FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def lookup_missing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return relational.lookup(documents, table(spark, sf_dir, "labels"), "doc_id")


@query("catalog_search", f"WITH {CATALOG}\nSELECT * FROM catalog WHERE contains(lower(name), 'order 12')")
def catalog_search(spark, sf_dir):
    return relational.contains_search(catalog(spark, sf_dir), "name", " ORDER 12 ")


@query(
    "catalog_page",
    f"""WITH {CATALOG}
SELECT * FROM catalog WHERE owner_id = 10 AND status IN ('F', 'O') ORDER BY created_at DESC, id LIMIT 5 OFFSET 2""",
)
def catalog_page(spark, sf_dir):
    return relational.catalog_page(catalog(spark, sf_dir), newest(), 5, 2, owner=("owner_id", 10), statuses=("status", ["F", "O"]))


@query("newest_page", f"WITH {CATALOG}\nSELECT * FROM catalog ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def newest_page(spark, sf_dir):
    return relational.catalog_page(catalog(spark, sf_dir), newest(), 50, 100)


@query(
    "last_page",
    f"""WITH {CATALOG}
SELECT * FROM catalog ORDER BY created_at DESC, id LIMIT 9 OFFSET (SELECT least(100000000, greatest(1, (count(*) + 8) // 9) - 1) * 9 FROM catalog)""",
)
def last_page(spark, sf_dir):
    """A page number beyond the end gives the last page."""
    return relational.numbered_page(catalog(spark, sf_dir), [("created_at", False), ("id", True)], page=100_000_000)


@query("catalog_all", f"WITH {CATALOG}\nSELECT * FROM catalog WHERE status = 'F'")
def catalog_all(spark, sf_dir):
    """Without a limit a listing is whole."""
    return relational.catalog_page(catalog(spark, sf_dir), newest(), statuses=("status", ["F"]))


@query("deep_page", f"WITH {CATALOG}\nSELECT * FROM catalog ORDER BY created_at DESC, id LIMIT 700 OFFSET 10000")
def deep_page(spark, sf_dir):
    """A page beyond the reach of a sorted limit."""
    return relational.catalog_page(catalog(spark, sf_dir), newest(), 700, 10_000)


@query(
    "catalog_sort",
    f"""WITH {CATALOG}
SELECT id, status, row_count FROM catalog ORDER BY coalesce(row_count, 0) DESC, status, id LIMIT 500""",
)
def catalog_sort(spark, sf_dir):
    df = catalog(spark, sf_dir)
    order = relational.multi_sort(df, [("row_count", False), ("status", True)], "id", zero_for_null=["row_count"])
    return relational.catalog_page(df, order, 500).select("id", "status", "row_count")


@query(
    "platform_stats",
    f"""WITH {CATALOG}, {ACTIVITY}
SELECT 'customers' AS metric, count(*) AS value FROM customer
UNION ALL SELECT 'customers_in_credit', count(*) FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'datasets', count(*) FROM catalog
UNION ALL SELECT 'datasets_processing', count(*) FROM catalog WHERE status = 'P'
UNION ALL SELECT 'datasets_open', count(*) FROM catalog WHERE status = 'O'
UNION ALL SELECT 'events', count(*) FROM activity
UNION ALL SELECT 'events_this_week', count(*) FROM activity WHERE created_at >= {WEEK_AGO}""",
)
def platform_stats(spark, sf_dir):
    customers = relational.metric_counts(
        table(spark, sf_dir, "customer"), {"customers": None, "customers_in_credit": F.col("c_acctbal") > 0}
    )
    datasets = relational.metric_counts(
        catalog(spark, sf_dir),
        {"datasets": None, "datasets_processing": F.col("status") == "P", "datasets_open": F.col("status") == "O"},
    )
    week_ago = F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    events = relational.metric_counts(
        activity(spark, sf_dir), {"events": None, "events_this_week": F.col("created_at") >= week_ago}
    )
    return customers.unionByName(datasets).unionByName(events)


@query(
    "owner_stats",
    f"""WITH {CATALOG}, {ACTIVITY}, counted AS (
  SELECT owner_id, 1 AS datasets, 0 AS forecasts, 0 AS reports, 0 AS chats FROM catalog
  UNION ALL SELECT c.owner_id, 0, 1, 0, 0 FROM lineitem l JOIN catalog c ON l.l_orderkey = c.id
  UNION ALL SELECT owner_id, 0, 0, 1, 0 FROM catalog WHERE status = 'F'
  UNION ALL SELECT owner_id, 0, 0, 0, 1 FROM activity)
SELECT owner_id, CAST(sum(datasets) AS BIGINT) AS datasets, CAST(sum(forecasts) AS BIGINT) AS forecasts,
       CAST(sum(reports) AS BIGINT) AS reports, CAST(sum(chats) AS BIGINT) AS chats FROM counted WHERE owner_id IS NOT NULL GROUP BY owner_id""",
)
def owner_stats(spark, sf_dir):
    datasets = catalog(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    forecasts = relational.owned_join(lines, datasets.select("id", "owner_id"), "id", "owner_id")
    entities = {
        "datasets": datasets,
        "forecasts": forecasts,
        "reports": datasets.filter("status = 'F'"),
        "chats": activity(spark, sf_dir),
    }
    return relational.owner_stats(entities, "owner_id")


FEEDS = f"""{CATALOG}, feeds AS (
  SELECT 'd-' || CAST(id AS VARCHAR) AS id, 'Uploaded ' || name AS label, created_at AS time FROM catalog
  UNION ALL SELECT 'f-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 'Forecast on ' || l_returnflag, l_shipdate FROM lineitem
  UNION ALL SELECT 'r-' || CAST(event_id AS VARCHAR), 'Report: ' || event_type, ts FROM events WHERE event_type <> 'view'
  UNION ALL SELECT 'c-' || CAST(event_id AS VARCHAR), 'Chat: ' || CAST(user_id AS VARCHAR), ts FROM events WHERE event_type = 'view')"""


def _feeds(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seen = F.col("event_type") == "view"
    text = lambda c: F.col(c).cast("string")
    return [
        catalog(spark, sf_dir).select(
            F.concat(F.lit("d-"), text("id")).alias("id"), F.concat(F.lit("Uploaded "), "name").alias("label"), F.col("created_at").alias("time")
        ),
        table(spark, sf_dir, "lineitem").select(
            F.concat(F.lit("f-"), text("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("id"),
            F.concat(F.lit("Forecast on "), "l_returnflag").alias("label"),
            F.col("l_shipdate").alias("time"),
        ),
        events.filter(~seen).select(
            F.concat(F.lit("r-"), text("event_id")).alias("id"), F.concat(F.lit("Report: "), "event_type").alias("label"), F.col("ts").alias("time")
        ),
        events.filter(seen).select(
            F.concat(F.lit("c-"), text("event_id")).alias("id"), F.concat(F.lit("Chat: "), text("user_id")).alias("label"), F.col("ts").alias("time")
        ),
    ]


@query("activity_feed", f"WITH {FEEDS}\nSELECT id, label, time FROM feeds ORDER BY time DESC, id LIMIT 6")
def activity_feed(spark, sf_dir):
    return relational.activity_feed(_feeds(spark, sf_dir))


@query("profile_feed", f"WITH {FEEDS}\nSELECT id, label, time FROM feeds ORDER BY time DESC, id LIMIT 8")
def profile_feed(spark, sf_dir):
    return relational.activity_feed(_feeds(spark, sf_dir), k=8)


@query(
    "ingestion_curve",
    f"""WITH {CATALOG}
SELECT day, created, CAST(sum(created) OVER (ORDER BY day) AS BIGINT) AS total FROM (
  SELECT CAST(created_at AS DATE) AS day, count(*) AS created FROM catalog GROUP BY 1)""",
)
def ingestion_curve(spark, sf_dir):
    return relational.ingestion_curve(catalog(spark, sf_dir), "created_at")


@query(
    "daily_spark",
    f"""WITH {ACTIVITY}, ages AS (
  SELECT CAST(6 - floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000) AS INTEGER) AS bucket FROM activity),
counts AS (SELECT CAST(b AS INTEGER) AS bucket, count(a.bucket) AS items FROM range(0, 7) r(b) LEFT JOIN ages a ON a.bucket = b GROUP BY b)
SELECT bucket, items, CAST(floor(items / greatest(max(items) OVER (), 1) * 100 + 0.5) AS INTEGER) AS height FROM counts""",
)
def daily_spark(spark, sf_dir):
    return relational.daily_spark(activity(spark, sf_dir), "created_at", F.lit(NOW))


@query(
    "rows_per_dataset",
    f"""WITH {CATALOG}
SELECT CASE WHEN length(name) > 14 THEN left(name, 12) || '…' ELSE name END AS name, row_count FROM (
  SELECT 'uploaded ' || name AS name, row_count FROM catalog WHERE row_count > 0 ORDER BY created_at DESC, id LIMIT 8)""",
)
def rows_per_dataset(spark, sf_dir):
    named = catalog(spark, sf_dir).withColumn("name", F.concat(F.lit("uploaded "), "name"))
    return relational.rows_per_dataset(named, newest())


@query("audit_page", f"WITH {ACTIVITY}\nSELECT * FROM activity ORDER BY created_at DESC, id LIMIT 1000 OFFSET 50")
def audit_page(spark, sf_dir):
    return relational.audit_page(activity(spark, sf_dir), limit=1000, offset=50)
