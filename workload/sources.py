from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.relational import append_audit
from plumbline.session import materialize, scratch_path
from plumbline.sources import artifacts, csv_files, intake, page_text
from plumbline.streaming import landing
from plumbline.streaming.ingest import file_profiles
from plumbline.streaming.ingest import ingest_profile as profile_stream
from workload.inputs import ACTIVITY, EVENTS_DIRTY, activity, events_dirty, table
from workload.registry import query


@query(
    "csv_roundtrip",
    f"WITH {EVENTS_DIRTY}\nSELECT event_type, value, CAST(nullif(user_text, 'n/a') AS BIGINT) AS user_text, day_text FROM events_dirty",
)
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    csv_files.write_csv(events_dirty(spark, sf_dir), path)
    return csv_files.read_csv(spark, path)


@query("csv_texts", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_texts(spark, sf_dir):
    """Texts with line breaks and quotes survive."""
    path = scratch_path(spark, "csv")
    csv_files.write_csv(table(spark, sf_dir, "documents"), path)
    return csv_files.read_csv(spark, path)


@query("csv_split", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_split(spark, sf_dir):
    """Texts with line breaks, read in splits far smaller than the files."""
    path, size = scratch_path(spark, "csv"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    csv_files.write_csv(table(spark, sf_dir, "documents"), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        return csv_files.read_csv(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@query(
    "csv_headers",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_totalprice END AS o_totalprice, o_orderstatus FROM orders",
)
def csv_headers(spark, sf_dir):
    """Files whose columns stand in another order, or lack one."""
    path, orders = scratch_path(spark, "csv"), table(spark, sf_dir, "orders")
    for rest, names in enumerate((["o_orderkey", "o_totalprice", "o_orderstatus"], ["o_orderstatus", "o_orderkey", "o_totalprice"], ["o_orderstatus", "o_orderkey"])):
        csv_files.write_csv(orders.where(F.col("o_orderkey") % 3 == rest).select(*names), f"{path}/{rest}")
    return csv_files.read_csv(spark, f"{path}/*")


DUMP_ROWS = 500


@query("sql_dump_rows", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def sql_dump_rows(spark, sf_dir):
    """The customers as SQL dump files of at most 500 rows, read back as a typed table.

    Comments and quoted signs stand between the statements, and columns come in another order.
    """
    customer = table(spark, sf_dir, "customer")
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'"))
    row = F.concat(
        F.lit("("),
        F.concat_ws(", ", quoted("c_name"), F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal"), quoted("c_mktsegment")),
        F.lit(")"),
    )
    head = (
        "-- INSERT INTO customer VALUES (0, 'it''s a comment', 0, 0, 'x');\n"
        "CREATE TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(25), c_nationkey INT, c_acctbal DECIMAL(12, 2), c_mktsegment VARCHAR(10),"
        " UNIQUE (c_custkey));\nCREATE TABLE other (x INT);\nINSERT INTO other VALUES (lower('y'));\n"
        "/* INSERT INTO customer VALUES (1); */ INSERT INTO customer (c_name, c_custkey, c_nationkey, c_acctbal, c_mktsegment) VALUES\n"
    )
    scripts = (
        customer.select(F.floor(F.col("c_custkey") / DUMP_ROWS).alias("file"), row.alias("row"))
        .groupBy("file")
        .agg(F.concat(F.lit(head), F.array_join(F.collect_list("row"), ",\n"), F.lit(";")).alias("script"))
    )
    path = scratch_path(spark, "dumps")
    scripts.select(F.encode("script", "utf-8").alias("value")).select(F.decode("value", "utf-8").alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).text(path)
    return artifacts.read_source(spark, path, "sql")


@query(
    "sql_dump_large",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate,
       concat(l_returnflag, ' and ', chr(39), l_linestatus, chr(39), ';') AS note FROM lineitem""",
)
def sql_dump_large(spark, sf_dir):
    """The line items as one dump: an INSERT without an end in sight, cut into parts of whole rows by the tasks that read it.

    One file is what the query is about, so the rows pass one task when it is written; their text is made by many before.
    """
    lines = table(spark, sf_dir, "lineitem")
    note = F.concat(F.col("l_returnflag"), F.lit(" and ''"), F.col("l_linestatus"), F.lit("'';"))
    quoted = [F.concat(F.lit("'"), c, F.lit("'")) for c in (F.col("l_returnflag"), F.col("l_shipdate").cast("date").cast("string"), note)]
    row = F.concat(F.lit("("), F.concat_ws(",", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", *quoted), F.lit("),"))
    head = (
        "CREATE TABLE lineitem (\n  l_orderkey INT,\n  l_linenumber INT,\n  l_quantity REAL,\n  l_extendedprice REAL, -- the price; before '\n  l_discount REAL,\n"
        "  l_returnflag TEXT,\n  l_shipdate TEXT,\n  note TEXT\n);\n/* rows; */\nINSERT INTO lineitem VALUES"
    )
    one = lambda text: spark.createDataFrame([(text,)], "value string")
    path, size = scratch_path(spark, "dump"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    one(head).union(materialize(lines.select(row.alias("value")), "dump-lines")).union(one(f"({', '.join(['NULL'] * 8)});")).coalesce(1).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        return artifacts.read_source(spark, path, "sql").where("l_orderkey IS NOT NULL")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@query(
    "page_text_corpus",
    """SELECT doc_id, CAST(i AS INTEGER) AS page, text FROM (
  SELECT doc_id, i, regexp_replace(lines[i], '^\\s+|\\s+$', '', 'g') AS text FROM (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)))
WHERE length(text) > 0""",
)
def page_text_corpus(spark, sf_dir):
    """The lines of a document stand in for its pages."""
    return page_text.page_text_corpus(table(spark, sf_dir, "documents"), ["doc_id"], page_break="\n")


@query(
    "unreadable_documents",
    """SELECT page_id, 'No extractable text found' AS error FROM pages
WHERE page_id % 10 = 0 OR length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) = 0""",
)
def unreadable_documents(spark, sf_dir):
    """Every tenth page keeps only its markup, as a scanned page would."""
    markup = F.array_join(F.regexp_extract_all("html", F.lit("(<[^>]*>)"), F.lit(1)), " \n")
    html = F.when(F.col("page_id") % 10 == 0, markup).otherwise(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(html, "<[^>]*>", "").alias("text"))
    return page_text.unreadable_documents(pages, ["page_id"])


EXTENSIONS = [".csv", ".xlsx", ".XLS", ".pdf", ".sql", ".txt"]
MIMES = ["text/csv; charset=utf-8", "", "application/pdf", "image/png"]
HEADS = ["504b0304", "25504446", "d0cf11e0", "61622c63"]


def listing(spark, sf_dir):
    """An upload listing from the documents: names repeat, sizes reach from 0 beyond the limit."""
    i = F.col("doc_id")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("in/"), "source", F.lit("/Report ("), "lang", F.lit(")"), pick(EXTENSIONS, i)).alias("name"),
        F.when(i % 17 == 0, 0).when(i % 19 == 0, 104857601).otherwise(F.col("n_chars") % 50).cast("bigint").alias("size"),
        pick(MIMES, F.floor(i / 3)).alias("mime"),
        F.unhex(pick(HEADS, F.floor(i / 5))).alias("head"),
        i.alias("arrival"),
    )


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "file_intake",
    f"""WITH listing AS (
  SELECT 'in/' || source || '/Report (' || lang || ')' || {_list_sql(EXTENSIONS)}[doc_id % 6 + 1] AS name,
         CAST(CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN 104857601 ELSE n_chars % 50 END AS BIGINT) AS size,
         {_list_sql(MIMES)}[doc_id // 3 % 4 + 1] AS mime, {_list_sql(HEADS)}[doc_id // 5 % 4 + 1] AS head, doc_id AS arrival FROM documents),
typed AS (
  SELECT *, split_part(name, '/', -1) AS base, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS extension,
         row_number() OVER (PARTITION BY name, size ORDER BY arrival) > 1 OR lower(name) IN (SELECT lower('IN/' || source || '/report (en).csv') FROM documents WHERE lang = 'en') AS is_duplicate FROM listing),
kinds AS (
  SELECT *, CASE extension WHEN '.csv' THEN 'csv' WHEN '.xlsx' THEN 'excel' WHEN '.xls' THEN 'excel' WHEN '.pdf' THEN 'pdf' WHEN '.sql' THEN 'sql' END AS source_type FROM typed),
checked AS (
  SELECT *, CASE WHEN source_type IS NULL THEN 'Unsupported file type. Allowed: .csv, .pdf, .sql, .xls, .xlsx'
    WHEN mime = 'image/png' THEN 'Unsupported content type'
    WHEN size > 104857600 THEN 'File exceeds the 100MB upload limit'
    WHEN size > 0 AND source_type = 'pdf' AND head <> '25504446' THEN 'File does not look like a valid PDF'
    WHEN size > 0 AND source_type = 'excel' AND head NOT IN ('504b0304', 'd0cf11e0') THEN 'File does not look like a valid Excel workbook'
    WHEN size = 0 THEN 'Uploaded file is empty' END AS failed FROM kinds)
SELECT name, size, mime, arrival, regexp_replace(base, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe_name, source_type, is_duplicate,
       CASE WHEN failed IS NOT NULL THEN 'error' WHEN is_duplicate THEN 'duplicate' ELSE 'queued' END AS status,
       CASE WHEN failed IS NOT NULL THEN failed WHEN is_duplicate THEN 'A dataset with this name already exists' END AS reason FROM checked""",
)
def file_intake(spark, sf_dir):
    english = table(spark, sf_dir, "documents").filter("lang = 'en'")
    stored = english.select(F.concat(F.lit("IN/"), "source", F.lit("/report (en).csv")).alias("name"))
    return intake.file_intake(listing(spark, sf_dir), stored).drop("head")


@query("artifact_roundtrip", f"WITH {EVENTS_DIRTY}\nSELECT * FROM events_dirty")
def artifact_roundtrip(spark, sf_dir):
    """No artifact and no durable copy yet: the source is parsed, written, and read back."""
    root = scratch_path(spark, "artifacts")
    first = artifacts.load_table(spark, f"{root}/cache", f"{root}/durable", lambda: events_dirty(spark, sf_dir))
    artifacts.write_artifact(first, f"{root}/durable")

    def must_not_parse():
        raise AssertionError("the durable copy was not used")

    return artifacts.load_table(spark, f"{root}/other-cache", f"{root}/durable", must_not_parse)


@query("audit_append", f"WITH {ACTIVITY}\nSELECT kind, count(*) AS entries FROM activity GROUP BY kind")
def audit_append(spark, sf_dir):
    path = scratch_path(spark, "audit")
    events = activity(spark, sf_dir)
    append_audit(events.filter("kind = 'view'"), path)
    append_audit(events.filter("kind <> 'view'"), path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("entries"))


@query(
    "ingest_profile",
    f"""WITH {EVENTS_DIRTY}
SELECT 'cleaned' AS status, count(*) AS row_count, 4 AS column_count,
       count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE value IS NULL)
       + count(*) FILTER (WHERE user_text IS NULL OR user_text = 'n/a') + count(*) FILTER (WHERE day_text IS NULL) AS missing_cells
FROM events_dirty""",
)
def ingest_profile(spark, sf_dir):
    """CSV files land in a folder, a stream profiles each one; the profiles add up to the table."""
    root = scratch_path(spark, "ingest")
    csv_files.write_csv(events_dirty(spark, sf_dir).repartition(4), f"{root}/landing")
    schema = T.StructType(
        [
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("user_text", T.StringType()),
            T.StructField("day_text", T.StringType()),
        ]
    )
    stream = profile_stream(spark, f"{root}/landing", f"{root}/profiles", f"{root}/checkpoint", schema, files_per_batch=2)
    stream.awaitTermination()
    return file_profiles(spark, f"{root}/profiles", schema).groupBy("status", "column_count").agg(
        F.sum("row_count").alias("row_count"), F.sum("missing_cells").alias("missing_cells")
    )


@query(
    "ingest_duplicates",
    f"""WITH {EVENTS_DIRTY}, files AS (
  SELECT CASE WHEN value IS NULL THEN 'gaps' WHEN event_type IS NULL THEN 'untyped' ELSE 'full' END AS file,
         (event_type, value, nullif(user_text, 'n/a'), day_text) AS cells FROM events_dirty)
SELECT batches, file, count(*) AS row_count, count(*) - count(DISTINCT cells) AS duplicate_rows FROM files, (VALUES ('one'), ('each')) b(batches) GROUP BY ALL""",
)
def ingest_duplicates(spark, sf_dir):
    """Repeated rows are counted within a file, however files fall into batches."""
    file = F.when(F.col("value").isNull(), "gaps").when(F.col("event_type").isNull(), "untyped").otherwise("full")
    root, out = scratch_path(spark, "ingest"), None
    rows = events_dirty(spark, sf_dir).withColumn("file", file).repartition("file")
    quoting = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.partitionBy("file").options(header=True, emptyValue="", nullValue="", **quoting).csv(f"{root}/landing")
    schema = T.StructType.fromDDL("event_type string, value double, user_text string, day_text string")
    for batches, files in (("one", 1000), ("each", 1)):
        profile_stream(spark, f"{root}/landing/*", f"{root}/{batches}", f"{root}/checkpoint-{batches}", schema, files).awaitTermination()
        named = file_profiles(spark, f"{root}/{batches}", schema).select(
            F.lit(batches).alias("batches"), F.regexp_extract("path", "file=([a-z]+)", 1).alias("file"), "row_count", "duplicate_rows"
        )
        out = named if out is None else out.unionByName(named)
    return out.groupBy("batches", "file").agg(F.sum("row_count").alias("row_count"), F.sum("duplicate_rows").alias("duplicate_rows"))


@query(
    "ingest_isolated",
    f"""WITH {EVENTS_DIRTY}, files AS (
  SELECT CASE WHEN value IS NULL THEN 'gaps' WHEN event_type IS NULL THEN 'untyped' ELSE 'full' END AS file,
         (event_type, value, nullif(user_text, 'n/a'), day_text) AS cells,
         (event_type IS NULL)::INT + (value IS NULL)::INT + (user_text IS NULL OR user_text = 'n/a')::INT + (day_text IS NULL)::INT AS gaps FROM events_dirty)
SELECT file, 'cleaned' AS status, 1 AS attempt, count(*) AS row_count, 4 AS column_count, CAST(sum(gaps) AS BIGINT) AS missing_cells,
       count(*) - count(DISTINCT cells) AS duplicate_rows FROM files GROUP BY file
UNION ALL SELECT 'customers', 'cleaned', 1, count(*), 3, 0, 0 FROM customer
UNION ALL SELECT 'torn', 'error', 2, NULL, NULL, NULL, NULL""",
)
def ingest_isolated(spark, sf_dir):
    """Files of other columns and orders, with line breaks, and one that cannot be read land together; the last one's attempts run out."""
    root, quoting = scratch_path(spark, "landing"), {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
    quoting |= {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    file = F.when(F.col("value").isNull(), "gaps").when(F.col("event_type").isNull(), "untyped").otherwise("full")
    dirty = events_dirty(spark, sf_dir).withColumn("file", file)
    for name in ("gaps", "untyped", "full"):  # the columns of each file in another order
        names = ["event_type", "value", "user_text", "day_text"]
        turned = names[len(name) % 4 :] + names[: len(name) % 4]
        dirty.where(F.col("file") == name).select(*turned).coalesce(1).write.options(**quoting).csv(f"{root}/in/file={name}")
    broken_lines = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('"'))
    table(spark, sf_dir, "customer").select("c_custkey", broken_lines.alias("c_name"), "c_acctbal").coalesce(1).write.options(**quoting).csv(
        f"{root}/in/file=customers"
    )
    torn = table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).coalesce(1)
    torn.write.text(f"{root}/torn")
    _copy_as(spark, f"{root}/torn", f"{root}/in/file=torn", "torn.csv.gz")
    landing.land_files(spark, f"{root}/in/*", f"{root}/out", f"{root}/checkpoint", attempts=2).awaitTermination()
    landing.retry_landed(spark, f"{root}/out", attempts=2)
    outcomes = landing.file_outcomes(spark, f"{root}/out").withColumn("file", F.regexp_extract("path", "file=([a-z]+)", 1))
    return outcomes.select("file", "status", "attempt", "row_count", "column_count", "missing_cells", "duplicate_rows")


def _copy_as(spark, source, target, name):
    """The one part file of ``source`` under another name, so that its ending says what it is not."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files, conf = path(source).getFileSystem(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration()
    part = next(f.getPath() for f in files.listStatus(path(source)) if f.getPath().getName().startswith("part-"))
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, part, files, path(f"{target}/{name}"), False, conf)


@query(
    "landed_profile",
    """WITH files AS (SELECT * FROM orders), n AS (SELECT count(*) AS n FROM files)
SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, count(*) AS "rows", CAST(0 AS BIGINT) AS missing, count(*) AS numbers, CAST(min(o_orderkey) AS DOUBLE) AS least, CAST(max(o_orderkey) AS DOUBLE) AS most FROM files
UNION ALL SELECT 'o_totalprice', 'double', count(*), 0, count(*), min(o_totalprice), max(o_totalprice) FROM files
UNION ALL SELECT 'o_orderstatus', 'string', count(*), 0, 0, NULL, NULL FROM files
UNION ALL SELECT '*', 'row', count(*), 0, 0, NULL, NULL FROM files""",
)
def landed_profile(spark, sf_dir):
    """The profile of a table that landed in files, from their states."""
    root = scratch_path(spark, "landing")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    csv_files.write_csv(orders.repartition(4), f"{root}/in")
    landing.land_files(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", files_per_batch=3).awaitTermination()
    return landing.landed_profile(spark, f"{root}/out").select("column", "dtype", "rows", "missing", "numbers", "least", "most")
