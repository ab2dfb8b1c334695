import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import clean, conversations, relational
from plumbline.plans.versions import NothingToUndo, store
from plumbline.sources import artifacts, csv_files, intake, page_text, sql_dumps
from plumbline.streaming.ingest import PARSE_ERROR, ingest_once


@pytest.fixture()
def t_dirty(spark):
    rows = [("  Ann ", 10.0), ("Bob", None), ("Ann", 10.0), ("Ann", 10.0), (None, 30.0)]
    return spark.createDataFrame(rows, "name string, score double")


def test_clean_removes_defects(t_dirty):
    options = clean.CleaningOptions(trim_whitespace=True, remove_duplicates=True, fill_missing=True, fill_strategy="median")
    result = clean.clean(t_dirty, options)
    summary = clean.cleaning_summary(t_dirty, result).first()
    assert (summary.rows_before, summary.rows_after, summary.rows_removed) == (5, 3, 2)
    assert (summary.missing_before, summary.missing_after, summary.duplicates_before, summary.duplicates_after) == (2, 0, 1, 0)
    assert summary.operations_applied == ["Trimmed whitespace", "Removed 2 duplicate row(s)", "Filled missing values in: name, score"]
    assert {tuple(r) for r in result.frame.collect()} == {("Ann", 10.0), ("Bob", 20.0), ("Ann", 30.0)}


def test_nothing_to_clean(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "a bigint")
    assert clean.clean(df, clean.CleaningOptions(remove_duplicates=True)).operations == [clean.NO_CHANGES]


def test_fill_rules(spark):
    schema = "t string, n bigint, empty string, allnull double"
    df = spark.createDataFrame([("\t x ", 1, None, None), ("b", None, None, None), ("b", 2, None, None), (None, 4, None, None), (" ", None, None, None)], schema)
    assert clean.fill_values(df) == {"t": "b", "n": 2.0, "empty": "", "allnull": None}
    filled = clean.fill_missing(df, "mean")
    assert dict(filled.dtypes)["n"] == "double"
    assert {r.n for r in filled.collect()} == {1.0, 2.0, 4.0, 7 / 3}
    assert [r.t for r in clean.trim_whitespace(df).collect()] == ["x", "b", "b", None, ""]
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    assert clean.fill_values(tie) == {"t": "a"}


def test_types_and_dates(spark):
    df = spark.createDataFrame([("1", "1/2/2024"), ("2", "2024-01-03"), ("3", "Jan 4, 2024"), ("4", "5 Jan 2024"), ("x", "?")], "n string, any_name string")
    result = clean.clean(df, clean.CleaningOptions(convert_types=True, normalize_dates=True))
    assert result.operations == ["Converted to numeric: n", "Normalized dates: any_name"]
    assert [tuple(r) for r in result.frame.collect()] == [(1.0, "2024-01-02"), (2.0, "2024-01-03"), (3.0, "2024-01-04"), (4.0, "2024-01-05"), (None, None)]


def test_versions(spark, t_dirty, tmp_path):
    original = store(t_dirty, "people", f"{tmp_path}/people")
    with pytest.raises(NothingToUndo):
        original.undo(spark)
    cleaned, _ = original.apply(spark, clean.CleaningOptions(remove_duplicates=True))
    assert cleaned.read(spark).count() == 4
    again, _ = cleaned.apply(spark, clean.CleaningOptions(drop_empty_rows=True))
    assert again.read(spark).count() == 5, "cleaning starts from the original"
    copy = again.copy(spark, f"{tmp_path}/copy")
    undone = again.undo(spark)
    assert undone == original and not os.path.exists(again.path)
    assert (copy.name, copy.read(spark).count()) == ("people (copy)", 5)


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_csv_types_and_missing_tokens(spark, tmp_path):
    _write(tmp_path / "a.csv", 'region,revenue,flag,mix,gap\nN/A,10,True,1.5,\n" pad ",20,false,NaN,null\n"a ""q"", b",30,TRUE,2,NA\n')
    df = csv_files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "boolean", "double", "string"]
    assert {tuple(r) for r in df.collect()} == {(None, 10, True, 1.5, None), (" pad ", 20, False, None, None), ('a "q", b', 30, True, 2.0, None)}


def test_csv_whole_numbers_keep_their_digits(spark, tmp_path):
    _write(tmp_path / "w.csv", "a,b,c\n9007199254740993123,99999999999999999999,1\n12345678901234567,1,123456789012345678901234567890123456789\n")
    df = csv_files.read_csv(spark, str(tmp_path / "w.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(38,0)", "double"]
    assert sorted(r.a for r in df.collect()) == [12345678901234567, 9007199254740993123]
    assert max(r.b for r in df.collect()) == 99999999999999999999


def test_csv_files_without_line_breaks_are_split(spark, tmp_path):
    lines = "".join(f"{i},row number {i}\n" for i in range(40_000))
    _write(tmp_path / "in" / "long.csv", "k,t\n" + lines)
    _write(tmp_path / "in" / "broken.csv", 'k,t\n-1,"two\nlines"\n')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = csv_files.read_csv(spark, f"{tmp_path}/in")
        assert df.rdd.getNumPartitions() > 5
        assert df.count() == 40_001 and df.filter("k = -1").first().t == "two\nlines"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_csv_line_breaks_are_found(spark, tmp_path):
    _write(tmp_path / "b.csv", 'k,t\n1,"two\nlines"\n2,one\n')
    path = str(tmp_path / "b.csv")
    assert len(csv_files.files_with_line_breaks(spark, path)) == 1
    assert {tuple(r) for r in csv_files.read_csv(spark, path).collect()} == {(1, "two\nlines"), (2, "one")}


def test_sql_dumps(spark, tmp_path):
    _write(
        tmp_path / "dumps" / "a.sql",
        "CREATE TABLE IF NOT EXISTS `people` (id INT, name VARCHAR(20), note TEXT);\nCREATE TABLE other (x INT);\n"
        "INSERT INTO other VALUES (9);\ninsert into `people` (id, name, note) values (1, 'O''Hara, (x); y', NULL),\n (2, '', 'NULL');\n"
        "INSERT INTO people VALUES (-3.5, 'INSERT INTO other VALUES (1)', ' pad ');",
    )
    _write(tmp_path / "dumps" / "b.sql", "SELECT 1;")
    _write(tmp_path / "dumps" / "c.sql", "CREATE TABLE t (x INT); ATTACH  DATABASE 'f' AS g;")
    scripts = sql_dumps.read_sql_dumps(spark, f"{tmp_path}/dumps")
    errors = {os.path.basename(r.path): r.error for r in sql_dumps.check_sql_dumps(scripts).collect()}
    assert errors == {"a.sql": None, "b.sql": sql_dumps.NO_TABLE, "c.sql": sql_dumps.NO_ATTACH}
    rows = sql_dumps.sql_dump_rows(scripts).orderBy("statement", "row_no").collect()
    assert [r["values"] for r in rows] == [["1", "O'Hara, (x); y", None], ["2", "", "NULL"], ["-3.5", "INSERT INTO other VALUES (1)", " pad "]]
    assert {r.table for r in rows} == {"people"}


def test_sql_dump_table(spark, tmp_path):
    script = (
        "CREATE TABLE t (a INT, b VARCHAR(9), c DECIMAL(9, 2), PRIMARY KEY (a)); -- INSERT INTO t VALUES (0, 'no', 0)\n"
        "INSERT INTO t (b, a) VALUES ('-- kept /* too */', 1);\n/* INSERT INTO t VALUES (9, 'no', 9); */ INSERT INTO t VALUES (2, 'it''s', 1e2);"
    )
    _write(tmp_path / "d" / "t.sql", script)
    df = artifacts.read_source(spark, f"{tmp_path}/d/t.sql")
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert sorted(map(tuple, df.collect())) == [(1, "-- kept /* too */", None), (2, "it's", 100.0)]


@pytest.mark.parametrize(
    ("insert", "error"),
    [("(3, lower('Q'))", sql_dumps.NOT_LITERAL), ("(1, 'a'), (2, b)", sql_dumps.NOT_LITERAL), ("(1)", sql_dumps.NO_SUCH_COLUMN), ("(1, 2 + 3)", sql_dumps.NOT_LITERAL)],
)
def test_sql_dump_rejections(spark, tmp_path, insert, error):
    _write(tmp_path / "x.sql", f"CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES {insert};")
    with pytest.raises(sql_dumps.SqlDumpError, match=error):
        sql_dumps.read_sql_table(spark, f"{tmp_path}/x.sql")


def test_long_insert_statement(spark):
    values = ", ".join(f"({i}, 'name ''{i}''')" for i in range(20_000))
    scripts = spark.createDataFrame([("p", f"CREATE TABLE t (a INT, b TEXT); INSERT INTO t VALUES {values};")], "path string, script string")
    rows = sql_dumps.sql_dump_rows(scripts)
    assert rows.agg(F.count("*"), F.sum(F.get("values", 0).cast("int")), F.max(F.get("values", 1))).first()[:2] == (20_000, sum(range(20_000)))
    assert rows.filter("row_no = 7").first()["values"] == ["7", "name '7'"]


def test_pages(spark):
    docs = spark.createDataFrame([(1, " a \f\f\tb c"), (2, " \f "), (3, None)], "id int, text string")
    assert [tuple(r) for r in page_text.page_text_corpus(docs, ["id"]).collect()] == [(1, 1, "a"), (1, 3, "b c")]
    assert [r.id for r in page_text.unreadable_documents(docs, ["id"]).collect()] == [2, 3]


def test_intake(spark, tmp_path):
    listing = spark.createDataFrame(
        [
            ("../x/my file.csv", 10, "text/csv; charset=x", b"a,b", 1),
            ("notes.txt", 10, "", b"abc", 2),
            ("empty.csv", 0, "", b"", 3),
            ("big.csv", 101 * 1024 * 1024, "", b"a", 4),
            ("fake.pdf", 10, "application/pdf", b"abcd", 5),
            ("real.PDF", 10, "application/pdf", b"%PDF-1.4", 6),
            ("book.xlsx", 10, "", b"PK\x03\x04zz", 7),
            ("pic.csv", 10, "image/png", b"a", 8),
            ("../x/my file.csv", 10, "", b"a,b", 9),
            ("Stored.sql", 10, "", b"--", 10),
            (".csv", 10, "", b"a", 11),
        ],
        "name string, size bigint, mime string, head binary, arrival int",
    )
    stored = spark.createDataFrame([("stored.SQL",)], "name string")
    found = {r.arrival: r for r in intake.file_intake(listing, stored).collect()}
    assert [found[i].status for i in range(1, 12)] == [
        "queued", "error", "error", "error", "error", "queued", "queued", "error", "duplicate", "duplicate", "error",
    ]
    assert (found[1].safe_name, found[1].source_type, found[6].source_type) == ("my_file.csv", "csv", "pdf")
    assert found[9].reason == intake.SEEN_BEFORE and found[3].reason == "Uploaded file is empty"
    odd = spark.createDataFrame(
        [("a.csv", 5, 1), ("a.csv", 5, 1), ("a.csv", 5, 2), (None, 5, 1), ("b.csv", None, 1), ("b.csv", None, 2)],
        "name string, size bigint, arrival int",
    ).selectExpr("*", "'' AS mime", "CAST('a' AS binary) AS head")
    rows = intake.file_intake(odd).collect()
    assert sorted((r.name or "", r.status) for r in rows) == [("", "error")] + [("a.csv", "duplicate")] * 2 + [("a.csv", "queued")] + [("b.csv", "error")] * 2
    assert all(r.reason for r in rows if r.status != "queued")
    _write(tmp_path / "in" / "a.pdf", "%PDF-x")
    _write(tmp_path / "in" / "b.pdf", "hello")
    real = {r.name: r.status for r in intake.file_intake(intake.list_files(spark, f"{tmp_path}/in")).collect()}
    assert real == {"a.pdf": "queued", "b.pdf": "error"}


def test_artifact_fallbacks(spark, t_dirty, tmp_path):
    assert artifacts.read_artifact(spark, f"{tmp_path}/none") is None
    first = artifacts.load_table(spark, f"{tmp_path}/cache", None, lambda: t_dirty)
    assert first.count() == 5
    assert artifacts.load_table(spark, f"{tmp_path}/cache", None, lambda: 1 / 0).count() == 5
    with pytest.raises(artifacts.UnsupportedSource):
        artifacts.read_source(spark, "x.docx")


def test_stream_profiles_each_file_once(spark, tmp_path):
    _write(tmp_path / "in" / "a.csv", "k,v\nx,1\n,2\n")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
    out = f"{tmp_path}/out"
    first = ingest_once(spark, f"{tmp_path}/in", schema, out)
    assert [(r.status, r.row_count, r.missing_cells) for r in first.collect()] == [("cleaned", 2, 1)]
    _write(tmp_path / "in" / "empty.csv", "k,v\n")
    _write(tmp_path / "in" / "b.csv", "k,v\nx,not a number\n")
    second = {os.path.basename(r.path): r for r in ingest_once(spark, f"{tmp_path}/in", schema, out).collect()}
    assert set(second) == {"a.csv", "b.csv", "empty.csv"} and second["b.csv"].error == PARSE_ERROR
    assert (second["empty.csv"].status, second["empty.csv"].row_count, second["empty.csv"].column_count) == ("cleaned", 0, 2)
    assert ingest_once(spark, f"{tmp_path}/in", schema, out).count() == 3


def test_chunks_join_back_to_the_text(spark):
    texts = ["a b c d e", "one", "", "a  b", "1 2 3 4", " lead"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    chunks = conversations.chunk_words(df, ["id"]).orderBy("id", "ordinal").collect()
    for i, text in enumerate(texts):
        words = text.split(" ")
        want = [" ".join(words[k : k + 4]) + (" " if k + 4 < len(words) else "") for k in range(0, len(words), 4)]
        assert [c.chunk for c in chunks if c.id == i] == want


def test_conversation_document(spark):
    turns = spark.createDataFrame(
        [(1, 1, "assistant", "hi", True), (1, 0, "user", "q" * 61, False)], "conv_id bigint, turn bigint, role string, text string, has_chart boolean"
    )
    blocks = conversations.conversation_markdown(turns, chart="has_chart").orderBy("conv_id", "position").collect()
    document = "\n".join(r.markdown for r in blocks)
    assert document == (
        f"# {'q' * 60}…\n\n_Exported conversation_\n\n## 🧑 You\n\n{'q' * 61}\n\n## 🤖 Assistant\n\nhi\n\n_[chart visualization]_\n"
    )


def test_pages_and_search(spark):
    df = spark.createDataFrame([(i, f"Name {i}", "u1" if i % 2 else "u2", i) for i in range(20)], "id int, name string, owner string, created_at int")
    newest = [F.desc("created_at"), F.asc("id")]
    assert [r.id for r in relational.catalog_page(df, newest, 2, 2).collect()] == [17, 16]
    assert relational.catalog_page(df, newest, 500, 0, owner=("owner", "nobody")).count() == 0
    assert relational.catalog_page(df, newest).count() == 20
    for limit, offset in ((0, 0), (5, -1)):
        with pytest.raises(ValueError):
            relational.catalog_page(df, newest, limit, offset)
    keys = [("created_at", False), ("id", True)]
    assert [r.id for r in relational.numbered_page(df, keys, 99).collect()] == [1, 0]
    assert relational.contains_search(df, "name", " NAME 1 ").count() == 11
    assert relational.contains_search(df, "name", " ").count() == 20


def test_pages_of_a_large_table(spark, monkeypatch):
    """No plan keeps more than a page and what a sorted limit may hold."""
    monkeypatch.setattr(relational, "SHALLOW", 10)
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k"))
    keys = [("k", True), ("id", False)]
    want = sorted(((r.k, -r.id) for r in df.collect()))
    for page in (0, 1, 5, 10, 11, 50):
        got = [(r.k, -r.id) for r in relational.numbered_page(df, keys, page).collect()]
        start = min(page, 11) * 9
        assert got == want[start : start + 9], page
    deep = relational.catalog_page(df, relational.ordering(keys), 20, 50)
    assert [(r.k, -r.id) for r in deep.collect()] == want[50:70]
    plan = relational.numbered_page(df, keys, 50)._jdf.queryExecution().executedPlan().toString()
    limits = [int(n) for n in re.findall(r"limit=(\d+)", plan)]
    assert limits and max(limits) <= 9
