"""Files whose records reach over lines and splits, cut at small and large split sizes."""

import contextlib
import csv
import io
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.sources import csv_files, dump_parts, sql_dumps


@contextlib.contextmanager
def splits_of(spark, size):
    """Splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, str(size))
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def _csv(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


ALPHABET = ["a", "b", '"', ",", "\n", " ", "é", '""', '",', ',"', '\n"', "x" * 30]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_lines_are_split(spark, tmp_path, end):
    rng = random.Random(len(end))
    rows = [(str(i), "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) + "z", f"end {i}") for i in range(250)]
    rows[7] = ("7", "\n" * 900 + "z", "long")  # reaches over several splits
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(_csv([("k", "te,xt\n", "v"), *rows], end).encode())
    for size in (200, 700, 1 << 27):
        with splits_of(spark, size):
            df = csv_files.read_csv(spark, f"{tmp_path}/in", infer=False)
            assert df.columns == ["k", "te,xt\n", "v"]
            assert Counter(map(tuple, df.collect())) == Counter(rows)
            if size == 700:
                assert csv_files.split_lines(spark, f"{tmp_path}/in").rdd.getNumPartitions() > 5


def test_columns_meet_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a,b\n1,p\n2,q\n")
    (tmp_path / "in" / "b.csv").write_text("b,a\nr,3\n")
    (tmp_path / "in" / "c.csv").write_text('b,a\n"s\nt",4\n')
    (tmp_path / "in" / "d.csv").write_text("b\nonly\n")
    (tmp_path / "in" / "e.csv").write_text("a,b\n")
    df = csv_files.read_csv(spark, f"{tmp_path}/in")
    assert df.columns == ["a", "b"] and df.dtypes[0] == ("a", "bigint")
    assert {tuple(r) for r in df.collect()} == {(1, "p"), (2, "q"), (3, "r"), (4, "s\nt"), (None, "only")}


def test_stray_quotes_open_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n5" pipe,x\n"6"" pipe",y\n"two\nlines",z\n7" pipe,"q\n"\n')
    for size in (8, 1 << 27):
        with splits_of(spark, size):
            rows = csv_files.read_csv(spark, str(tmp_path / "a.csv"), infer=False).collect()
            assert Counter(map(tuple, rows)) == Counter([('5" pipe', "x"), ('6" pipe', "y"), ("two\nlines", "z"), ('7" pipe', "q\n")])


def _plain_effect(line, state):
    """The state after a line, sign by sign."""
    quoted, fresh, i = bool(state), not state, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"':
            if line[i + 1 : i + 2] == '"':
                i += 1
            else:
                quoted = False
        elif not quoted and c == '"' and fresh:
            quoted = True
        elif not quoted and c == ",":
            fresh, i = True, i + 1
            continue
        fresh, i = False, i + 1
    return int(quoted)


def test_effects_of_lines(spark):
    rng = random.Random(2)
    lines = sorted({"".join(rng.choice('",a ') for _ in range(rng.randint(0, 9))) for _ in range(3000)})
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    for r in df.select("value", csv_files._effect().alias("e")).collect():
        assert r["e"] == _plain_effect(r["value"], 0) + 2 * _plain_effect(r["value"], 1), r["value"]


@given(st.lists(st.sampled_from([csv_files.SAME, csv_files.CLOSES, csv_files.OPENS, csv_files.FLIPS]), max_size=12), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_states_of_splits(effects, width):
    import pyarrow as pa

    rows = [(9, i // width * 10, e) for i, e in enumerate(effects)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["file", "split", "effect"])
    folded = [tuple(r.values()) for b in csv_files._split_effects(iter([batch])) for r in b.to_pylist()]
    found = csv_files._states(folded).get(9, ([], []))
    state = 0
    for i, e in enumerate(effects):
        if i % width == 0:
            after = [s for split, s in zip(*found) if split < i // width * 10]
            assert (after[-1] if after else 0) == state
        state = e >> state & 1


def _dump(rng, n):
    """A script with quotes, comments and statements in odd places, and the rows of its first table."""
    rows, text = [], ["-- INSERT INTO t VALUES (0, 'no'); it's a comment\nCREATE TABLE t (a INT,\n b TEXT /* not; this ' */, c DECIMAL(30, 2));\n\nCREATE TABLE u (x INT);"]
    for i in range(n):
        if i % 40 == 0:
            text.append(rng.choice(["\nINSERT INTO u VALUES (1), (lower('x'));", ";", "/* ; ' \n */", "\n-- quote ' and ;\n", ""]))
            text.append(rng.choice(["\nINSERT INTO t VALUES", "insert  into t\n(a, b, c)\nvalues ", "INSERT INTO `t` (a,b,c) VALUES\n"]))
        note = "".join(rng.choice(["'", ";", "\n", "(", "),", "--", "/*", "*/", "w", "é"]) for _ in range(rng.randint(0, 6)))
        rows.append((i, note, f"{i}.25"))
        quoted = note.replace("'", "''")
        text.append(f"({i}, '{quoted}', {i}.25)" + (";\n" if i % 40 == 39 or i == n - 1 else rng.choice([",", ",\n", " ,\n  "])))
    return "".join(text), rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dumps_are_split(spark, tmp_path, seed):
    from decimal import Decimal

    script, rows = _dump(random.Random(seed), 150)
    (tmp_path / "d.sql").write_text(script)
    want = Counter((a, b, Decimal(c)) for a, b, c in rows)
    for size in (150, 1_000, 1 << 27):
        with splits_of(spark, size):
            df = sql_dumps.read_sql_table(spark, str(tmp_path / "d.sql"))
            assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "decimal(30,2)")]
            assert Counter(map(tuple, df.collect())) == want
            if size == 1_000:
                parts = dump_parts.read_sql_parts(spark, str(tmp_path / "d.sql"), 100)
                assert parts.count() > 8 and parts.agg({"script": "max"}).first()
                found = sql_dumps.sql_dump_rows(parts).orderBy("part", "statement", "row_no").collect()
                assert [int(r["values"][0]) for r in found] == [a for a, _, _ in rows]


def test_errors_of_split_dumps(spark, tmp_path):
    values = ",\n".join(f"({i}, 'x')" for i in range(60))
    cases = {
        "SELECT 1;\n" * 50: sql_dumps.NO_TABLE,
        f"CREATE TABLE t (a INT, b TEXT);\nINSERT INTO t VALUES {values},\n(7, lower('Q'));": sql_dumps.NOT_LITERAL,
        f"CREATE TABLE t (a INT, b TEXT);\nINSERT INTO t VALUES {values};\nINSERT INTO t VALUES\n(7);": sql_dumps.NO_SUCH_COLUMN,
        f"CREATE TABLE t (a INT, b TEXT);\nINSERT INTO t VALUES {values};\nATTACH DATABASE 'x' AS y;": sql_dumps.NO_ATTACH,
    }
    for i, (script, error) in enumerate(cases.items()):
        (tmp_path / f"{i}.sql").write_text(script)
        with splits_of(spark, 300), pytest.raises(sql_dumps.SqlDumpError, match=error):
            sql_dumps.read_sql_table(spark, str(tmp_path / f"{i}.sql"))


def test_values_beyond_the_declared_type(spark, tmp_path):
    (tmp_path / "x.sql").write_text(
        "CREATE TABLE t (a INT, b INT, c INT, d DECIMAL(30,2), e DECIMAL(30,2), f INT, g REAL);\n"
        "INSERT INTO t VALUES (99999999999999999999, 1.5, 'x', 1234567890123456789012345678.25, 0.125, 1, 'n'), (1, 2, 3, 4, 5, NULL, 2.5);"
    )
    df = sql_dumps.read_sql_table(spark, str(tmp_path / "x.sql"))
    assert [k for _, k in df.dtypes] == ["decimal(38,0)", "double", "string", "decimal(30,2)", "double", "bigint", "string"]
    first, second = sorted(df.collect(), key=lambda r: r["e"])
    assert [str(v) for v in first] == ["99999999999999999999", "1.5", "x", "1234567890123456789012345678.25", "0.125", "1", "n"]
    assert [str(v) for v in second] == ["1", "2.0", "3", "4.00", "5.0", "None", "2.5"]


def test_parts_of_a_dump_stay_where_they_were_read(spark, tmp_path):
    """All parts of a file have one path; shuffled by it, they would meet in one task."""
    values = ",\n".join(f"({i}, 'text {i}')" for i in range(400))
    (tmp_path / "d.sql").write_text(f"CREATE TABLE t (a INT, b TEXT);\nINSERT INTO t VALUES {values};")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        with splits_of(spark, 1000):
            parts = dump_parts.read_sql_parts(spark, str(tmp_path / "d.sql"), 100)
            assert len({row["task"] for row in parts.select(F.spark_partition_id().alias("task")).collect()}) > 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
