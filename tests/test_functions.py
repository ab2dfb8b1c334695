import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import accurate_sum, number_text, parse_mixed_date, parse_number, py_round, strip_whitespace, week_end


def _column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


@settings(max_examples=10, deadline=None)
@given(st.data())
def test_py_round_is_python_round(spark, data):
    finite = st.floats(allow_nan=False, allow_infinity=False, min_value=-1e14, max_value=1e14)
    cents = st.integers(-(10**7), 10**7).map(lambda n: n / 1000)
    values = data.draw(st.lists(finite | cents, min_size=50, max_size=200))
    values += [2.675, 0.125, 4.25, 4.00525, -0.5, 0.5, 1.5, -2.5, 1e300, -1e17, 0.0, 4503599627370495.5]
    for digits in (0, 1, 2, 4):
        got = [r[0] for r in _column(spark, values).select(py_round(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_number_text_is_python_format(spark):
    values = [0.0, 1.0, 12.5, 12.345, 999.999, 1000.0, 1234567.5, -1234.5, 0.125, -0.004, 100.0, 0.1]

    def text(v):
        return f"{v:,.0f}" if abs(v) >= 1000 else f"{v:,.2f}".rstrip("0").rstrip(".")

    assert [r[0] for r in _column(spark, values).select(number_text(F.col("v"))).collect()] == [text(v) for v in values]


def test_accurate_sum_does_not_depend_on_order(spark):
    rng = random.Random(5)
    values = [rng.choice([1e-9, 0.01, 1.0, 1e6]) * rng.random() * rng.choice([-1, 1]) for _ in range(5000)]
    sums = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(seed + 1)
        sums.add(df.agg(accurate_sum(F.col("v"))).first()[0])
    assert sums == {math.fsum(values)}


def test_accurate_sum_edges(spark):
    total = lambda vs: _column(spark, vs).agg(accurate_sum(F.col("v"))).first()[0]
    assert total([None, 1e300, 1.5]) == 1e300 + 1.5
    assert total([math.inf, 1.0]) == math.inf
    assert total([None, None]) is None


def test_parse_number_accepts_what_counts_as_a_number(spark):
    texts = [" 10 ", "1e3", "-.5", "1d", "1f", "1,000", "0x10", "True", "", "inf", "nan", None, "1_000"]
    got = [r[0] for r in _column(spark, texts, "string").select(parse_number(F.col("v"))).collect()]
    assert got == [10.0, 1000.0, -0.5, None, None, None, None, None, None, math.inf, None, None, None]


def test_parse_mixed_dates(spark):
    texts = ["2024-01-05", "1/2/2024", "13/02/2024", "Jan 5, 2024", "20240105", "2024-03", "2024-01-05 10:30:00", "2024-01-05T10:30:00", "soon", "12345", None]
    got = [r[0] for r in _column(spark, texts, "string").select(F.date_format(parse_mixed_date(F.col("v")), "yyyy-MM-dd")).collect()]
    iso = "2024-01-05"
    assert got == [iso, "2024-01-02", "2024-02-13", iso, iso, "2024-03-01", iso, iso, None, None, None]


def test_strip_removes_all_white_space(spark):
    texts = ["\t a b\n", "  ", " x ", "x"]
    assert [r[0] for r in _column(spark, texts, "string").select(strip_whitespace(F.col("v"))).collect()] == [t.strip() for t in texts]


def test_weeks_end_on_sunday(spark):
    days = ["2024-01-06", "2024-01-07", "2024-01-08"]
    got = [str(r[0]) for r in _column(spark, days, "string").select(week_end(F.col("v"))).collect()]
    assert got == ["2024-01-07", "2024-01-07", "2024-01-14"]


DATES = """1/2/24|13/2/24|1-2-24|1.2.24|13.2.24|Jan 5 2024|Jan 5, 2024|january 5 2024|JANUARY 5, 2024|2024.01.05|5.1.2024|13.1.2024|1/2/2024 5:00 PM|1/2/2024 12:00 am|13/2/2024 5:00 PM
1/2/2024 5:00:07 am|13/2/2024 11:05|5-Jan-2024|5-Jan-24|5 Jan 24|5 jan 2024|05 January, 2024|Mon, 5 Jan 2024|Monday 5 January 2024|2024/1/5 10:11|2024/1/5 10:11:12|Jan 2024|January 2024
2024-01-05 5:00 PM|2024|1/2/70|1/2/75|1/2/76|1/2/99|31/12/99|May 3 2024|3 May 2024|sunny 5 Jan 2024|5 Foo 2024|1/32/24|13/13/24|1.2|v1.2.24|1234|0|nothing|12|Sun|2024-13-01""".replace("\n", "|").split("|")


def test_dates_equal_pandas(spark):
    import warnings

    import pandas as pd

    warnings.simplefilter("ignore")
    want = {t: pd.to_datetime(pd.Series([t]), errors="coerce", format="mixed")[0] for t in DATES}
    df = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", F.date_format(parse_mixed_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("d"))
    got = {r["t"]: r["d"] for r in df.collect()}
    unlike = {t: (got[t], str(want[t])) for t in DATES if got[t] != (None if pd.isna(want[t]) else str(want[t]))}
    assert not {t: pair for t, pair in unlike.items() if t not in ("1.2", "Sun", "12", "0")}, unlike
    assert all(got[t] is None for t in unlike)
