import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import association, breakdown, coercion, profile, roles
from plumbline.operators.distinct import distinct_counts
from plumbline.operators.quantiles import exact_quantiles


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_profile_of_small_table(t_profile):
    missing = profile.missing_values(t_profile).collect()
    assert [(r.column, r.missing_count, r.missing_pct) for r in missing] == [("revenue", 1, 16.67)]
    assert profile.duplicate_rows(t_profile).first()[0] == 0
    assert [(r.column, r.outlier_count) for r in profile.iqr_outliers(t_profile).collect()] == [("revenue", 1)]
    report = profile.quality_report(t_profile).first()
    assert report.total_rows == 6
    assert report.suggestions == ["Impute or drop missing values in: revenue", "Review outliers detected via IQR in: revenue"]


def test_statistics_equal_pandas(t_profile):
    stats = rows(profile.column_stats(t_profile), "column")
    pdf = t_profile.toPandas()
    for c in ("revenue", "orders"):
        s = pdf[c].dropna()
        want = (s.count(), s.mean(), s.std(), s.min(), s.quantile(0.25), s.median(), s.quantile(0.75), s.max())
        got = stats[c]
        assert (got["count"], *[got[k] for k in ("mean", "std", "min", "q25", "median", "q75", "max")]) == tuple(round(float(w), 4) for w in want)


def test_duplicates_count_nulls_as_equal(spark, t_profile):
    repeated = t_profile.unionByName(t_profile.filter("revenue IS NULL")).unionByName(t_profile.limit(1))
    assert profile.duplicate_rows(repeated).first()[0] == 2
    long = spark.createDataFrame([("x" * 100,), ("x" * 100,), ("x" * 101,)], "t string")
    assert profile.duplicate_rows(long).first()[0] == 1


def test_quality_score(spark):
    clean = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "a bigint, b bigint")
    assert profile.quality_score(clean).first()[0] == 100
    assert profile.quality_suggestions(clean).first().suggestion == profile.NO_ISSUES
    empty = clean.limit(0)
    assert profile.quality_score(empty).first()[0] == 0
    kpis = breakdown.kpi_summary(empty).first()
    assert (kpis.row_count, kpis.completeness, kpis.quality_score) == (0, 0.0, 0)


def test_outlier_term_of_score_is_scaled(spark):
    values = [float(v) for v in range(99)] + [1e6]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i bigint")
    # One outlier in 200 cells: 100 - 25 * 100 / 200.
    assert profile.quality_score(df).first()[0] == round(100 - 2500 / 200)


@pytest.mark.parametrize("settle, accuracy", [(10**9, 10_000), (50, 100), (5, 20), (1, 3)])
def test_exact_quantiles_with_heavy_values(spark, settle, accuracy):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {
            "skewed": rng.lognormal(0, 3, 4000),
            "third": np.where(rng.random(4000) < 0.35, 7.0, rng.integers(0, 50, 4000)),
            "constant": np.full(4000, 2.5),
            "gaps": np.where(rng.random(4000) < 0.5, np.nan, rng.normal(0, 1, 4000)),
        }
    )
    df = spark.createDataFrame(pdf).repartition(3)
    df = df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in df.columns])
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, df.columns, probs, settle_rows=settle, accuracy=accuracy)
    for c in pdf:
        assert got[c] == pytest.approx([pdf[c].quantile(p) for p in probs], rel=1e-9), c


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": None, "b": [1.0]}


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(10, 4, 500).round(2), "few": rng.integers(0, 4, 500), "one": [3] * 500})
    found = profile.histogram(spark.createDataFrame(pdf)).orderBy("column", "bin").toPandas()
    for c, bins in (("x", 10), ("few", 4), ("one", 1)):
        counts, edges = np.histogram(pdf[c].to_numpy(dtype=float), bins=bins)
        part = found[found["column"] == c]
        assert part["count"].tolist() == counts.tolist()
        assert part["start"].tolist() == [round(float(e), 3) for e in edges[:-1]]
        assert part["end"].tolist() == [round(float(e), 3) for e in edges[1:]]


def test_categories_label_missing_and_break_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "k string")
    assert [tuple(r) for r in profile.category_distribution(df, k=2).orderBy(F.desc("count"), "value").collect()] == [("k", "a", 2), ("k", "b", 2)]
    assert ("k", "—", 1) in [tuple(r) for r in profile.category_distribution(df).collect()]


def test_correlation_equals_pandas_with_gaps_and_constants(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(1e6, 1, 300)
    pdf = pd.DataFrame({"a": base, "b": -base + rng.normal(0, 0.5, 300), "c": rng.normal(0, 1, 300), "flat": np.full(300, 0.1)})
    pdf.loc[rng.random(300) < 0.3, "b"] = np.nan
    pdf.loc[rng.random(300) < 0.3, "c"] = np.nan
    pdf["subset"] = np.where(pdf["b"].isna(), rng.normal(0, 1, 300), 0.3)  # constant wherever b has a value
    df = spark.createDataFrame(pdf)
    df = df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in df.columns])
    found = rows(association.correlation_matrix(df), "a", "b")
    want = pdf.corr()
    assert len(found) == 25
    for a in pdf:
        for b in pdf:
            expected = want.loc[a, b]
            if "flat" in (a, b) or {a, b} == {"b", "subset"}:
                assert found[a, b]["corr"] is None
            else:
                assert found[a, b]["corr"] == pytest.approx(expected, abs=1e-4)


def test_roles_and_choices(t_sales):
    prepared = coercion.prepare(t_sales)
    assert dict(prepared.dtypes)["date"] == "timestamp"
    found = roles.Roles.of(prepared)
    assert (found.measures, found.dimensions, found.dates) == (("revenue", "orders"), ("region", "product"), ("date",))
    assert roles.pick_measure(prepared) == "revenue"
    assert roles.pick_measure(prepared, "how many orders") == "orders"
    assert roles.pick_dimension(prepared) == "product"
    assert roles.pick_dimension(prepared, "by region please") == "region"
    assert roles.geo_dimension(found.dimensions) == "region"


def test_constant_and_unique_texts_are_no_dimensions(spark):
    df = spark.createDataFrame([("same", f"id{i}", f"g{i % 3}") for i in range(200)], "a string, b string, c string")
    assert roles.Roles.of(df).dimensions == ("c",)
    assert distinct_counts(df, ["a", "b", "c"], lambda n, d: True) == (200, {"a": 1, "b": 200, "c": 3})


def test_hints_match_within_names():
    assert roles.hinted_measure(["o_totalprice", "discount"]) == "o_totalprice"
    assert roles.hinted_measure(["x", "discount"]) == "discount"
    assert roles.mentioned("the unit price of it", ["price", "unit price"]) == "unit price"


def test_coercion_thresholds(spark):
    data = [("1", "2024-01-01", "a", "1"), ("2", "x", "b", "2"), ("x", "2024-01-03", "c", "3"), ("4", "2024-01-04", "d", "4"), ("5", "y", "e", None)]
    df = spark.createDataFrame(data, "n string, day string, plain string, full string")
    assert coercion.coercion_plan(df) == {"n": "number", "day": "date", "full": "number"}


def test_breakdown_rules(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None), (None, 100.0), ("c", 5.0), ("d", -10.0)], "k string, v double")
    found = [tuple(r) for r in breakdown.breakdown(df, "k", "v").orderBy(F.desc("value"), "name").collect()]
    # The total of the shown groups is 0 and counts as 1; null keys are dropped; an all-null group is 0.
    assert found == [("a", 5.0, 500.0), ("c", 5.0, 500.0), ("b", 0.0, 0.0), ("d", -10.0, -1000.0)]


def test_segmentation_needs_four_quartiles(spark):
    even = spark.range(100).withColumnRenamed("id", "v")
    assert [(r.segment, r.records) for r in breakdown.segmentation(even, "v").collect()] == [("Low", 25), ("Medium", 25), ("High", 25), ("Top", 25)]
    heavy = even.select(F.when(F.col("v") < 60, 1).otherwise(F.col("v")).alias("v"))
    assert breakdown.segmentation(heavy, "v").count() == 0
    three = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    assert breakdown.segmentation(three, "v").count() == 0


def test_segmentation_reads_its_input_once(spark):
    """An input of joins is costly; only the measure is kept of it."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 400, 1, 2).selectExpr("CAST(id AS DOUBLE) AS v", "id").mapInArrow(counted, "v double, id bigint")
    assert [(r.segment, r.records) for r in breakdown.segmentation(rows, "v").collect()] == [("Low", 100), ("Medium", 100), ("High", 100), ("Top", 100)]
    assert seen.value == 400
