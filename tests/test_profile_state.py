"""Merged profile states against the table itself."""

import math
import random
import statistics

from plumbline.functions import null_if_nan
from plumbline.operators import profile
from plumbline.operators import profile_state as ps


def _table(spark, n=6000):
    rng = random.Random(8)
    rows = [(f"f{i % 7}" if i % 3 else "big", rng.choice([None, "a", "b", ""]), rng.choice([None, float("nan"), rng.gauss(50, 9), 1e4]) if i % 20 == 0 else rng.gauss(50, 9), i % 50) for i in range(n)]
    return spark.createDataFrame(rows + rows[:300], "path string, t string, x double, k int")


def test_merged_states_equal_the_table(spark):
    df = _table(spark)
    states = ps.profile_states(df, ["path"])
    assert states.count() == 4 * df.select("path").distinct().count()
    found = {r["column"]: r for r in ps.merged_profile(states).collect()}
    rows = df.drop("path").collect()
    numbers = sorted(r["x"] for r in rows if r["x"] is not None and not math.isnan(r["x"]))
    x = found["x"]
    assert {r["rows"] for r in found.values()} == {len(rows)}
    assert (x["numbers"], x["missing"], x["least"], x["most"]) == (len(numbers), len(rows) - len(numbers), numbers[0], numbers[-1])
    assert abs(x["mean"] - statistics.fmean(numbers)) < 1e-6 and abs(x["std"] / statistics.stdev(numbers) - 1) < 1e-6
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        rank = sum(v <= x[name] for v in numbers) / len(numbers)
        assert abs(rank - share) <= ps.RANK_ERROR
    outside = sum(not x["low_fence"] <= v <= x["high_fence"] for v in numbers)
    assert abs(x["outliers"] - outside) <= 2 * ps.RANK_ERROR * len(numbers)
    assert found["t"]["numbers"] == 0 and found["t"]["outliers"] is None and found["t"]["mean"] is None
    assert found["k"]["different"] == 50
    missing = {r["column"]: r["missing_count"] for r in profile.missing_values(df.drop("path")).collect()}
    assert {c: r["missing"] for c, r in found.items() if c != ps.ROWS and r["missing"]} == {c: n for c, n in missing.items() if n}


def test_merging_in_steps_and_by_group(spark):
    df = _table(spark)
    states = ps.profile_states(df, ["path"])
    by_file = {(r["path"], r["column"]): r for r in ps.merged_profile(states, ["path"]).collect()}
    for path in ("big", "f1"):
        direct = {r["column"]: r for r in ps.merged_profile(ps.profile_states(df.where(df.path == path).drop("path"), [])).collect()}
        assert all(by_file[path, c]["rows"] == r["rows"] and by_file[path, c]["missing"] == r["missing"] and by_file[path, c]["most"] == r["most"] for c, r in direct.items())
    score = ps.merged_quality(ps.merged_profile(states)).first()
    plain = null_if_nan(df.drop("path"))
    real = profile.quality_facts(plain).first()
    assert (score["total_rows"], score["total_cells"], score["missing_cells"]) == (real["total_rows"], real["total_cells"], real["missing_cells"])
    assert abs(score["duplicate_rows"] - real["duplicate_rows"]) <= 2 * ps.DISTINCT_ERROR * real["total_rows"]
    assert abs(score["quality_score"] - profile.quality_score(plain).first()[0]) <= 3


def test_an_empty_table_has_no_states(spark):
    df = _table(spark, 10)
    states = ps.profile_states(df.limit(0), ["path"])
    assert states.count() == 0 and ps.merged_profile(states).count() == 0 and ps.merged_quality(ps.merged_profile(states, ["path"]), ["path"]).count() == 0
