"""Exact quantiles without holding a column's values in one task.

The built-in ``percentile`` keeps every distinct value of a column in a single
aggregation buffer. Here a mergeable sketch brackets each wanted rank, the rows below and
inside the bracket are counted exactly, and the bracket is narrowed again until it is
small enough to be sorted; a bracket that closes on one heavy value is already the answer.
Three scans (sketch, count, pick) settle billions of rows, two more a thousand times that.
Only bracket edges and counts (a few numbers per column) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.row_index import PART, SKIPPED
from plumbline.session import materialize

SKETCH_ACCURACY = 10_000
SETTLE_ROWS = 100_000


@dataclass
class _Bracket:
    """Values of ``column`` in [low, high] hold all of the wanted 0-based ranks."""

    column: str
    ranks: tuple[int, ...]
    low: float
    high: float
    below: int
    inside: int

    def holds(self, c):
        return (c >= self.low) & (c <= self.high)


def _lerp(a: float, b: float, t: float) -> float:
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = SKETCH_ACCURACY
) -> dict[str, list[float] | None]:
    """One pass, rank error at most rows / accuracy."""
    if not columns:
        return {}
    row = df.agg(
        *[
            F.percentile_approx(F.col(f"`{c}`").cast("double"), list(probs), accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: row[i] for i, c in enumerate(columns)}


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    settle_rows: int = SETTLE_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles per column, ``None`` for a column without values."""
    if not columns:
        return {}
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    names = values.columns
    margin = 2.0 / accuracy
    edges = [e for p in probs for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    first = values.agg(
        *[
            e
            for v in names
            for e in (
                F.count(v).alias(f"n_{v}"),
                F.min(v).alias(f"lo_{v}"),
                F.max(v).alias(f"hi_{v}"),
                F.percentile_approx(v, edges, accuracy).alias(f"s_{v}"),
            )
        ]
    ).first()

    sizes = {v: first[f"n_{v}"] for v in names}
    settled: list[_Bracket] = []
    wide: list[_Bracket] = []
    sketched: list[tuple[float, float]] = []
    for v in names:
        n = sizes[v]
        if n == 0:
            continue
        whole = {"column": v, "low": first[f"lo_{v}"], "high": first[f"hi_{v}"], "below": 0, "inside": n}
        if n <= settle_rows:
            settled.append(_Bracket(ranks=tuple(sorted({r for p in probs for r in _ranks(n, p)})), **whole))
            continue
        wide += [_Bracket(ranks=_ranks(n, p), **whole) for p in probs]
        sketched += [(first[f"s_{v}"][2 * i], first[f"s_{v}"][2 * i + 1]) for i in range(len(probs))]

    unsettled = _count(values, wide, sketched) if wide else []
    while unsettled := _move_settled(unsettled, settled, settle_rows):
        narrowed = _count(values, unsettled, _sketch(values, unsettled, accuracy, margin))
        # A bracket that cannot shrink holds heavy values, or the sketch missed: it is picked from counts.
        settled += [new for new, old in zip(narrowed, unsettled) if new.inside == old.inside]
        unsettled = [new for new, old in zip(narrowed, unsettled) if new.inside < old.inside]

    at_rank = _pick(values, settled, settle_rows)
    result: dict[str, list[float] | None] = {}
    for name, v in zip(columns, names):
        n = sizes[v]
        if n == 0:
            result[name] = None
            continue
        result[name] = []
        for p in probs:
            position = p * (n - 1)
            ranks = _ranks(n, p)
            result[name].append(_lerp(at_rank[v, ranks[0]], at_rank[v, ranks[-1]], position - math.floor(position)))
    return result


def _move_settled(brackets: list[_Bracket], settled: list[_Bracket], settle_rows: int) -> list[_Bracket]:
    """Moves brackets that are small or a single value to ``settled`` and returns the rest."""
    done = [b for b in brackets if b.inside <= settle_rows or b.low == b.high]
    settled += done
    return [b for b in brackets if b not in done]


def _ranks(n: int, prob: float) -> tuple[int, ...]:
    position = prob * (n - 1)
    return tuple(sorted({math.floor(position), math.ceil(position)}))


def _sketch(
    values: DataFrame, brackets: list[_Bracket], accuracy: int, margin: float
) -> list[tuple[float, float]]:
    """A tighter range around the ranks of each bracket, from one scan."""
    sketches = []
    for i, b in enumerate(brackets):
        c = F.col(b.column)
        first, last = ((r - b.below) / max(b.inside - 1, 1) for r in (b.ranks[0], b.ranks[-1]))
        edges = [max(first - margin, 0.0), min(last + margin, 1.0)]
        sketches.append(F.percentile_approx(F.when(b.holds(c), c), edges, accuracy).alias(f"s{i}"))
    row = values.agg(*sketches).first()
    return [(max(row[i][0], b.low), min(row[i][1], b.high)) for i, b in enumerate(brackets)]


def _count(values: DataFrame, brackets: list[_Bracket], tighter: list[tuple[float, float]]) -> list[_Bracket]:
    """Exact counts for the tighter ranges, from one scan."""
    counts = values.agg(
        *[
            e
            for i, (b, (low, high)) in enumerate(zip(brackets, tighter))
            for e in (
                F.count(F.when(F.col(b.column) < low, 1)).alias(f"below{i}"),
                F.count(F.when((F.col(b.column) >= low) & (F.col(b.column) <= high), 1)).alias(f"inside{i}"),
            )
        ]
    ).first()

    out = []
    for i, (b, (low, high)) in enumerate(zip(brackets, tighter)):
        below, inside = counts[f"below{i}"], counts[f"inside{i}"]
        if below <= b.ranks[0] and b.ranks[-1] < below + inside:
            out.append(_Bracket(b.column, b.ranks, low, high, below, inside))
        else:  # the sketch missed the rank: keep the proven bracket
            out.append(b)
    return out


def _pick(values: DataFrame, brackets: list[_Bracket], settle_rows: int) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks of brackets.

    Brackets of up to ``settle_rows`` rows are sorted each in one task. If one is larger, since it would
    not shrink, its values are dealt to ranges instead, whose sums give the ranks before each.
    """
    found = {(b.column, r): b.low for b in brackets if b.low == b.high for r in b.ranks}
    rest = [b for b in brackets if b.low < b.high]
    if not rest:
        return found
    some = F.lit(False)
    for b in rest:
        some = some | F.coalesce(b.holds(F.col(b.column)), F.lit(False))
    tagged = [
        F.struct(F.lit(i).alias("bracket"), F.when(b.holds(F.col(b.column)), F.col(b.column)).alias("value"))
        for i, b in enumerate(rest)
    ]
    counted = (
        values.filter(some)
        .select(F.inline(F.array(*tagged)))
        .filter(F.col("value").isNotNull())
        .groupBy("bracket", "value")
        .agg(F.count("*").alias("copies"))
    )
    if any(b.inside > settle_rows for b in rest):
        counted = materialize(counted.repartitionByRange("bracket", "value").withColumn(PART, F.spark_partition_id()), "quantiles")
        ranges = counted.groupBy("bracket", PART).agg(F.sum("copies").alias("held"))
        before = Window.partitionBy("bracket").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select("bracket", PART, F.coalesce(F.sum("held").over(before), F.lit(0)).alias(SKIPPED))
        counted = counted.join(F.broadcast(ranges), ["bracket", PART])  # one row per bracket and partition
    else:
        counted = counted.withColumns({PART: F.lit(0), SKIPPED: F.lit(0)})
    ordered = Window.partitionBy("bracket", PART).orderBy("value")
    upto = F.col(SKIPPED) + F.sum("copies").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("last_rank", upto - 1).withColumn("first_rank", F.col("last_rank") - F.col("copies") + 1)
    wanted = F.lit(False)
    for i, b in enumerate(rest):
        for r in b.ranks:
            k = r - b.below
            wanted = wanted | ((F.col("bracket") == i) & (F.col("first_rank") <= k) & (F.col("last_rank") >= k))
    for row in ranked.filter(wanted).collect():
        b = rest[row["bracket"]]
        for r in b.ranks:
            if row["first_rank"] <= r - b.below <= row["last_rank"]:
                found[b.column, r] = row["value"]
    return found


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True
) -> dict[str, list[float] | None]:
    return exact_quantiles(df, columns, probs) if exact else approx_quantiles(df, columns, probs)
