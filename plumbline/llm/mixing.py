"""Mixing overlapping sources to target weights, with repeats where a source is too small.

1. Documents are aggregated by membership pattern, the set of sources that they belong to.
2. Every source gets a target: its weight's share of the words asked for, at most ``most`` times its
   own words; what is cut off is shared again by weight until no target is above its limit.
3. A network routes words from patterns to targets. Each further repetition of a pattern costs more
   than the one before (convex), so nothing is repeated while unused words could serve instead.
4. A pattern's words become whole repetitions of all its documents and a rest. The rest is a
   selection of documents in the order of a seeded hash. Its end is found by histograms of the hash's
   digits, so documents are neither sorted nor shuffled; of up to ``WINDOW`` documents around the end
   those are taken whose sizes add up best, and behind them it goes on with documents that fit.

The driver sees one row for each pattern (their number is checked against ``MAX_PATTERNS``), histograms of 256 digits, and
the windows. Nothing else grows with the input there.

Defined cases: a null text has no words; a null source is a source of its own, after all others; a
document without sources counts for the total but is never taken; a source named twice counts once;
repeated rows are documents of their own, and of equal rows any may be the ones selected. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._columns import whole_text
from plumbline.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
SEED = 20
MAX_PATTERNS = 100_000
WINDOW = 64
SUMS = 512
#: Share of a pattern's words by which its selection may miss, if documents that fit are left.
NEAR = Fraction(1, 1000)
#: Bits of the hash and of row numbers, and how many of them a histogram counts by at a time.
HASH_BITS, ROW_BITS, DIGIT = 56, 56, 8

Source = str | None


def words(text: Column) -> Column:
    """How many runs of anything but white space a text has."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "1")
    return F.char_length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("bigint")


def targets(sizes: dict[Source, int], total: int, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[Source, Fraction]:
    """Words wanted of each source. Weights repeat over the sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    found: dict[Source, Fraction] = {}
    while True:
        open_ones = [s for s in order if s not in found]
        left = share * total - sum(found.values())
        wanted = {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        above = [s for s in open_ones if wanted[s] > most * sizes[s]]
        if not above:
            return {s: (found | wanted)[s] for s in order}
        found |= {s: Fraction(most * sizes[s]) for s in above}


@dataclass
class _Network:
    """Maximum flows by shortest augmenting paths in layers; capacities may be raised between calls."""

    size: int

    def __post_init__(self) -> None:
        self.ends: list[int] = []
        self.free: list[int] = []
        self.of: list[list[int]] = [[] for _ in range(self.size)]

    def edge(self, a: int, b: int, capacity: int) -> int:
        for start, end, free in ((a, b, capacity), (b, a, 0)):
            self.of[start].append(len(self.ends))
            self.ends.append(end)
            self.free.append(free)
        return len(self.ends) - 2

    def augment(self, source: int, sink: int) -> None:
        while True:
            depth = {source: 0}
            todo = deque([source])
            while todo:
                node = todo.popleft()
                for e in self.of[node]:
                    if self.free[e] and self.ends[e] not in depth:
                        depth[self.ends[e]] = depth[node] + 1
                        todo.append(self.ends[e])
            if sink not in depth:
                return
            tried = [0] * self.size
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    flow = min(self.free[e] for e in path)
                    for e in path:
                        self.free[e] -= flow
                        self.free[e ^ 1] += flow
                    node, path = source, []
                    continue
                while tried[node] < len(self.of[node]):
                    e = self.of[node][tried[node]]
                    if self.free[e] and depth.get(self.ends[e]) == depth[node] + 1:
                        break
                    tried[node] += 1
                else:
                    if node == source:
                        break
                    back = path.pop()
                    node = self.ends[back ^ 1]
                    tried[node] += 1
                    continue
                path.append(e)
                node = self.ends[e]


def route(sizes: dict[str, int], members: dict[str, list[Source]], quotas: dict[Source, int], most: int = MOST) -> dict[str, int]:
    """Words to take of each pattern: a flow of most words and, among those, of least cost.

    Only the edges into patterns cost anything, the r-th repetition r - 1 per word or any other growing price. A path
    of least price therefore enters by the cheapest repetition that is still open, so opening one
    repetition after the other and filling up each time gives the flow of least cost.
    """
    patterns, sources = list(sizes), list(quotas)
    start, end = len(patterns) + len(sources), len(patterns) + len(sources) + 1
    net = _Network(end + 1)
    entry = {p: net.edge(start, i, 0) for i, p in enumerate(patterns)}
    number = {s: len(patterns) + i for i, s in enumerate(sources)}
    for i, p in enumerate(patterns):
        for s in members[p]:
            net.edge(i, number[s], most * sizes[p])
    for s, quota in quotas.items():
        net.edge(number[s], end, quota)
    for _ in range(most):
        for p in patterns:
            net.free[entry[p]] += sizes[p]
        net.augment(start, end)
    return {p: net.free[entry[p] ^ 1] for p in patterns}


@dataclass
class _Cut:
    """The end of a selection among rows from (``start``, ``start_row``) on that have at most ``most`` words.

    Hashes below ``low`` go in, of those in [low, high) the rows below ``row_low``, and the chosen ones.
    """

    rest: int
    most: int
    start: int = 0
    start_row: int = 0
    low: int = 0
    high: int = 1 << HASH_BITS
    row_low: int = 0
    row_high: int = 1 << ROW_BITS
    chosen: tuple[int, ...] = ()

    def narrow(self, digits: dict[int, tuple[int, int]]) -> bool:
        """Go into the digit in which the rest ends (digit -> rows, words). True if few rows are left.

        Then digits beside it join, before and after in turn, as long as the rows stay few.
        """
        by_row = self.high - self.low == 1
        step = ((self.row_high - self.row_low) if by_row else (self.high - self.low)) >> DIGIT
        order = sorted(digits)
        first = 0
        while first < len(order) - 1 and digits[order[first]][1] <= self.rest:
            self.rest -= digits[order[first]][1]
            first += 1
        last, rows = first, digits[order[first]][0]
        done, grown = rows <= WINDOW, True
        while done and grown:
            grown = False
            if first and rows + digits[order[first - 1]][0] <= WINDOW:
                first, grown = first - 1, True
                rows += digits[order[first]][0]
                self.rest += digits[order[first]][1]
            if last < len(order) - 1 and rows + digits[order[last + 1]][0] <= WINDOW:
                last, grown = last + 1, True
                rows += digits[order[last]][0]
        if by_row:
            self.row_low, self.row_high = self.row_low + order[first] * step, self.row_low + (order[last] + 1) * step
        else:
            self.low, self.high = self.low + order[first] * step, self.low + (order[last] + 1) * step
        return done

    def choose(self, rows: list[tuple[int, int, int]], above: bool) -> int:
        """Of the last rows (hash, row, size), take those whose sizes come nearest to the rest, and return what is left of it.

        Reachable sums grow row by row; of sums in the same ``SUMS``-th of the rest one is kept. Sums ``above`` the rest count if asked for.
        """
        sums: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        for _, row, size in sorted(rows):
            for total, chain in list(sums.values()):
                if size and total + size <= (2 if above else 1) * self.rest:
                    sums.setdefault((total + size) * SUMS // self.rest, (total + size, (row, chain)))
        total, chain = min(sums.values(), key=lambda found: abs(found[0] - self.rest))
        chosen = []
        while chain:
            row, chain = chain
            chosen.append(row)
        self.chosen = tuple(chosen)
        return self.rest - total

    def after(self, rest: int) -> _Cut:
        """A selection that goes on behind this one, among rows that still fit."""
        by_row = self.high - self.low == 1
        return _Cut(rest, rest, self.low if by_row else self.high, self.row_high if by_row else 0)


_AMONG = "size <= most AND (hash > start OR hash = start AND row >= start_row)"
_CUT = "start bigint, start_row bigint, most bigint, low bigint, high bigint, row_low bigint"


def _inside(narrow: DataFrame, cuts: dict[str, _Cut]) -> DataFrame:
    """The rows at the ends of the selections. ``cuts`` has one row per pattern at most."""
    rows = [(p, c.start, c.start_row, c.most, c.low, c.high, c.row_low, c.row_high) for p, c in cuts.items()]
    frame = narrow.sparkSession.createDataFrame(rows, f"pattern string, {_CUT}, row_high bigint")
    return narrow.join(F.broadcast(frame), "pattern").where(f"{_AMONG} AND hash >= low AND hash < high AND row >= row_low AND row < row_high")


def _ends(narrow: DataFrame, rests: dict[str, int], near: dict[str, int]) -> dict[str, list[_Cut]]:
    """Where the selection of each pattern ends; one pass over (pattern, size, hash, row) per digit.

    Where documents too long for the rest stand at the end, the selection goes on behind them, until the rest
    is ``near`` or no document fits.
    """
    cuts = {pattern: [_Cut(rest, 1 << 62)] for pattern, rest in rests.items()}
    todo = {pattern: found[0] for pattern, found in cuts.items()}
    last: dict[str, list[tuple[int, int, int]]] = {}
    places = 1 << DIGIT
    digit = F.expr(
        f"CASE WHEN high - low = 1 THEN (row - row_low) DIV greatest(1, (row_high - row_low) DIV {places}) ELSE (hash - low) DIV greatest(1, (high - low) DIV {places}) END"
    )
    while todo:
        counted = _inside(narrow, todo).groupBy("pattern", digit.cast("int").alias("digit")).agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
        digits: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counted.collect():
            digits.setdefault(r["pattern"], {})[r["digit"]] = (r["rows"], r["size"])
        for pattern in set(todo).difference(digits):  # no document fits any more: the last ones may go beyond the rest
            todo.pop(pattern)
            cuts[pattern].pop()
            cuts[pattern][-1].choose(last[pattern], True)
        few = {pattern: cut for pattern, cut in todo.items() if cut.narrow(digits[pattern])}
        if few:
            found: dict[str, list[tuple[int, int, int]]] = {}
            for r in _inside(narrow, few).select("pattern", "hash", "row", "size").collect():
                found.setdefault(r["pattern"], []).append((r["hash"], r["row"], r["size"]))
            for pattern, cut in few.items():
                del todo[pattern]
                last[pattern] = found[pattern]
                left = cut.choose(last[pattern], True)
                if abs(left) > near[pattern]:
                    left = cut.choose(last[pattern], False)
                    todo[pattern] = cut.after(left)
                    cuts[pattern].append(todo[pattern])
    return cuts


def mix(
    docs: DataFrame,
    members: str | Column,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    most: int = MOST,
    seed: int = SEED,
) -> tuple[DataFrame, dict[Source, tuple[int, Fraction]]]:
    """Rows (key, members, size, copies) of all documents, and (size, target) of each source.

    ``members`` is an array of the sources that a document belongs to.
    """
    body, belongs = whole_text(text), F.col(members) if isinstance(members, str) else members
    belongs = F.array_sort(F.array_distinct(F.coalesce(belongs, F.array().cast("array<string>"))))
    shown = F.to_json(belongs)
    narrow = docs.select(
        F.col(f"`{key}`").alias("key"),
        belongs.alias("members"),
        shown.alias("pattern"),
        words(body).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), body), 64 - HASH_BITS).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = materialize(narrow, "mix")
    rows = narrow.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"documents have more than {MAX_PATTERNS} different sets of sources")
    sizes = {r["pattern"]: r["size"] for r in rows}
    belong = {pattern: json.loads(pattern) for pattern in sizes}
    of_source: dict[Source, int] = {}
    for pattern, sources in belong.items():
        for source in sources:
            of_source[source] = of_source.get(source, 0) + sizes[pattern]
    wanted = targets(of_source, sum(sizes.values()), weights, share, most) if of_source else {}
    flows = route(sizes, belong, {source: round(target) for source, target in wanted.items()}, most)
    whole = {p: divmod(flows[p], sizes[p]) if sizes[p] else (0, 0) for p in sizes}
    cuts = _ends(narrow, {p: rest for p, (_, rest) in whole.items() if rest}, {p: int(NEAR * flow) for p, flow in flows.items()})
    plan = [
        (p, n, [(c.start, c.start_row, c.most, c.low, c.high, c.row_low) for c in cuts.get(p, [])], [row for c in cuts.get(p, []) for row in c.chosen])
        for p, (n, _) in whole.items()
    ]
    frame = narrow.sparkSession.createDataFrame(plan, f"pattern string, n int, cuts array<struct<{_CUT}>>, chosen array<bigint>")
    goes_in = F.expr(
        "exists(cuts, c -> size <= c.most AND (hash > c.start OR hash = c.start AND row >= c.start_row) AND (hash < c.low OR hash < c.high AND row < c.row_low))"
    )
    taken = goes_in | F.array_contains("chosen", F.col("row"))
    mixed = narrow.join(F.broadcast(frame), "pattern").select("key", "members", "size", (F.col("n") + taken.cast("int")).alias("copies"))
    return mixed, {source: (of_source[source], wanted[source]) for source in wanted}
