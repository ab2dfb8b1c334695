"""Line deduplication by a segment-partition edit join.

Lines of ``MIN_CHARS`` or more that are within ``EDITS`` edits of each other are linked, and linked
lines form classes. A line goes only if it equals, or is within ``EDITS`` edits of, a line that stays: links
may chain from text to quite different text. Of a class the line with most links stays (of equally many
the one whose first document comes first), once, where it stands first; lines within its reach go. Those
out of reach are tried in the same order: each stays, once, if no line that stays before it is within
reach. Lines of fewer characters have no links; of equal ones that are not blank the first stays.

1. Equal lines become one, within batches before the shuffle. The text travels once.
2. Each different line is indexed by its segments and probes for lines that are up to ``EDITS``
   shorter; only hashes travel. Keys under which no two lines meet are dropped.
3. Lines that meet fetch their text and are verified by a banded bit-parallel distance. A pair is
   counted under the first key it shares, so no pair is counted twice and none has to be listed:
   a task gives the number of links per line and enough links to join them.
4. Classes come from connected components. Every line is held against its class's best line where it is;
   those out of its reach are tried among each other, up to ``CELL`` of a class in one task. Of larger classes
   the links between them are listed, and rounds over these settle each line once those before it are settled.
5. Documents look up their lines.

A key that holds more than ``CELL`` lines is cut into cells of pairs of blocks, so that no task holds
or compares more than a cell, and none is left out. ``CELL`` decides how the work is dealt out, never which lines stay.

Defined cases: null and empty texts have no lines that could go; a null doc_id comes last; rows that
share a doc_id count as one document, of which each row keeps its first copy of a line that stays; an empty
table gives no rows; input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._columns import named, other_columns, whole_text
from plumbline.llm.components import connected_components
from plumbline.llm.edit_join import code, common_probe, keys_of, segments, within
from plumbline.session import materialize

EDITS = 2
MIN_CHARS = 24
CELL = 2_000
_REPEATED = 1 << 20  # the code of a line that occurs more than once
_LAST = (1 << 63) - 1  # the place in order of a null doc_id


_LINES = [("h", pa.int64()), ("line", pa.string()), ("n", pa.int64()), ("first", pa.int64())]


def _lines():
    """Different lines of each batch, with a hash, their number and first document."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line in text.split("\n"):
                    if line.strip():
                        if line in seen:
                            seen[line][0] += 1
                            seen[line][1] = min(seen[line][1], doc)
                        else:
                            seen[line] = [1, doc]
            hashes = np.array([xxh3_64_intdigest(line.encode()) for line in seen], dtype=np.uint64).view(np.int64)
            columns = [hashes, list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _LINES)], names=[n for n, _ in _LINES])

    return run


def _keys(k: int, least: int):
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                keys, lines, codes = [], [], []
                for h, line, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    before = len(keys)
                    for length, segment, kind, part in keys_of(line, k, least) if len(line) >= least else ():
                        keys.append(xxh3_64_intdigest(part.encode(), length * (k + 1) + segment))
                        codes.append(kind)
                    if n > 1:
                        keys.append(h & 0xFFFFFFFFFFFFFFFF)
                        codes.append(_REPEATED)
                    lines += [h] * (len(keys) - before)
                columns = [np.array(keys, dtype=np.uint64).view(np.int64), np.array(lines, dtype=np.int64), np.array(codes, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "h", "code"])

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key holds an index entry and another line. Keys of any size stream by."""
    held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32)]
    passed = None  # a key that is known to hold many lines

    def kept(rows: list[np.ndarray], mask: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[mask]) for c in rows], names=["key", "h", "code"])

    def judge(rows: list[np.ndarray], passed) -> np.ndarray:
        key, h, kind = rows
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        joins = kind != _REPEATED
        several = np.minimum.reduceat(h, start) != np.maximum.reduceat(h, start)
        good = several & np.logical_or.reduceat(kind < 0, start)
        good |= key[start] == passed if passed is not None else False
        return np.repeat(good, np.diff(np.r_[start, len(key)])) & joins | ~joins

    for batch in batches:
        rows = [np.concatenate([a, batch.column(i).to_numpy(zero_copy_only=False)]) for i, a in enumerate(held)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
        complete, held = [r[:last] for r in rows], [r[last:] for r in rows]
        if last:
            yield kept(complete, judge(complete, passed))
        if len(held[0]) > 100_000 or held[0][0] == passed:
            passed = held[0][0]
            yield kept(held, np.ones(len(held[0]), dtype=bool))
            held = [r[:0] for r in held]
    if len(held[0]):
        yield kept(held, judge(held, passed))


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])
_ROWS = 256  # lines of a cell whose distances from all others are held at once
_CHUNK = 10_000  # rows of a batch that is given on


def _sign_counts(lines: list[str]) -> np.ndarray:
    counts = np.zeros((len(lines), 64))  # doubles keep the products below exact
    for row, line in zip(counts, lines):
        row[:] = np.bincount(np.frombuffer(line.encode("utf-32-le"), dtype="<u4") % 64, minlength=64)
    return counts


def _alike(a: list[str], b: list[str], k: int) -> Iterator[tuple[int, int]]:
    """Places of pairs that ``k`` edits may join. An edit moves two counts of signs by one, so the squared
    distance of the counts is at most twice ``k`` squared; one matrix product tells it for all pairs of a cell."""
    if len(a) * len(b) < 2_000:
        yield from ((i, j) for i in range(len(a)) for j in range(len(b)))
        return
    x, y = _sign_counts(a), _sign_counts(b)
    own, other = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :]
    for at in range(0, len(a), _ROWS):
        apart = own[at : at + _ROWS] + other - 2 * (x[at : at + _ROWS] @ y.T)
        for i, near in enumerate(apart <= 2 * k * k + 0.5, at):
            yield from ((i, j) for j in np.flatnonzero(near).tolist())


def _linked(rows: list[tuple], k: int) -> Iterator[tuple[bytes, bytes]]:
    """The links between the lines of a key and cell, under the first key that both sides share."""
    indexed = [r for r in rows if r[2] < 0 and r[5] != 1]  # of a cell: role 0 both, 1 probing, 2 indexed
    probing = [r for r in rows if r[5] != 2]
    for i, j in _alike([r[4] for r in indexed], [r[4] for r in probing], k):
        _, _, kind, a, a_line, _ = indexed[i]
        _, _, other, b, b_line, _ = probing[j]
        if a == b or len(b_line) < len(a_line) or (len(a_line) == len(b_line) and a > b):
            continue
        segment = -1 - kind
        home = segments(len(a_line), k)[segment][0]
        if len(b_line) == len(a_line) and other < 0:
            start = home
        elif other >= 0:
            start = other - code(segment, home, home, k) + home
        else:
            continue  # an index entry under the same hash, of another length
        if common_probe(a_line, b_line, k) == (segment, start) and within(a_line, b_line, k):
            yield a, b


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each key and cell that holds several."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[:2] != held[-1][:2]:
                if len(held) > 1:
                    yield held
                held = []
            held.append(row)
    if len(held) > 1:
        yield held


def _verify(k: int):
    """Links of the lines of each key and cell: rows (a, b, 0) that join them, and (a, null, n) with their number."""

    def compare(rows: list[tuple]) -> list[dict]:
        counts: dict[bytes, int] = {}
        root: dict[bytes, bytes] = {}
        out = []

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in _linked(rows, k):
            counts[a] = counts.get(a, 0) + 1
            counts[b] = counts.get(b, 0) + 1
            x, y = find(a), find(b)
            if x != y:
                root[x] = y
                out.append({"a": a, "b": b, "n": 0})
        return out + [{"a": x, "b": None, "n": n} for x, n in counts.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _by_cell(batches):
            out += compare(rows)
            if len(out) >= _CHUNK:
                yield pa.RecordBatch.from_pylist(out, schema=_LINKS)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=_LINKS)

    return run


def _listed(k: int):
    """(a, b) of all links of the lines of each key and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = (link for rows in _by_cell(batches) for link in _linked(rows, k))
        while some := list(islice(links, _CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*some)], names=["a", "b"])

    return run


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """Rows with the cell and the role they have in it. A key of many lines gets a cell for each pair of its blocks."""
    large = rows.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > cell)
    if not large.take(1):
        return rows.select("key", F.lit(0).cast("long").alias("cell"), "code", "id", "line", F.lit(0).alias("role"))
    blocks = F.ceil(F.col("many") / cell).cast("long")
    block = F.pmod(F.xxhash64("id"), blocks)
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    probing = F.transform(every, lambda i: F.struct((i * blocks + block).alias("cell"), F.lit(1).alias("role")))
    indexed = F.transform(every, lambda i: F.struct((block * blocks + i).alias("cell"), F.lit(2).alias("role")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("role")))
    places = F.when(F.col("many").isNull(), alone).when(F.col("code") < 0, F.concat(probing, indexed)).otherwise(probing)
    placed = rows.join(large, "key", "left").withColumn("place", F.explode(places))
    return placed.select("key", F.col("place.cell").alias("cell"), "code", "id", "line", F.col("place.role").alias("role"))


def _tried(k: int):
    """(id, stay) of lines that come by class, best first: the line that stays within whose reach each one is, or itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stay, signs = None, [], np.zeros((64, 64))
        for batch in batches:
            ids, found = [], []
            for root, key, line in zip(*[c.to_pylist() for c in batch.columns[:3]]):
                if root != group:
                    group, stay = root, []
                own = _sign_counts([line])[0]
                near = np.flatnonzero(((signs[: len(stay)] - own) ** 2).sum(axis=1) <= 2 * k * k).tolist()
                reached = next((stay[i][0] for i in near if within(stay[i][1], line, k)), None)
                if reached is None:
                    if len(stay) == len(signs):
                        signs = np.concatenate([signs, np.zeros_like(signs)])
                    signs[len(stay)] = own
                    stay.append((key, line))
                ids.append(key)
                found.append(key if reached is None else reached)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.binary())], names=["id", "stay"])

    return run


def _reached(k: int):
    """Rows (id, line, best line) → (id, reached)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within(a, b, k) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], pa.array(near, pa.bool_())], names=[*_MEMBER, "reached"])

    return run


_MEMBER = ["id", "line", "root", "best", "order", "many"]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, stays) of the lines that can be settled, from rows (root, id, before, known) by class, best first: a line goes if one
    before it that is near stays, and stays if all of those go. ``known``: what earlier rounds say of ``before``."""
    here: dict[bytes, bool] = {}  # what this task says of lines of the class
    group, line, stays = None, None, True
    for batch in batches:
        out = []
        for root, own, before, known in zip(*[c.to_pylist() for c in batch.columns[:4]]):
            if own != line:
                if line is not None and stays is not None:
                    here[line] = stays
                    out.append((line, stays))
                if root != group:
                    group, here = root, {}
                line, stays = own, True
            if before is not None and stays is not False:
                near = here.get(before) if known is None else known
                stays = False if near else None if near is None else stays
        yield _settled_batch(out)
    yield _settled_batch([(line, stays)] if line is not None and stays is not None else [])


def _settled_batch(rows: list[tuple[bytes, bool]]) -> pa.RecordBatch:
    ids, stays = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(stays, pa.bool_())], names=["id", "stays"])


def _settled(rest: DataFrame, met: DataFrame, edits: int, cell: int) -> DataFrame:
    """(id, stay) of the lines ``rest`` (id, root, order), by their listed links.

    Each round settles all lines whose near ones before them are settled, by earlier rounds or in the same range of the order.
    The first range of a class is always settled, so rounds end; links that are settled go."""
    rows = met.where(F.col("code") != _REPEATED).join(rest.select("id"), "id", "left_semi")
    cells = _cells(rows, cell).repartition("key", "cell").sortWithinPartitions("key", "cell")
    links = cells.select("key", "cell", "code", "id", "line", "role").mapInArrow(_listed(edits), "a binary, b binary")
    orders = [rest.select(F.col("id").alias(side), F.col("order").alias(f"{side}_order")) for side in ("a", "b")]
    a, b = (F.struct(F.col(f"{side}_order").alias("order"), F.col(side).alias("id")) for side in ("a", "b"))
    ends = links.join(orders[0], "a").join(orders[1], "b").select(F.greatest(a, b).alias("own"), F.least(a, b).alias("near"))
    pairs = materialize(ends.select(F.col("own.id").alias("id"), F.col("near.id").alias("before"), F.col("near.order").alias("before_order")), "far-links")
    left = rest.join(pairs.select("id", "before"), "id", "left").withColumn("known", F.lit(None).cast("boolean"))
    found = None
    while True:
        left = materialize(left.select("root", "id", "before", "known", "order"), "far-left")
        if not left.take(1):
            break
        by_order = left.repartitionByRange("root", "order").sortWithinPartitions("root", "order")
        round_ = materialize(by_order.mapInArrow(_judged, "id binary, stays boolean"), "far-settled")
        found = round_ if found is None else found.union(round_)
        news = round_.select(F.col("id").alias("before"), F.col("stays").alias("news"))
        left = left.join(round_, "id", "left_anti").join(news, "before", "left").withColumn("known", F.coalesce("known", "news"))
    stay = found.where("stays").select(F.col("id").alias("before"))
    gone = pairs.join(stay, "before").groupBy("id").agg(F.min_by("before", "before_order").alias("stay"))
    return stay.select(F.col("before").alias("id"), F.col("before").alias("stay")).union(gone)


def _stays(members: DataFrame, met: DataFrame, edits: int, cell: int) -> DataFrame:
    """(id, stay) of every line of a class of several: the line for which it goes, or itself. ``members``: id, line, root, order;
    ``met``: the keys of all lines."""
    best = members.groupBy("root").agg(F.min_by(F.struct("id", "line"), "order").alias("top"), F.count("*").alias("many"))
    best = materialize(best.select(F.col("root").alias("of"), F.col("top.id").alias("best"), F.col("top.line").alias("best_line"), "many"), "best-lines")
    beside = members.join(best, F.col("root") == F.col("of")).select("id", "line", "best_line", "root", "best", "order", "many")
    kinds = dict(members.dtypes)
    judged = materialize(
        beside.mapInArrow(_reached(edits), f"id binary, line string, root binary, best binary, order {kinds['order']}, many bigint, reached boolean"), "reached-lines"
    )
    rest, done = judged.where(~F.col("reached")), judged.where("reached").select("id", F.col("best").alias("stay"))
    # A row per class of many lines out of reach, written so that its size is known where it meets them.
    large = rest.groupBy(F.col("root").alias("of")).agg(F.count("*").alias("far")).where(F.col("far") > cell)
    large = materialize(large.select("of"), "far-classes")
    if large.take(1):
        far = rest.join(large, F.col("root") == F.col("of"), "left_semi").select("id", "root", "order")
        done = done.union(_settled(materialize(far, "far-lines"), met, edits, cell))
        rest = rest.join(large, F.col("root") == F.col("of"), "left_anti")
    ordered = rest.select("root", "id", "line", "order").repartition("root").sortWithinPartitions("root", "order")
    return done.union(ordered.mapInArrow(_tried(edits), "id binary, stay binary"))


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, cell: int = CELL) -> DataFrame:
    """``id`` (digest) of each line that repeats or has links, ``stay`` (the line for which it goes, or itself), ``first`` (the
    first document that holds that line), ``root`` (its class) and ``links`` (different lines within ``edits``). ``docs``: ``place``, ``text``."""
    schema = "h bigint, line string, n bigint, first bigint"
    # The filter is what the join below would put there: with it, both uses share one exchange of the text.
    lines = docs.select("place", "text").mapInArrow(_lines(), schema).where(F.col("h").isNotNull())
    different = lines.repartition("h").groupBy("h", "line").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    keys = different.select("h", "line", "n", "first").mapInArrow(_keys(edits, least), "key bigint, h bigint, code int")
    meeting = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_meeting, "key bigint, h bigint, code int")
    line_id = F.unhex(F.md5(F.col("line").cast("binary"))).alias("id")
    met = materialize(meeting.join(different, "h").select("key", "code", line_id, "line", "n", "first"), "lines")
    cells = _cells(met.where(F.col("code") != _REPEATED), cell).repartition("key", "cell").sortWithinPartitions("key", "cell")
    links = materialize(
        cells.select("key", "cell", "code", "id", "line", "role").mapInArrow(_verify(edits), "a binary, b binary, n bigint"), "line-links"
    )
    groups = connected_components(links.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "id")
    counts = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    facts = materialize(
        met.groupBy("id").agg(F.first("line").alias("line"), F.first("n").alias("n"), F.first("first").alias("first"))
        .join(groups, "id", "left")
        .join(counts, "id", "left")
        .select("id", "line", "n", "first", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")),
        "line-facts",
    )
    linked = facts.where("links > 0")
    stays = _stays(linked.select("id", "line", "root", F.struct(-F.col("links"), "first", "id").alias("order")), met, edits, cell)
    alone = facts.where("links = 0 AND n > 1").select("id", "root", "links", "id", "first").toDF("id", "root", "links", "stay", "first")
    firsts = linked.select(F.col("id").alias("stay"), "first")
    near = linked.select("id", "root", "links").join(stays, "id").join(firsts, "stay").select("id", "root", "links", "stay", "first")
    return near.union(alone)


def _occurrences():
    schema = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("at", pa.int32()), ("id", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, place, text in zip(*[c.to_pylist() for c in batch.columns]):
                for at, line in enumerate(text.split("\n")):
                    if line.strip():
                        rows.append((key, place, at, hashlib.md5(line.encode(), usedforsecurity=False).digest()))
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _row_key(text: Column, key: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), text)


def line_decisions(docs: DataFrame, text: str = "text", key: str = "doc_id", edits: int = EDITS, least: int = MIN_CHARS, cell: int = CELL) -> DataFrame:
    """Of rows that hold a line with a class: ``row_key``, ``removed`` (numbers of the lines that go, from
    0), ``sources`` (for each of them the document whose line stays) and ``n_links`` (of its different lines)."""
    body = whole_text(text)
    rows = docs.select(_row_key(body, key).alias("key"), F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_LAST)).alias("place"), body.alias("text"))
    classes = materialize(line_classes(rows, edits, least, cell), "line-classes")
    seen = rows.mapInArrow(_occurrences(), "key bigint, place bigint, at int, id binary").join(classes, "id")
    by_row = seen.groupBy("key", "place").agg(F.collect_set(F.struct("at", "id", "stay", "first", "links")).alias("lines"))
    return by_row.mapInArrow(_decide, "row_key bigint, removed array<int>, sources array<bigint>, n_links bigint")


_DECISIONS = pa.schema([("row_key", pa.int64()), ("removed", pa.list_(pa.int32())), ("sources", pa.list_(pa.int64())), ("n_links", pa.int64())])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, place, lines in zip(*[c.to_pylist() for c in batch.columns]):
            kept, removed, sources, links = set(), [], [], {}
            for line in sorted(lines, key=lambda x: x["at"]):
                links[line["id"]] = line["links"]
                if line["id"] == line["stay"] and line["first"] == place and line["id"] not in kept:
                    kept.add(line["id"])
                else:
                    removed.append(line["at"])
                    sources.append(None if line["first"] == _LAST else line["first"])
            rows.append({"row_key": key, "removed": removed, "sources": sources, "n_links": sum(links.values())})
        yield pa.RecordBatch.from_pylist(rows, schema=_DECISIONS)


RESULTS = ("n_lines", "removed", "sources", "n_links")


def mark_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``n_lines``, ``removed``, ``sources`` and ``n_links``, see ``line_decisions``."""
    decisions = line_decisions(docs, text, key, **options)
    body = whole_text(text)
    kept = other_columns(docs, RESULTS)
    rows = docs.select(F.struct(*named(kept)).alias("__doc"), _row_key(body, key).alias("row_key"), F.size(F.split(body, "\n")).alias("n_lines"))
    none = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    return rows.join(decisions, "row_key", "left").select(
        *[F.col("__doc")[name].alias(name) for name in kept],
        "n_lines",
        F.coalesce("removed", none[0]).alias("removed"),
        F.coalesce("sources", none[1]).alias("sources"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", size: str = "n_chars", **options) -> DataFrame:
    """``docs`` without the lines that go, and without documents of which no line is left. Columns stay; the
    column ``size``, if there is one, counts the characters of a text that lost lines."""
    marked = mark_lines(docs, text, key, **options)
    body = F.col(f"`{text}`")
    left = F.filter(F.split(body, "\n"), lambda _, i: ~F.array_contains("removed", i))
    cut = marked.where(F.size("removed") < F.col("n_lines")).withColumn(text, F.when(F.size("removed") > 0, F.array_join(left, "\n")).otherwise(body))
    names = [name for name in docs.columns if name in other_columns(docs, RESULTS)]
    counted = F.when(F.size("removed") > 0, F.char_length(body).cast("bigint")).otherwise(F.col(f"`{size}`")) if size in names else None
    return cut.select(*[counted.alias(n) if n == size and counted is not None else F.col(f"`{n}`") for n in names])
