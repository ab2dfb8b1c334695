"""Large SQL dumps as many small scripts, cut where they are read.

A dump is cut after statements and between the rows of an INSERT, whose head is then repeated. Where that is, depends on
quotes, comments, parentheses and the statement that is open, all of which may come from earlier splits.
For each of the three states of the lexer at its start (plain, in a quoted text, in a comment) a split tells
the state at its end, how deep parentheses are then, and which statement is open. The driver puts
these few values per split together in file order; then each split is cut in its own task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import let_workers_import, materialize
from plumbline.sources.splits import BEGIN, END, INSIDE, WHOLE, joined_fragments, split_lines

#: Characters of a script, about.
PART_CHARS = 1_000_000
PLAIN, QUOTE, COMMENT = range(3)
#: What may be open at some place: nothing, an INSERT with known head (its text), or anything else.
NOTHING, OTHER = "", "?"

_SKIP = r"\s*(?:(?:--[^\n]*(?:\n|\Z)|/\*.*?\*/)\s*)*"
_HEAD = re.compile(_SKIP + r"(INSERT\s+INTO\s+[`\"\[]?\w+[`\"\]]?\s*(?:\([^()]*\)\s*)?VALUES)", re.IGNORECASE | re.DOTALL)
_BLANK = re.compile(_SKIP + r"\Z", re.DOTALL)
_SIGNS = re.compile(r"'[^']*(?:'|\Z)|--[^\n]*|/\*(?:.*?\*/|.*\Z)|[;()]", re.DOTALL)
_NEXT = re.compile(r"\s*,")


class Signs:
    """Places after the ``;``, ``(`` and ``)`` of a text that stand outside quotes and comments; ``state`` is that at the end once all are passed."""

    def __init__(self, text: str, state: int) -> None:
        self.text, self.state, self.start = text, state, 0
        if state != PLAIN:
            closing = "'" if state == QUOTE else "*/"
            found = text.find(closing)
            self.start = len(text) if found < 0 else found + len(closing)
            self.state = state if found < 0 else PLAIN

    def __iter__(self) -> Iterator[tuple[int, str]]:
        for sign in _SIGNS.finditer(self.text, self.start):
            found = sign.group()
            if found in (";", "(", ")"):
                yield sign.end(), found
            elif sign.end() == len(self.text):
                if found[0] == "'" and (len(found) == 1 or found[-1] != "'"):
                    self.state = QUOTE
                elif found[0] == "/" and not (len(found) > 3 and found.endswith("*/")):
                    self.state = COMMENT


def opened(text: str, at: int) -> str:
    """What is open at the end of a text whose last statement begins at ``at``."""
    if head := _HEAD.match(text, at):
        return head.group(1)
    return NOTHING if _BLANK.match(text, at) else OTHER


_EFFECT = "file bigint, split bigint, state int, after int, closed boolean, depth bigint, tail string, lead string"


def _effects(text: str) -> Iterator[tuple[int, int, bool, int, str, str]]:
    """For each state at the start: (state, state after, whether a statement ends, depth since then or since the start, what is open
    after that, what is open at the end if nothing was at the start and no statement ends)."""
    for state in (PLAIN, QUOTE, COMMENT):
        signs, last, depth = Signs(text, state), None, 0
        lead = OTHER if state == QUOTE else NOTHING if signs.state == COMMENT else opened(text, signs.start)
        for at, sign in signs:
            if sign == ";":
                last, depth = at, 0
            else:
                depth += 1 if sign == "(" else -1
        yield state, signs.state, last is not None, depth, NOTHING if last is None else opened(text, last), lead


def _whole_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
    """(file, split, text) of splits whose lines (file, split, value) come together."""
    at, held = None, []
    for batch in batches:
        for file, split, line in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, split) != at:
                if at is not None:
                    yield (*at, "\n".join(held))
                at, held = (file, split), []
            held.append(line)
    if at is not None:
        yield (*at, "\n".join(held))


def _split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _EFFECT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
    for file, split, text in _whole_splits(batches):
        columns = zip(*((file, split, *effect) for effect in _effects(text)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


Start = tuple[int, int, str]


def starts(effects: list[tuple]) -> dict[tuple[int, int], Start]:
    """(file, split) → state, depth and open statement at its start. ``effects``: rows of ``_EFFECT``."""
    by_split: dict[tuple[int, int], dict[int, tuple]] = {}
    for file, split, state, *effect in effects:
        by_split.setdefault((file, split), {})[state] = tuple(effect)
    found: dict[tuple[int, int], Start] = {}
    last, state, depth, open_now = None, PLAIN, 0, NOTHING
    for file, split in sorted(by_split):
        if file != last:
            last, state, depth, open_now = file, PLAIN, 0, NOTHING
        found[file, split] = state, depth, open_now
        state, closed, moved, tail, lead = by_split[file, split][state]
        depth = moved if closed else depth + moved
        open_now = tail if closed else lead if open_now == NOTHING else open_now
    return found


def cut(text: str, start: Start, least: int = PART_CHARS) -> list[tuple[int, str]]:
    """Places where a split may be cut, with the head that what follows needs: the first, the last, and some between."""
    state, depth, head = start
    signs = Signs(text, state)
    if head == NOTHING and signs.state == PLAIN:
        head = opened(text, signs.start)
    kept: list[tuple[int, str]] = []
    latest = None
    for at, sign in signs:
        if sign == "(":
            depth += 1
            continue
        if sign == ";":
            depth, head = 0, opened(text, at)
            place = at, ""
        else:
            depth -= 1
            if depth or head in (NOTHING, OTHER) or not (comma := _NEXT.match(text, at)):
                continue
            place = comma.end(), head + " "
        if not kept or place[0] - kept[-1][0] >= least:
            kept.append(place)
            latest = None
        else:
            latest = place
    return kept + [latest] if latest else kept


_PARTS = "file bigint, split bigint, seq int, kind int, text string"


def _cutter(begin: dict[tuple[int, int], Start], least: int):
    names, kinds = [part.split()[0] for part in _PARTS.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, text in _whole_splits(batches):
            places = cut(text, begin[file, split], least)
            first = split == 0
            if not places:
                rows = [(file, split, 0, BEGIN if first else INSIDE, text)]
            else:
                rows = [(file, split, 0, WHOLE if first else END, text[: places[0][0]])]
                ends = [at for at, _ in places[1:]] + [len(text)]
                rows += [(file, split, i, WHOLE, head + text[at:end]) for i, ((at, head), end) in enumerate(zip(places, ends), 1)]
                rows[-1] = (*rows[-1][:3], BEGIN, rows[-1][4])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_sql_parts(spark: SparkSession, path: str, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows ``(path, part, script)``: the dumps under ``path`` as scripts of whole statements and whole rows; ``part`` keeps their order."""
    let_workers_import(spark)
    lines = split_lines(spark, path).select("file", "split", "value")
    begin = starts([tuple(row) for row in lines.mapInArrow(_split_effects, _EFFECT).collect()])
    pieces = materialize(lines.mapInArrow(_cutter(begin, part_chars), _PARTS), "dump-parts")
    whole = pieces.where(F.col("kind") == WHOLE).select("file", F.struct("split", "seq").alias("part"), "text")
    last = F.lit(2**31 - 1)  # a piece that goes on is the last of its split
    joined = joined_fragments(pieces.drop("seq")).select("file", F.struct("split", last.alias("seq")).alias("part"), "text")
    files = spark.createDataFrame([(name,) for name in spark.read.text(path).inputFiles()] or [("",)], "path string")
    # A row per file, written so that its size is known: the parts of a large file then need not meet it in one task.
    named = materialize(files.withColumn("file", F.xxhash64(F.replace(F.col("path"), F.lit(":///"), F.lit(":/")))), "dump-files")
    return whole.union(joined).join(named, "file").select("path", "part", F.col("text").alias("script"))
