"""CSV files with inferred types."""

from __future__ import annotations

import csv
import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import parse_number
from plumbline.functions.numbers import NUMBER_PATTERN
from plumbline.session import let_workers_import, materialize
from plumbline.sources.splits import BEGIN, END, HEADER, INSIDE, WHOLE, joined_fragments, split_lines

# Texts read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TOKENS, FALSE_TOKENS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
WIDE = "decimal(38,0)"

# Doubled quotes inside quoted fields, and no trimming: padding is data.
_QUOTING = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


# A field that ends before the line does, with its comma; and the rest of a line that ends inside quotes.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:{_QUOTED}")?+(?!")[^,]*+,)*+'
_OPEN_FROM_START = rf"^{_FIELDS}{_QUOTED}\z"
_OPEN_FROM_INSIDE = rf'^[^"]*+(?:""[^"]*+)*+(?:\z|"[^,]*+,{_FIELDS}{_QUOTED}\z)'
#: What a line does to the state at its start (0 between records, 1 inside quotes), as the pair of states after it.
SAME, CLOSES, OPENS, FLIPS = 0b10, 0b00, 0b11, 0b01


def _effect() -> Column:
    """The pair as a number: bit 0 the state after a start between records, bit 1 after a start inside quotes."""
    line = F.col("value")
    pair = line.rlike(_OPEN_FROM_START).cast("int") + 2 * line.rlike(_OPEN_FROM_INSIDE).cast("int")
    return F.when(line.contains('"'), pair).otherwise(SAME).cast("int")


def has_open_record(line: str) -> Column:
    """Whether a line, read from its start, ends inside a quoted field."""
    return F.col(line).contains('"') & F.col(line).rlike(_OPEN_FROM_START)


def files_with_line_breaks(spark: SparkSession, path: str) -> list[str]:
    """Files in which some line ends inside a quoted field."""
    lines = spark.read.option("lineSep", "\n").text(path).where(has_open_record("value"))
    return sorted(row[0] for row in lines.select(F.col("_metadata.file_path")).distinct().collect())


def read_csv(spark: SparkSession, path: str, infer: bool = True, multiline: bool | None = None) -> DataFrame:
    """Read files with a header; missing tokens become null and column types are inferred.

    Files are split across tasks, also those whose records span lines (see ``read_split``). Columns meet
    by name, whatever their order in a file; a column that a file lacks is null there. Types come
    from one aggregate over all columns, after the missing tokens are gone. With ``multiline``
    set, Spark's reader takes all files, whole or by lines, and they must agree on the header.
    """
    raw = _read_by_header(spark, path) if multiline is None else _parse(spark, path, multiline)
    texts = raw.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return infer_types(texts) if infer else texts


def _parse(spark: SparkSession, path: str | list[str], multiline: bool) -> DataFrame:
    return spark.read.options(**_QUOTING, mode="FAILFAST", multiLine=multiline).csv(path)


def plain_path(uri: str) -> str:
    """A file's path as readers take it; ``file:///a`` and ``file:/a`` are the same."""
    return re.sub(r"^(\w+):/{3,}", r"\1:/", unquote(uri))


def _read_by_header(spark: SparkSession, path: str) -> DataFrame:
    """Files grouped by their first line and by whether records span lines, a union by column names.

    The driver holds a line per file, as it holds the list of files.
    """
    lines = split_lines(spark, path).withColumn("row", F.monotonically_increasing_id())
    facts = lines.where((F.col("split") == 0) | F.col("value").contains('"')).groupBy("path").agg(
        F.min_by("value", F.when((F.col("split") == 0) & (F.trim("value") != ""), F.col("row"))).alias("header"),
        F.max(has_open_record("value")).alias("broken"),
    )
    groups: dict[tuple[str, bool], list[str]] = {}
    for row in facts.collect():
        header = (row["header"] or "").removesuffix("\r").removeprefix("\ufeff")
        groups.setdefault((header, row["broken"]), []).append(plain_path(row["path"]))
    if not groups:
        return _parse(spark, path, False)
    frames = []
    for (_, broken), files in sorted(groups.items(), key=lambda group: min(group[1])):
        names = _parse(spark, files[:1], broken).columns
        names[-1] = names[-1].removesuffix("\r")
        frames.append(read_split(spark, sorted(files), names) if broken else _parse(spark, sorted(files), False))
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def _split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, effect) of the lines of splits, in order: what all lines of a split do together."""
    at, effect = None, SAME
    out: list[tuple[int, int, int]] = []
    for batch in batches:
        for file, split, pair in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, split) != at:
                if at is not None:
                    out.append((*at, effect))
                at, effect = (file, split), SAME
            effect = (pair >> (effect & 1) & 1) | (pair >> (effect >> 1) & 1) << 1
    if at is not None:
        out.append((*at, effect))
    columns = zip(*out) if out else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], names=["file", "split", "effect"])


def _states(effects: list[tuple[int, int, int]]) -> dict[int, tuple[list[int], list[int]]]:
    """Of each file, the splits after which the state is another one, and the state after them."""
    found: dict[int, tuple[list[int], list[int]]] = {}
    last, state = None, 0
    for file, split, effect in sorted(effects):
        state = 0 if file != last else state
        last, after = file, effect >> state & 1
        if after != state:
            splits, states = found.setdefault(file, ([], []))
            splits.append(split)
            states.append(after)
        state = after
    return found


def _records(states: dict[int, tuple[list[int], list[int]]]):
    """Lines (file, split, value, effect) → pieces (file, split, kind, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, held, begun, header = None, 0, [], WHOLE, False
        out: list[tuple] = []

        def flush() -> Iterator[tuple]:
            """What is held at the end of a split belongs to a record that goes on."""
            if held:
                yield (*at, begun, "\n".join(held))

        for batch in batches:
            for file, split, line, pair in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, split) != at:
                    out += flush()
                    at = (file, split)
                    splits, after = states.get(file, ((), ()))
                    i = bisect_left(splits, split)
                    state = after[i - 1] if i else 0
                    held, begun, header = [], INSIDE if state else WHOLE, split == 0
                if not held and begun == WHOLE and not state and not line.strip():
                    continue  # blank lines between records
                before, state = state, pair >> state & 1
                held.append(line)
                if begun == WHOLE and state:
                    begun = HEADER if header else BEGIN
                elif not state:
                    if begun == INSIDE:
                        out.append((*at, END, "\n".join(held)))
                    elif not header:
                        out.append((*at, WHOLE, "\n".join(held)))
                    held, begun, header = [], WHOLE, False
            yield _pieces(out)
            out = []
        yield _pieces([*flush()])

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), (), ())
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "split", "kind", "text"])


def split_records(spark: SparkSession, files: list[str]) -> tuple[DataFrame, set[int]]:
    """Rows (file, text) of the records of files whose quoted fields may hold line breaks, without headers; and the files that end inside quotes.

    Files are read by as many tasks as they have splits. Every line tells what it does to the two states it may begin
    in; the effects of splits, put together in file order, give each split the state it begins in.
    """
    let_workers_import(spark)
    lines = split_lines(spark, files).select("file", "split", "value", _effect().alias("effect"))
    changing = lines.where(F.col("effect") != SAME).select("file", "split", "effect")
    effects = changing.mapInArrow(_split_effects, "file bigint, split bigint, effect int").collect()
    states = _states([tuple(row) for row in effects])
    pieces = materialize(lines.mapInArrow(_records(states), "file bigint, split bigint, kind int, text string"), "csv-records")
    whole = F.col("kind") == WHOLE
    records = pieces.where(whole).select("file", "text").union(joined_fragments(pieces).where(whole).select("file", "text"))
    return records.withColumn("text", without_return("text")), {file for file, (_, after) in states.items() if after[-1]}


def without_return(text: str) -> Column:
    """The column without the carriage return at its end."""
    return F.when(F.col(text).endswith("\r"), F.expr(f"left({text}, length({text}) - 1)")).otherwise(F.col(text))


def parsed_fields(text: str, columns: int, mode: str = "FAILFAST") -> Column:
    """A struct of texts ``c0``, ``c1``, ... from one record."""
    options = {k: str(v) for k, v in _QUOTING.items()} | {"mode": mode, "multiLine": "true", "header": "false"}
    return F.from_csv(F.col(text), ", ".join(f"c{i} string" for i in range(columns)), options)


def number_of_fields(text: str) -> Column:
    """Fields of one record: commas outside quotes, and one."""
    bare = F.when(F.col(text).contains('"'), F.regexp_replace(text, rf'(^|,){_QUOTED}"', "$1")).otherwise(F.col(text))
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def header_names(spark: SparkSession, file: str, line: str) -> list[str]:
    """Column names by the first line of ``file``; empty ones are numbered, repeated ones get a suffix."""
    line = line.removesuffix("\r").removeprefix("\ufeff")
    opens = re.search(_OPEN_FROM_START.replace(r"\z", r"\Z"), line)
    names = _parse(spark, [file], True).columns if opens else next(csv.reader([line]))
    taken: set[str] = set()
    for i, name in enumerate(names):
        found, n = name or f"Unnamed: {i}", 0
        while (new := f"{found}.{n}" if n else found) in taken:
            n += 1
        taken.add(new)
        names[i] = new
    return names


def read_split(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    """Files of one header whose quoted fields may hold line breaks, read by as many tasks as they have splits."""
    records, _ = split_records(spark, files)
    fields = records.select(parsed_fields("text", len(names)).alias("row"))
    return fields.select(*[F.col(f"row.c{i}").alias(name) for i, name in enumerate(names)])


def null_tokens(c: Column) -> Column:
    return F.when(c.isin(NA_TOKENS), None).otherwise(c)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers, numbers or booleans where every value fits."""
    if not df.columns:
        return df
    tests = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        tests += [
            F.count(c).alias(f"present{i}"),
            F.count_if(c.rlike(INTEGER_PATTERN)).alias(f"whole{i}"),
            F.count(F.trim(c).try_cast("bigint")).alias(f"long{i}"),
            F.count(F.trim(c).try_cast(WIDE)).alias(f"wide{i}"),
            F.count_if(c.rlike(NUMBER_PATTERN)).alias(f"number{i}"),
            F.count_if(c.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"flag{i}"),
        ]
    fits = df.agg(*tests).first()
    typed = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        present = fits[f"present{i}"]
        if present and fits[f"whole{i}"] == fits[f"wide{i}"] == present:  # all digits are kept
            c = F.trim(c).cast("bigint" if fits[f"long{i}"] == present else WIDE)
        elif present and fits[f"number{i}"] == present:
            c = parse_number(c)
        elif present and fits[f"flag{i}"] == present:
            c = c.isin(TRUE_TOKENS)
        typed.append(c.alias(name))
    return df.select(*typed)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write with a header and without a row number; missing values are empty fields."""
    df.write.mode(mode).options(**_QUOTING, emptyValue="", nullValue="").csv(path)
