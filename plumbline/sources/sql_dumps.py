"""Tables of SQL dump files, taken from their text with Spark expressions.

Accepted: ``CREATE TABLE`` and ``INSERT INTO ... VALUES`` with literals (numbers, quoted
text, NULL), and comments. Statements are found by pattern, not executed; a script whose
rows hold anything else is rejected. All repeated groups in the patterns are possessive,
so long statements neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import materialize
from plumbline.sources.csv_files import INTEGER_PATTERN, WIDE
from plumbline.sources.dump_parts import read_sql_parts

#: A double keeps decimals of so many digits.
DOUBLE_DIGITS = 15

NO_ATTACH = "ATTACH DATABASE statements are not permitted in uploaded SQL"
NO_TABLE = "No CREATE TABLE statement found in the uploaded SQL file"
NOT_LITERAL = "Only literal values are supported in INSERT statements"
NO_SUCH_COLUMN = "An INSERT statement does not fit the columns of its table"


class SqlDumpError(ValueError):
    """Scripts that do not make one table."""


_NAME = r"[`\"\[]?(\w+)[`\"\]]?"
_COMMENT = r"('[^']*+')|--[^\n]*+|/\*(?s:.*?)\*/"
_CREATE = rf"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}"
_COLUMNS = rf"{_CREATE}\s*\(((?:[^()']*+(?:\([^()]*+\)|'[^']*+')?+)*+)\)"
_CONSTRAINT = r"(?i)^\s*(?:PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT|KEY|INDEX)\b"
_INSERT_HEAD = rf"INSERT\s+INTO\s+{_NAME}\s*(?:\(([^)]*+)\)\s*)?VALUES"
_INSERT = rf"(?i){_INSERT_HEAD}[^;']*+(?:'[^']*+'[^;']*+)*+"
_TUPLE = r"\(([^'()]*+(?:'[^']*+'[^'()]*+)*+)\)"
_FIELD = r"\s*([^',]*+(?:'[^']*+'[^',]*+)*+),"
_LITERAL = r"\s*+(?:(?i:NULL)|[+-]?+(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][+-]?+\d++)?+|(?:'[^']*+')++)\s*+"
_LITERALS = rf"\({_LITERAL}(?:,{_LITERAL})*+\)"


def read_sql_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(path, script)``, one per file, for small files; ``read_sql_parts`` cuts large ones."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("script"))


def without_comments(script: Column) -> Column:
    """Quoted text stays, comments become nothing."""
    return F.regexp_replace(script, _COMMENT, "$1")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _bare(name: Column) -> Column:
    return F.lower(F.regexp_replace(_strip(name), r"[`\"\[\]]", ""))


def _table_columns(script: Column) -> Column:
    """Structs ``(name, type)`` of the first table's columns."""
    sized = F.regexp_replace(F.regexp_extract(script, _COLUMNS, 2), r"\(\s*(\d+)\s*,\s*(\d+)\s*\)", "<$1;$2>")
    body = F.regexp_replace(sized, r"\([^()]*\)", "")
    parts = F.filter(F.split(body, ","), lambda p: (_strip(p) != "") & ~p.rlike(_CONSTRAINT))
    words = lambda p: F.split(_strip(p), r"\s+")
    kind = lambda w: F.upper(F.coalesce(F.get(w, F.lit(1)), F.lit("")))
    typed = lambda t, p: (
        F.when(t.contains("INT"), "bigint")
        .when(t.rlike("NUMERIC|DECIMAL") & (_size(p, 1).between(DOUBLE_DIGITS + 1, 38)), F.concat(F.lit("decimal("), _size(p, 1), F.lit(","), _size(p, 2), F.lit(")")))
        .when(t.rlike("REAL|FLOA|DOUB|NUMERIC|DECIMAL"), "double")
        .otherwise("string")
    )
    return F.transform(parts, lambda p: F.struct(_bare(F.get(words(p), F.lit(0))).alias("name"), typed(kind(words(p)), p).alias("type")))


def _size(part: Column, number: int) -> Column:
    """Digits in all (1) or after the point (2) of ``DECIMAL<30;2>``."""
    return F.regexp_extract(part, r"<(\d+);(\d+)>", number).try_cast("int")


def _own_inserts(scripts: DataFrame) -> DataFrame:
    """Statements that insert into the first table: ``statement``, ``named`` (its column list) and ``body``."""
    place = [name for name in ("part",) if name in scripts.columns]
    statements = scripts.select(
        "path", *place, "table", "columns", F.posexplode(F.regexp_extract_all("script", F.lit(_INSERT), F.lit(0))).alias("statement", "text")
    )
    own = statements.filter(F.lower(F.regexp_extract("text", f"(?i){_INSERT_HEAD}", 1)) == F.lower("table"))
    listed = F.regexp_extract("text", f"(?i){_INSERT_HEAD}", 2)
    named = F.when(F.trim(listed) == "", F.col("columns.name")).otherwise(F.transform(F.split(listed, ","), _bare))
    return own.withColumns({"named": named, "body": F.regexp_replace("text", f"(?i)^{_INSERT_HEAD}", "")})


def check_sql_dumps(scripts: DataFrame) -> DataFrame:
    """Adds ``table``, the first table of each dump, its ``columns``, and ``error``, null when readable.

    ``script`` comes back without comments. With a column ``part``, the scripts of a path are parts of one dump.
    """
    s = F.col("script")
    bare = scripts.withColumn("script", without_comments(s)).withColumns({"table": F.regexp_extract(s, _CREATE, 1), "columns": _table_columns(s)})
    attaches = s.rlike(r"(?i)\battach\s+database\b")
    if "part" in scripts.columns:
        found = bare.groupBy("path").agg(
            F.min_by(F.struct("table", "columns"), F.when(F.col("table") != "", F.col("part"))).alias("first"), F.max(attaches).alias("attaches")
        )
        # A row per file, written so that its size is known where it meets the parts.
        found = materialize(found.select("path", F.coalesce("first.table", F.lit("")).alias("table"), "first.columns", "attaches"), "dump-tables")
        bare = bare.drop("table", "columns").join(found, "path")
    else:
        bare = bare.withColumn("attaches", attaches)
    rest = F.regexp_replace("body", _LITERALS, "")
    known = F.size(F.array_except("named", "columns.name")) == 0
    fields = F.regexp_extract_all(F.concat(F.regexp_extract("body", _TUPLE, 1), F.lit(",")), F.lit(_FIELD), F.lit(1))
    # A head alone is what is left of an INSERT whose rows are other parts.
    empty = ~F.col("body").rlike(r"[^\s,;]")
    faults = _own_inserts(bare).select(
        "path", F.when(~rest.rlike(r"^[\s,;]*$"), 1).when(~empty & (~known | (F.size(fields) != F.size("named"))), 2).alias("fault")
    )
    worst = faults.groupBy("path").agg(F.min("fault").alias("fault"))
    if "part" in scripts.columns:
        worst = materialize(worst, "dump-faults")
    error = (
        F.when(F.col("attaches"), NO_ATTACH)
        .when(F.col("table") == "", NO_TABLE)
        .when(F.col("fault") == 1, NOT_LITERAL)
        .when(F.col("fault") == 2, NO_SUCH_COLUMN)
    )
    return bare.join(worst, "path", "left").withColumn("error", error).drop("fault", "attaches")


def sql_dump_rows(scripts: DataFrame) -> DataFrame:
    """Rows ``(path, table, statement, row_no, values)`` of each readable script's first table.

    Values come in the order of the table's columns, null for columns that a statement does not
    name. ``part``, if there is one, ``statement`` and ``row_no`` (within the statement) keep the order of the file.
    """
    checked = check_sql_dumps(scripts)
    return _rows_of(checked.filter(F.col("error").isNull()))


def _rows_of(readable: DataFrame) -> DataFrame:
    own = _own_inserts(readable)
    place = [name for name in ("part",) if name in readable.columns]
    rows = own.select(
        "path",
        *place,
        "table",
        "statement",
        F.col("columns.name").alias("names"),
        "named",
        F.posexplode(F.regexp_extract_all("body", F.lit(_TUPLE), F.lit(1))).alias("row_no", "fields"),
    )
    fields = F.regexp_extract_all(F.concat("fields", F.lit(",")), F.lit(_FIELD), F.lit(1))
    given = F.transform(fields, _literal)
    ordered = F.transform("names", lambda n: F.get(given, (F.array_position("named", n) - 1).cast("int")))
    values = F.when(F.col("names") == F.col("named"), given).otherwise(ordered)
    return rows.select("path", *place, "table", "statement", "row_no", values.alias("values"))


def read_sql_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that the dumps under ``path`` hold, with the types of its CREATE TABLE where all values fit them.

    Values that do not fit a numeric type widen it, to whole numbers of 38 digits, to doubles, or to text; none
    is lost. Dumps of any size are read by many tasks. All must be readable and define the same
    table; otherwise ``SqlDumpError``.
    """
    checked = check_sql_dumps(read_sql_parts(spark, path))
    facts = checked.groupBy("error", "columns").agg(F.min("path").alias("path")).limit(20).collect()
    if faults := sorted(f"{row['error']} ({row['path']})" for row in facts if row["error"]):
        raise SqlDumpError("; ".join(faults))
    if len(facts) != 1:
        raise SqlDumpError("The scripts do not define one table")
    columns = facts[0]["columns"]
    rows = materialize(_rows_of(checked).select("values"), "dump-rows")
    texts = rows.select(*[F.get("values", F.lit(i)).alias(c["name"]) for i, c in enumerate(columns)])
    return _typed(texts, {c["name"]: c["type"] for c in columns})


def _typed(texts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as the kinds they are declared to be, or the next wider ones that lose nothing."""
    wider = {"bigint": ["bigint", WIDE, "double"], "double": ["double"], "string": []}
    tests = []
    for i, (name, kind) in enumerate(kinds.items()):
        c = F.col(f"`{name}`")
        for k, to in enumerate(wider.get(kind, [kind, "double"])):
            whole = c.rlike(INTEGER_PATTERN) if to in ("bigint", WIDE) else _fits(c, to)
            tests.append(F.count_if(c.isNotNull() & ~F.coalesce(whole & c.try_cast(to).isNotNull(), F.lit(False))).alias(f"misfits{i}_{k}"))
    misfits = texts.agg(*tests).first() if tests else None
    typed = []
    for i, (name, kind) in enumerate(kinds.items()):
        to = next((to for k, to in enumerate(wider.get(kind, [kind, "double"])) if not misfits[f"misfits{i}_{k}"]), "string")
        typed.append(F.col(f"`{name}`").cast(to).alias(name))
    return texts.select(*typed)


def _fits(c: Column, kind: str) -> Column:
    """Whether a decimal keeps all digits after the point; doubles take any number."""
    if not kind.startswith("decimal"):
        return F.lit(True)
    places = int(kind[:-1].split(",")[1])
    return c.rlike(rf"^\s*[+-]?\d*(?:\.\d{{0,{places}}}0*)?\s*$")


def _literal(field):
    text = _strip(field)
    inner = F.replace(F.regexp_replace(text, "^'|'$", ""), F.lit("''"), F.lit("'"))
    return F.when(F.upper(text) == "NULL", None).when(text.startswith("'"), inner).otherwise(text)
