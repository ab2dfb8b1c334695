"""Benchmark decontamination: a broadcast hash set of test n-grams probed by every document window.

Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window. Every window of
every document is hashed and probed; a hit counts only if the words themselves are equal.

Everything is DataFrame expressions. The text is scanned once, and only hits and one row per
document are shuffled. The window table is broadcast in blocks of at most ``BLOCK`` rows, so its
size is bounded however large the benchmark is: more windows mean more passes, never a larger one.

Defined cases: a null text has no words; rows are judged one by one, so repeated rows and rows that
share a doc_id each get their own answer; items without words, and an empty benchmark, hit nothing;
an item with a null id still hits but is not counted or listed; repeated items count once. Input
columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._columns import lower_ascii, named, other_columns, whole_text
from plumbline.session import materialize

#: Separators in lower-cased text, and a word with what stands before it in the original text.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"

#: Rows of one broadcast window table: about 40 MB of ten-word windows.
BLOCK = 100_000

RESULTS = ("n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated")
_POSITION = (1 << 40) - 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATOR), "")


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """The distinct windows, each with its hash and the ids of the items that hold it."""
    split = benchmark.select(F.col(item).cast("string").alias("item"), words(whole_text(text)).alias("words"))
    length = F.least(F.lit(n), F.size("words"))
    return (
        split.where(F.size("words") > 0)
        .select("item", "words", length.alias("m"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"))
        .select("item", F.slice("words", F.col("at"), F.col("m")).alias("window_words"))
        .groupBy("window_words")
        .agg(F.collect_set("item").alias("window_items"))
        .withColumn("window_hash", F.xxhash64("window_words"))
    )


def _window_codes(lengths: list[int], first: bool) -> Column:
    """One number per window: its length above its 1-based position; 0 stands for the document itself."""
    parts = [F.array(F.lit(0).cast("long"))] if first else []
    for m in lengths:
        base = F.lit(m << 40).cast("long")
        some = F.sequence(base + 1, base + F.size("__words") - m + 1)
        parts.append(F.when(F.size("__words") >= m, some).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*parts) if parts else F.array().cast("array<bigint>")


def _probe(docs: DataFrame, windows: DataFrame, lengths: list[int], first: bool) -> DataFrame:
    """Hits of one block of windows, and with ``first`` one row per document."""
    code = F.col("__code")
    at = F.greatest(code.bitwiseAND(F.lit(_POSITION)), F.lit(1)).cast("int")
    length = F.shiftright(code, 40).cast("int")
    window = F.slice("__words", at, length)
    probes = docs.select("__row", "__doc", "__words", F.explode(_window_codes(lengths, first)).alias("__code"))
    found = probes.join(
        F.broadcast(windows),
        (F.when(code > 0, F.xxhash64(window)) == F.col("window_hash")) & (window == F.col("window_words")),
        "left",
    ).where((code == 0) | F.col("window_hash").isNotNull())
    return found.select(
        "__row",
        F.when(code == 0, F.col("__doc")).alias("__doc"),
        F.when(code == 0, F.size("__words").cast("long")).alias("n_words"),
        F.when(code > 0, F.struct(at.alias("start"), length.alias("length"))).alias("span"),
        F.col("window_items").alias("items"),
    )


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).cast("long").alias("n"),
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
    )
    return F.aggregate(spans, start, step)["n"]


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    block: int = BLOCK,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``, which alone are shuffled) with ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items``,
    ``items`` (ids as sorted strings), ``hit_spans`` (start and length in words, from 1) and ``contaminated``."""
    windows = item_windows(benchmark, item, item_text, n)
    facts = windows.groupBy(F.size("window_words").alias("m")).count().collect()  # at most n rows
    lengths = sorted(row["m"] for row in facts)
    blocks = max(1, -(-sum(row["count"] for row in facts) // block))
    kept = other_columns(docs if keep is None else docs.select(*named(keep)), RESULTS)
    base = docs.select(
        F.monotonically_increasing_id().alias("__row"), F.struct(*named(kept)).alias("__doc"), whole_text(text).alias("__text")
    )
    if blocks > 1:  # several passes must agree on the row numbers
        base = materialize(base, "decontamination")
    base = base.select("__row", "__doc", words(F.col("__text")).alias("__words"))
    found = None
    for b in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.col("window_hash"), F.lit(blocks)) == b)
        hits = _probe(base, part, lengths, first=b == 0)
        found = hits if found is None else found.unionByName(hits)
    grouped = found.groupBy("__row").agg(
        F.first("__doc", ignorenulls=True).alias("__doc"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("hit_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return grouped.select(
        *[F.col("__doc")[name].alias(name) for name in kept],
        "n_words",
        _covered(F.col("hit_spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "hit_spans",
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) without the words that hit.

    A removed word takes the separators before it along. The columns stay as they were."""
    marked = mark_contamination(docs, benchmark, text, **options)
    kept = [name for name in docs.columns if name in other_columns(docs, RESULTS)]
    if remove == "documents":
        return marked.where(~F.col("contaminated")).select(*named(kept))
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    body = F.col(f"`{text}`")
    pieces = F.regexp_extract_all(body, F.lit(f"({PIECE})"), F.lit(1))
    outside = F.filter(
        pieces,
        lambda _, i: ~F.exists("hit_spans", lambda s: (s["start"] <= i + 1) & (i + 1 < s["start"] + s["length"])),
    )
    cut = F.concat(F.array_join(outside, ""), F.regexp_extract(body, f"({TAIL})", 1))
    return marked.select(*[F.when(F.col("contaminated"), cut).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in kept])
