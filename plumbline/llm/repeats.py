"""Removal of repeated byte strings with suffix arrays.

A byte goes if any string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same
document or another. No machine can hold the suffix array of the whole corpus, so suffixes are dealt
by content. Among the 48-byte grams of a window the one with the least hash is its anchor; equal
windows have equal anchors. Consecutive windows with one anchor form a run of at most 153 windows.

1. Every document gives its runs, without text: anchor, digest, place. Anchors that occur once are
   dropped by counting, which leaves what repeats.
2. Equal runs are counted; one of each fetches its text. Runs are dealt by anchor to blocks whose
   suffix arrays (two-stage sorting, then adjacent common prefixes) tell which windows repeat.
3. Marks go back to all places of a run, and each document is cut.

An anchor with more than ``HOT`` different runs (a passage in very many surroundings) would make one
block too large; its windows are counted by 128-bit digest instead, map-side first, so it is spread.

Defined cases: a null text is empty; texts shorter than a window lose nothing; repeated rows repeat
each other; rows that share a doc_id are separate; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._columns import whole_text
from plumbline.llm.suffix_array import Block
from plumbline.session import materialize

LENGTH = 200
GRAM = 48
HOT = 20_000
BLOCK_BYTES = 400_000
_SEGMENT = 4 << 20  # window starts that are looked at together
_PLACE = np.uint64((1 << 24) - 1)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _gram_hashes(data: bytes, low: int, high: int) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place in ``low`` to ``high - GRAM``."""
    eight = np.ndarray((high - low - 7,), dtype="<u8", buffer=data, offset=low, strides=(1,))
    n = high - low - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for k, factor in enumerate(_FACTORS):
        h += eight[8 * k : 8 * k + n] * factor
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    return h


def _least_of_next(values: np.ndarray, width: int) -> np.ndarray:
    n, size = len(values) - width + 1, 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:n], values[width - size : width - size + n])


def runs_of(data: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, anchor place, first window, windows) of the runs of a text, in order."""
    width = length - GRAM + 1
    for low in range(0, len(data) - length + 1, _SEGMENT):
        hashes = _gram_hashes(data, low, min(len(data), low + _SEGMENT + length - 1))
        ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (_least_of_next(ranked, width) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        counts = np.diff(np.r_[first, len(anchors)])
        at = anchors[first]
        yield from zip(hashes[at].tolist(), (low + at).tolist(), (low + first).tolist(), counts.tolist())


_RUNS = [("key", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("windows", pa.int32())]


def _list_runs(length: int):
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, anchors, digests, firsts, counts = [], [], [], [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for anchor, place, first, n in runs_of(data, length):
                    keys.append(key)
                    anchors.append(anchor)
                    digests.append(xxh3_64_intdigest(data[first : first + n + length - 1], place - first))
                    firsts.append(first)
                    counts.append(n)
            signed = [np.array(x, dtype=np.uint64).view(np.int64) for x in (anchors, digests)]
            columns = [pa.array(keys, pa.int64()), *map(pa.array, signed), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in _RUNS])

    return run


_TEXTS = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("times", pa.int64()), ("windows", pa.int32()), ("body", pa.binary())])


def _fetch(length: int):
    """Texts of the wanted runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, wanted in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for w in wanted:
                    body = data[w["first"] : w["first"] + w["windows"] + length - 1]
                    rows.append({"anchor": w["anchor"], "digest": w["digest"], "times": w["times"], "windows": w["windows"], "body": body})
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_TEXTS)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_TEXTS)

    return run


_MARKS = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _mark(length: int, block_bytes: int):
    """Ranges of repeated windows in each run, relative to its first. Rows come sorted by anchor and digest."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        windows = np.array([r[3] for r in rows], dtype=np.int64)
        found = Block([r[4] for r in rows], windows).repeated(length)
        found |= np.repeat(np.array([r[2] > 1 for r in rows]), windows)
        row = np.repeat(np.arange(len(rows)), windows)
        edge = np.diff(np.r_[False, found, False].astype(np.int8))
        split = np.flatnonzero(found[1:] & found[:-1] & (row[1:] != row[:-1])) + 1  # a range ends with its run
        low = np.sort(np.r_[np.flatnonzero(edge == 1), split])
        high = np.sort(np.r_[np.flatnonzero(edge == -1), split]) - 1
        own = row[low]
        begin = np.r_[0, np.cumsum(windows)[:-1]]
        ids = [np.array([r[i] for r in rows], dtype=np.int64)[own] for i in (0, 1)]
        places = [(x - begin[own]).astype(np.int32) for x in (low, high)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*ids, *places)], schema=_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:2] == held[-1][:2]:
                    continue  # a repeated row of the table
                if size >= block_bytes and row[0] != held[-1][0]:
                    yield judge(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield judge(held)

    return run


def _hot_windows(length: int):
    """Digests of the single windows of hot runs."""
    from xxhash import xxh3_128_digest

    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("times", pa.int64()), ("at", pa.int32()), ("window", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, digest, times, windows, body in zip(*[c.to_pylist() for c in batch.columns]):
                rows += [
                    {"anchor": anchor, "digest": digest, "times": times, "at": i, "window": xxh3_128_digest(body[i : i + length])} for i in range(windows)
                ]
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key`` and ``spans`` (``low`` and ``high`` in bytes, may overlap) of the documents (``key``, ``body``) that lose bytes."""
    schema = ", ".join(f"{n} {'int' if t == pa.int32() else 'bigint'}" for n, t in _RUNS)
    runs = docs.select("key", "body").mapInArrow(_list_runs(length), schema)
    again = runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # Written, they are a plain side of the join, which then may split an anchor of very many runs.
    again = materialize(again, "anchors")
    places = materialize(runs.join(again, "anchor"), "repeats")
    different = places.groupBy("anchor", "digest").agg(
        F.count("*").alias("times"), F.min(F.struct("key", "first", "windows")).alias("one")
    )
    different = materialize(different.select("anchor", "digest", "times", "one.*"), "repeats")
    crowded = different.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
    any_hot = bool(crowded.take(1))

    wanted = different.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "times", "first", "windows")).alias("wanted"))
    texts = docs.select("key", "body").join(wanted, "key").select("body", "wanted").mapInArrow(_fetch(length), "anchor bigint, digest bigint, times bigint, windows int, body binary")
    if any_hot:
        texts = materialize(texts, "repeats").join(crowded.withColumn("hot", F.lit(True)), "anchor", "left")
        apart = texts.where("hot").select("anchor", "digest", "times", "windows", "body").dropDuplicates(["anchor", "digest"])
        texts = texts.where(F.col("hot").isNull()).select("anchor", "digest", "times", "windows", "body")
    sorted_texts = texts.repartition("anchor").sortWithinPartitions("anchor", "digest")
    marks = sorted_texts.mapInArrow(_mark(length, block_bytes), "anchor bigint, digest bigint, low int, high int")
    if any_hot:
        windows = materialize(apart.mapInArrow(_hot_windows(length), "anchor bigint, digest bigint, times bigint, at int, window binary"), "repeats")
        twice = windows.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
        marks = marks.unionByName(windows.join(twice, "window").select("anchor", "digest", F.col("at").alias("low"), F.col("at").alias("high")))
    marks = materialize(marks, "repeats")
    low, high = F.col("first") + F.col("low"), F.col("first") + F.col("high") + length
    spans = places.join(marks, ["anchor", "digest"]).select("key", F.struct(low.alias("low"), high.alias("high")).alias("span"))
    return spans.groupBy("key").agg(F.collect_set("span").alias("spans"))


_CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep_bytes: bool = False, **options) -> DataFrame:
    """Sizes and digest of what each document keeps; with ``keep_bytes`` also the bytes themselves and the
    removed spans. Cuts may fall inside a character, so what is kept is bytes."""
    body = whole_text(text)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), body.alias("body"), F.xxhash64(F.col(key), body).alias("key"))
    spans = repeated_spans(rows, length, **options)
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    kinds += [("kept", pa.binary()), ("removed", pa.list_(pa.list_(pa.int64())))] if keep_bytes else []
    out = pa.schema(kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data, found in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                gone = merged([(s["low"], s["high"]) for s in found or []])
                edges = [0, *[x for span in gone for x in span], len(data)]
                kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])
                row = {"doc_id": doc, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                rows.append(row | ({"kept": kept, "removed": gone} if keep_bytes else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    joined = rows.join(spans, "key", "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(cut, _CUT + (", kept binary, removed array<array<bigint>>" if keep_bytes else ""))
