"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is set if more than half of the shingle hashes set it. Fingerprints link at
``radius`` or fewer differing bits. Each bit is given a non-zero vector of radius + 1 bits; a mask
keeps the bits whose vector has an odd product with one of the 2^(radius+1) - 1 non-zero vectors.
Any ``radius`` vectors leave some non-zero vector orthogonal to all of them, so each pair within the
radius agrees on all bits of at least one mask: no link is missed.

Equal fingerprints are one from the start. A bucket of up to ``BUCKET`` fingerprints is compared
inside its task and gives one link per fingerprint, not one per pair. A larger bucket is dealt out
again by masks over the bits that its mask leaves free, which is exact by the same argument; after
few rounds fewer bits are free than a bucket can hold.

Defined cases: null and blank texts have the fingerprint zero and link like any other; fewer words
than a shingle make one shingle; rows that share a doc_id each have a fingerprint; a null doc_id is
never the smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._columns import named, whole_text
from plumbline.llm.components import connected_components
from plumbline.session import materialize

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints that are compared with each other in one go.
BUCKET = 512
SETTLED_BITS = 9
_CHUNK = 100_000  # shingles whose bits are counted at once


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text; bytes lower-case and split by ASCII rules only."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    shingles = zip(*[words[i:] for i in range(size)])
    ones, n = np.zeros(64, dtype=np.int64), len(words) - size + 1
    for at in range(0, n, _CHUNK):
        count = min(_CHUNK, n - at)
        hashes = np.fromiter((xxh64_intdigest(b" ".join(next(shingles)), SEED) for _ in range(count)), dtype="<u8", count=count)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE_WORDS, also: Mapping[str, Column] = {}) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed number, and the whole numbers ``also`` of each row."""
    names = ["doc_id", "bits", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t or b"", size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(bits, dtype=np.uint64).view(np.int64)), *batch.columns[2:]], names=names
            )

    rows = docs.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`"), *[c.alias(name) for name, c in also.items()])
    return rows.mapInArrow(run, ", ".join(f"{name} bigint" for name in names))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_masks(radius: int = RADIUS, fixed: int = 0) -> list[int]:
    """Masks that keep the ``fixed`` bits and cover all patterns of ``radius`` of the others."""
    vectors = (1 << (radius + 1)) - 1
    free = [i for i in range(64) if not fixed >> i & 1]
    masks = []
    for v in range(1, vectors + 1):
        mask = fixed
        for place, bit in enumerate(free):
            if ((place % vectors + 1) & v).bit_count() % 2:
                mask |= 1 << bit
        masks.append(mask)
    return masks


def _roots(values: np.ndarray, radius: int) -> np.ndarray:
    """The place of the first value that each value reaches by steps within the radius."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    root = np.arange(len(values))
    while True:
        least = np.where(near, root[None, :], len(values)).min(axis=1)
        if (least == root).all():
            return root
        root = least


def _compare(radius: int, bucket: int):
    """Links of sorted (mask, bits under it, fingerprint) rows; rows of large buckets come back as they are."""

    def most(mask: np.uint64) -> int:
        """Few free bits bound a bucket by themselves, and need no further masks."""
        free = 64 - int(mask).bit_count()
        return bucket if free > SETTLED_BITS else max(bucket, 1 << free)

    def links(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = _roots(values, radius)
        moved = root != np.arange(len(values))
        return values[moved], values[root[moved]]

    def out(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate([np.full(len(a), kind, dtype=np.int32) for kind, a, _ in parts])]
        columns += [np.concatenate([p[i].view(np.int64) for p in parts]) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.uint64)  # rows of the last bucket so far
        large = None  # mask and bits of the last bucket, once it has grown too large to hold
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)])
            rows, parts = np.concatenate([held, rows], axis=1), []
            if large is not None:
                same = int(((rows[0] == large[0]) & (rows[1] == large[1])).sum())  # they come first
                parts.append((1, rows[0, :same], rows[2, :same]))
                rows = rows[:, same:]
            if rows.shape[1]:
                starts = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
                ends = np.r_[starts[1:], rows.shape[1]]
                several = (ends - starts > 1) & (ends < rows.shape[1])
                for start, end in zip(starts[several].tolist(), ends[several].tolist()):
                    one = rows[:, start:end]
                    parts.append((0, *links(one[2])) if end - start <= most(one[0, 0]) else (1, one[0], one[2]))
                held, large = rows[:, starts[-1] :], None
                if held.shape[1] > most(held[0, 0]):
                    parts.append((1, held[0], held[2]))
                    held, large = held[:, :0], (held[0, 0], held[1, 0])
            if any(len(p[1]) for p in parts):
                yield out(parts)
        if held.shape[1] > 1:
            yield out([(0, *links(held[2]))])

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links that join all fingerprints (``bits``, without repeats) within ``radius`` of each other, directly
    or through others within the radius of both sides."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    rows = distinct.select(F.explode(masks).alias("mask"), "bits")
    found = None
    while True:
        keyed = rows.select("mask", F.col("bits").bitwiseAND(F.col("mask")).alias("under"), "bits")
        dealt = keyed.repartition("mask", "under").sortWithinPartitions("mask", "under", "bits")
        compared = materialize(dealt.mapInArrow(_compare(radius, bucket), "kind int, a bigint, b bigint"), "simhash")
        links = compared.where(F.col("kind") == 0).select("a", "b")
        found = links if found is None else found.unionByName(links)
        large = compared.where(F.col("kind") == 1)
        used = [row["a"] for row in large.select("a").distinct().collect()]  # masks: at most 15 to the power of the round
        if not used:
            return found.distinct()
        finer = F.create_map(*[x for m in used for x in (F.lit(m), F.array(*[F.lit(_signed(s)) for s in covering_masks(radius, m % (1 << 64))]))])
        rows = large.select(F.explode(finer[F.col("a")]).alias("mask"), F.col("b").alias("bits")).distinct()


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _labels(prints: DataFrame, radius: int) -> DataFrame:
    """Of each fingerprint the ``root``, one for each component, and ``component_id``, the smallest doc_id of the component."""
    distinct = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    groups = connected_components(near_links(distinct.select("bits"), radius))
    least = groups.join(distinct.select(F.col("bits").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = groups.join(least, "root").select(F.col("node").alias("bits"), "root", "component_id")
    joined = distinct.join(linked, "bits", "left")
    return joined.select("bits", F.coalesce("root", "bits").alias("root"), F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` (smallest doc_id reachable by links) of each row."""
    prints = materialize(fingerprints(docs, text, key, size), "fingerprints")
    # Written, the labels are a plain side of the join, which then may split a fingerprint of very many rows.
    labels = materialize(_labels(prints, radius).select("bits", "component_id"), "labels")
    return prints.join(labels, "bits").select("doc_id", hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the first by id, a null id last, then by text.

    Rows are judged one by one, so rows that share an id, or have none, stay if their texts are of different components.
    """
    body = whole_text(F.col(f"`{text}`"))
    digest = {"__h1": F.xxhash64(body), "__h2": F.xxhash64(F.lit(1), body)}  # 128 bits tell the texts under one id apart
    prints = materialize(fingerprints(docs, text, key, size, digest), "fingerprints")
    labels = materialize(_labels(prints, radius), "labels")
    least = prints.join(labels, "bits").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Written for the same reason as labels: the join below may split a text of very many rows.
    least = materialize(least.select(F.col("doc_id").alias("__least"), F.col("__h1").alias("__l1"), F.col("__h2").alias("__l2"), "root").distinct(), "firsts")
    rows = docs.select(F.struct(*named(docs.columns)).alias("__doc"), F.col(f"`{key}`").cast("bigint").alias("__id"), *[c.alias(n) for n, c in digest.items()])
    same = (F.col("__h1") == F.col("__l1")) & (F.col("__h2") == F.col("__l2")) & F.col("__id").eqNullSafe(F.col("__least"))
    firsts = rows.join(least, same).groupBy("root").agg(F.min_by("__doc", F.coalesce(F.col("__doc")[text], F.lit(""))).alias("__doc"))
    return firsts.select(*[F.col("__doc")[name].alias(name) for name in docs.columns])
