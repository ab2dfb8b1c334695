"""Compression of vectors into short codes: one codebook for each consecutive part of a vector.

Codebooks are fitted by Lloyd's rounds in whole numbers, so results do not depend on the order of
sums. Each task cuts its vectors into blocks and builds a cover tree for each part of a block, once;
the trees are written to shared scratch. A round sends the codebooks (their size is fixed by the
parameters) to the trees, which assign whole subtrees by the triangle inequality and return one sum and
one count per entry and task. No vector is shuffled.

Defined cases: a vector that is null or empty, or holds null, NaN or infinite components, is left out.
Others must have one common length that the parts divide, and components below 2^26 / ``scale`` in
magnitude; both raise ValueError. Rows that repeat count as often as they occur and each get their code.
Null keys come after all others as first entries, and equal keys in the order of their vectors. With fewer kept rows than
entries, the codebooks are that short. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.cover_tree import CoverTree
from plumbline.session import materialize

#: Vectors whose trees are built together; bounds the memory of a task.
BLOCK = 8_192
#: Scaled components stay below, so that squared distances fit 64 bits.
LARGEST = 2**26


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // scale} or more are too large")
    return scaled.astype(np.int64)


def _cut(vectors: np.ndarray, parts: int, width: int) -> np.ndarray:
    return vectors.reshape(len(vectors), parts, width // parts)


def first_entries(vectors: DataFrame, size: int, parts: int, scale: int) -> list[np.ndarray]:
    """The parts of the ``size`` rows of smallest key. The driver sees no more than these."""
    rows = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(size).collect()
    if not rows:
        return []
    width = len(rows[0]["vector"])
    if width % parts or any(len(r["vector"]) != width for r in rows):
        raise ValueError(f"vectors need one length that {parts} parts divide")
    whole = _cut(_whole_numbers(np.array([r["vector"] for r in rows], dtype=np.float64), scale), parts, width)
    return [np.ascontiguousarray(whole[:, part]) for part in range(parts)]


def tree_blocks(vectors: DataFrame, parts: int, width: int, scale: int, block: int = BLOCK) -> DataFrame:
    """Blocks of rows (id, grp, vector): their ids and groups, and a tree for each part."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows).combine_chunks()
            ids, groups, vector = (whole.column(i).combine_chunks() for i in range(3))
            if not (pc.list_value_length(vector).to_numpy(zero_copy_only=False) == width).all():
                raise ValueError(f"vectors need one length, here {width}")
            cut = _cut(_whole_numbers(vector.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale), parts, width)
            trees = [CoverTree.build(np.ascontiguousarray(cut[:, part])).to_bytes() for part in range(parts)]
            once = pa.array([0, len(ids)], pa.int32())
            columns = [pa.ListArray.from_arrays(once, ids), pa.ListArray.from_arrays(once, groups), pa.array([trees], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "groups", "trees"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == block:
                    yield emit(held)
                    held = []
        if held:
            yield emit(held)

    kinds = dict(vectors.dtypes)
    return vectors.select("id", "grp", "vector").mapInArrow(build, f"ids array<{kinds['id']}>, groups array<{kinds['grp']}>, trees array<binary>")


def lloyd_round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one assignment; entries without rows stay."""
    depth = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(book), dtype=np.int64) for book in books]
        total = [np.zeros(book.shape, dtype=np.int64) for book in books]
        for batch in batches:
            for row in batch.column(0):
                for part, tree in enumerate(row):
                    n, sums = CoverTree.from_bytes(tree.as_py()).sums(books[part])
                    count[part] += n
                    total[part] += sums
        for part in range(len(books)):
            used = np.flatnonzero(count[part])
            columns = [np.full(len(used), part), used, count[part][used], *total[part][used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    places = [f"s{i}" for i in range(depth)]
    names = ["part", "entry", "n", *places]
    summed = blocks.select("trees").mapInArrow(add, ", ".join(f"{name} bigint" for name in names))
    after = [book.copy() for book in books]
    for row in summed.groupBy("part", "entry").agg(*(F.sum(name).alias(name) for name in names[2:])).collect():
        after[row["part"]][row["entry"]] = [row[place] // row["n"] for place in places]
    return after


def fit(vectors: DataFrame, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024, block: int = BLOCK) -> tuple[list[np.ndarray], DataFrame]:
    """Codebooks, and the blocks of trees they were fitted on. ``vectors``: id, grp, vector."""
    books = first_entries(vectors, size, parts, scale)
    width = sum(book.shape[1] for book in books)
    blocks = materialize(tree_blocks(vectors, parts, width, scale, block), "cover-trees")
    for _ in range(rounds if books else 0):
        books = lloyd_round(blocks, books)
    return books, blocks


def encode(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Every row's id, grp, code (an entry index per part) and squared error."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                trees = [CoverTree.from_bytes(tree.as_py()) for tree in batch.column(2)[at]]
                found = [tree.codes(book) for tree, book in zip(trees, books)]
                codes = np.column_stack([entry for entry, _ in found]).astype(np.int32)
                errors = sum(away for _, away in found)
                once = np.arange(len(codes) + 1, dtype=np.int32) * len(found)
                columns = [batch.column(0).slice(at, 1).flatten(), batch.column(1).slice(at, 1).flatten()]
                columns += [pa.ListArray.from_arrays(pa.array(once), pa.array(codes.reshape(-1))), pa.array(errors)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "grp", "code", "error"])

    kinds = {name: kind[len("array<") : -1] for name, kind in blocks.dtypes}
    return blocks.mapInArrow(assign, f"id {kinds['ids']}, grp {kinds['groups']}, code array<int>, error bigint")


def decode(code: list[int], books: list[np.ndarray], scale: int = 1024) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([book[entry] for book, entry in zip(books, code)]) / scale


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers between commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024, block: int = BLOCK
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, grp, code, error, group_error) of the kept vectors, and the codebooks.

    ``group_error`` adds the errors of all rows whose ``group`` is equal, nulls together.
    """
    vectors = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{group}`").alias("grp"), F.col(f"`{vector}`").alias("vector")).where(usable(F.col("vector")))
    books, blocks = fit(vectors, parts, size, rounds, scale, block)
    coded = materialize(encode(blocks, books), "vector-codes")
    # Written, so that the join sees its size: a small one is broadcast, beside a large one a hot group can be split.
    sums = materialize(coded.groupBy(F.col("grp").alias("of")).agg(F.sum("error").alias("group_error")), "group-errors")
    return coded.join(sums, F.col("grp").eqNullSafe(F.col("of"))).drop("of"), books
