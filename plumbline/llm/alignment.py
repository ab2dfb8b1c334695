"""Alignment of two tokenizers' tokens over the same text, and corpus-wide counts of linked ids.

A text's tokens by either tokenizer are known by the byte offsets at which they end. Offsets where
tokens of both end cut the text into groups; inside a group, tokens whose bytes overlap are linked.

1. Texts are tokenized and aligned where they are read. Runs of one-to-one groups are found by comparing the two
   end arrays at the current shift of their indexes, with steps that double while they agree. Where
   they differ, the irregular group is walked token by token, and the shift follows from its sizes.
2. Different pairs of a document are written once, with how often they are linked. Counts over the
   corpus combine in every task before they are shuffled.
3. Frequent pairs, at most ``HEAD`` of them by a threshold, go to all tasks as sorted arrays;
   so no pair that many documents hold is shuffled with its documents. The others are joined.

Both tokenizers cut before a single space between other characters, whatever stands around: the first by
its pattern, the second because no piece holds a space after another character, which is checked when it is
loaded. So tokens of both end there, and the groups and links of the chunks between are found once while a
bounded cache holds them. New chunks are encoded and aligned together.

Defined cases: texts that are null or empty, or of which either tokenizer's bytes differ from the text, have no
tokens: all numbers are 0 and the groups an empty string. Rows with equal or null ids are documents of
their own. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

#: Pairs that are sent to every task, at most.
HEAD = 1_000_000
#: Chunks a worker remembers; longer ones it does not.
CACHE, LONG = 500_000, 200
#: Characters that are aligned together.
STRETCH = 1_000_000

#: A space between characters that no tokenizer takes for white space.
_CUT = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])")
#: Chunks that may follow one another in any order.
_PLAIN = re.compile(r" [^\s\u180e](?:.*[^\s\u180e])?", re.DOTALL)


class ByteLevel:
    """Ids and entries of a byte-level BPE whose entries show bytes by printable characters."""

    #: How the tokenizer cuts a text before it merges bytes (fixed by the format).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        # Printable bytes stand for themselves, the others in order for the characters from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.entries: list[bytes] = [b""] * self.size
        for entry, i in vocabulary.items():
            if all(c in byte_of for c in entry):
                self.entries[i] = bytes(byte_of[c] for c in entry)
        self.lengths = np.array([len(e) for e in self.entries], dtype=np.int64)
        self.fast = self._by_ranks(spec)

    def _by_ranks(self, spec: dict):
        """The same BPE by ranks, which is faster on short texts, if merges stand in the order of their ids."""
        import tiktoken

        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"].get(m) for m in merges]
        kind = spec["pre_tokenizer"] or {}
        same = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec["normalizer"]
        if not same or ids != list(range(256, 256 + len(ids))):
            return None
        ranks = {entry: i for i, entry in enumerate(self.entries[: 256 + len(ids)])}
        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, short: bool) -> list[int]:
        return self.fast.encode_ordinary(text) if short and self.fast else self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and entries of a piece model that writes spaces as U+2581 and puts one before a text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("pieces that hold a space after other characters cannot be encoded by chunks")
        self.entries = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)
        ]
        self.lengths = np.array([len(e) for e in self.entries], dtype=np.int64)

    def encode(self, text: str, short: bool) -> list[int]:
        """``text`` begins with the space that the model puts before it."""
        return self.model.encode(text[1:])


#: The groups of a chunk, its links (id of A times the size of B, plus id of B; little-endian 64 bits), and its tokens of A.
Chunk = tuple[str, bytes, int]


class Aligner:
    """Groups and links of texts, put together from those of their chunks."""

    by_paths: dict[tuple[str, str], Aligner] = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.shown_a, self.shown_b = [str(i) for i in range(self.a.size)], [str(i) for i in range(self.b.size)]
        self.known: dict[str, Chunk | None] = {}
        self.before: dict[str, Chunk | None] = {}  # the last half of the cache; what is met again moves on

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls.by_paths:
            cls.by_paths[path_a, path_b] = cls(path_a, path_b)
        return cls.by_paths[path_a, path_b]

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The text's chunks, so many characters at a time; the text gets its leading space."""
        text, at = f" {text}", 0
        while at < len(text):
            cut = _CUT.search(text, at + STRETCH) if at + STRETCH < len(text) else None
            end = cut.start() if cut else len(text)
            yield _CUT.split(text[at:end])
            at = end

    def learn(self, chunks: list[str], short: bool) -> None:
        """Encode and align chunks as one text. All but a single one begin with one space and end with another character."""
        text = "".join(chunks)
        data = text.encode()
        a, b = (np.array(side.encode(text, short), dtype=np.int64) for side in (self.a, self.b))
        if any(b"".join([side.entries[i] for i in ids.tolist()]) != data for side, ids in ((self.a, a), (self.b, b))):
            if len(chunks) == 1:
                self.known[text] = None
            else:
                for chunk in chunks:
                    self.learn([chunk], short)
            return
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        groups, links_a, links_b = align(memoryview(ends_a), memoryview(ends_b))
        shown_a, shown_b = [self.shown_a[i] for i in a.tolist()], [self.shown_b[i] for i in b.tolist()]
        shown = [
            f"{shown_a[i]}|{shown_b[j]}" if k - i == m - j == 1 else f"{','.join(shown_a[i:k])}|{','.join(shown_b[j:m])}" for i, j, k, m in groups
        ]
        links = (a[links_a] * self.b.size + b[links_b]).astype("<i8").tobytes()
        ends = np.cumsum([len(c) for c in chunks] if len(data) == len(text) else [len(c.encode()) for c in chunks])
        group_ends = ends_a[np.array([g[2] for g in groups]) - 1]
        cuts = [np.searchsorted(x, ends, side="right").tolist() for x in (ends_a, group_ends, ends_a[links_a])]
        # A link lies where its token of B lies too; within a chunk both do.
        at = [0, 0, 0]
        for chunk, *until in zip(chunks, *cuts):
            self.known[chunk] = ";".join(shown[at[1] : until[1]]), links[8 * at[2] : 8 * until[2]], until[0] - at[0]
            at = until

    def __call__(self, chunks: list[str]) -> list[Chunk | None]:
        known = self.known
        if len(known) > CACHE // 2:
            self.before, self.known = known, {}
            known = self.known
        new = set(chunks).difference(known)
        if new and self.before:
            again = {c: self.before[c] for c in new if c in self.before}
            known.update(again)
            new = new.difference(again)
        if new:
            together = [c for c in new if len(c) <= LONG and _PLAIN.fullmatch(c)]
            if together:
                self.learn(together, True)
            for chunk in new.difference(together):
                self.learn([chunk], False)
        found = [known[c] for c in chunks]
        for chunk in new:
            if len(chunk) > LONG:
                del known[chunk]
        return found


def align(ends_a: memoryview, ends_b: memoryview) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
    """Groups (first a, first b, after a, after b) and links (a, b) of tokens by their ends, in order.

    Both arrays rise and end with the same offset.
    """
    groups, links_a, links_b = [], [], []
    i, shift, n = 0, 0, len(ends_a)
    while i < n:
        # Jump: steps double while the ends agree at this shift, then halve around the first that differs.
        start, step = i, 1
        while i + step <= n and (ends_a[i] == ends_b[i + shift] if step == 1 else ends_a[i : i + step] == ends_b[i + shift : i + shift + step]):
            i += step
            step *= 2
        while step > 1:
            step //= 2
            if i + step <= n and ends_a[i : i + step] == ends_b[i + shift : i + shift + step]:
                i += step
        if i > start:
            groups += zip(range(start, i), range(start + shift, i + shift), range(start + 1, i + 1), range(start + shift + 1, i + shift + 1))
            links_a += range(start, i)
            links_b += range(start + shift, i + shift)
            if i == n:
                break
        # Irregular: move on in the array that is behind until both end together.
        a, b = i, i + shift
        end_a, end_b = ends_a[a], ends_b[b]
        links_a.append(a)
        links_b.append(b)
        while end_a != end_b:
            if end_a < end_b:
                a += 1
                end_a = ends_a[a]
            else:
                b += 1
                end_b = ends_b[b]
            links_a.append(a)
            links_b.append(b)
        groups.append((i, i + shift, a + 1, b + 1))
        i, shift = a + 1, b - a
    return groups, links_a, links_b


def _document(aligner: Aligner, text: str | None) -> tuple[tuple[int, int, int, int, str], np.ndarray, np.ndarray]:
    """Numbers of a document, its different links, and how often it has each."""
    digest, links, n_a, n_groups = hashlib.sha256(), [], 0, 0
    for chunks in aligner.stretches(text) if text else ():
        found = aligner(chunks)
        if None in found:
            links = []
            break
        shown = ";".join([f[0] for f in found])
        links.append(np.unique(np.frombuffer(b"".join([f[1] for f in found]), "<i8"), return_counts=True))
        digest.update((";" + shown if n_groups else shown).encode())
        n_a += sum([f[2] for f in found])
        n_groups += shown.count(";") + 1
    if not links:
        return (0, 0, 0, 0, ""), np.zeros(0, np.int64), np.zeros(0, np.int32)
    pairs, place = np.unique(np.concatenate([p for p, _ in links]), return_inverse=True)
    times = np.bincount(place, weights=np.concatenate([n for _, n in links])).astype(np.int64)
    n_links = int(times.sum())
    return (n_a, n_links + n_groups - n_a, n_groups, n_links, digest.hexdigest()), pairs, times.astype(np.int32)


_LINKED = "id {id}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def link_documents(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its numbers, its different pairs (id of A times the size of B, plus id of B) and how often each is linked."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        for batch in batches:
            if batch.num_rows:
                facts, pairs, times = zip(*(_document(aligner, text.as_py()) for text in batch.column(2)))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]
                numbers = [pa.array(c, kind) for c, kind in zip(zip(*facts), [pa.int64()] * 4 + [pa.string()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, *lists], names=names)

    schema = _LINKED.format(id=dict(docs.dtypes)[key])
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select(F.col(f"`{key}`"), F.monotonically_increasing_id(), F.col(f"`{text}`")).mapInArrow(link, schema)


def pair_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """Of each pair: how many documents hold it, and whether that is the highest count of its first id."""
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.expr(f"pair DIV {size_b}")))  # no more rows than B has ids
    return counts.withColumn("best", F.col("n") == best)


def _threshold(counts: DataFrame, head: int) -> int:
    """The least power of two that at most ``head`` pairs' counts reach."""
    rows = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()
    least, total = 62, 0
    for row in sorted(rows, key=lambda r: -r["power"]):
        total += row["pairs"]
        if total > head:
            break
        least = row["power"]
    return 1 << least


def count_links(linked: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``linked`` (read twice: written before, as ``counts``) with ``n_best`` and ``count_sum`` instead of its pairs."""
    least = _threshold(counts, head)
    frequent = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    known = linked.sparkSession.sparkContext.broadcast(tuple(frequent.column(i).to_numpy() for i in range(3)))
    facts = ["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            lists = batch.column(len(facts))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat, times = lists.flatten().to_numpy(), batch.column(len(facts) + 1).flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            found = pair[at] == flat if len(pair) else np.zeros(len(flat), dtype=bool)
            spread = lambda x: np.concatenate([[0], np.cumsum(x)])[ends]
            where = at[found]
            values = [np.zeros(len(flat), dtype=np.int64) for _ in range(2)]
            values[0][found], values[1][found] = times[found] * best[where], times[found] * n[where]
            sums = [pa.array(np.diff(spread(v))) for v in values]
            rest = pa.array(spread(~found).astype(np.int32))
            columns = [*batch.columns[: len(facts)], *sums, *(pa.ListArray.from_arrays(rest, pa.array(x[~found])) for x in (flat, times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*facts, "n_best", "count_sum", "pairs", "times"])

    kinds = dict(linked.dtypes)
    schema = ", ".join([f"{name} {kinds[name]}" for name in facts] + ["n_best bigint", "count_sum bigint", "pairs array<bigint>", "times array<int>"])
    summed = linked.select(*facts, "pairs", "times").mapInArrow(add, schema)
    if counts.where(F.col("n") < least).isEmpty():
        return summed.drop("pairs", "times")
    summed = materialize(summed, "linked-sums")
    rare = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times")
    held = rare.join(counts.where(F.col("n") < least), F.col("pairs") == F.col("pair"))
    more = held.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    both = summed.drop("pairs", "times").join(more, F.col("row") == F.col("of"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.withColumns({"n_best": plus("n_best", "more_best"), "count_sum": plus("count_sum", "more_sum")}).drop("of", "more_best", "more_sum")


def cross_align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Rows (id, row, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), one per document."""
    linked = materialize(link_documents(docs, path_a, path_b, key, text), "links")
    counts = materialize(pair_counts(linked, Pieces(path_b).size), "pair-counts")
    return count_links(linked, counts, head)
