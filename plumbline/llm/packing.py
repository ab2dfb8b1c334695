"""Best-fit packing of tokenized documents into sequences of fixed capacity.

1. Documents become token ids plus an end id; only those longer than a sequence are cut into pieces.
   Words are tokenized once and kept in a bounded cache, since a text is mostly known words.
2. The plan sees the histogram of piece lengths only (at most one entry per length, whatever the
   number of documents). Patterns of up to three coarse lengths that fill a sequence are enumerated,
   non-negative least squares fits their repeat counts to the histogram, the counts are rounded down
   and filled with real lengths (the last one by best fit), and the rest goes best-fit, longest first,
   into the space that is left. All of it counts equal sequences instead of listing them, so the plan
   stays bounded.
3. Pieces are numbered by length without a one-task sort, and each number names a place of the plan.

Defined cases: a null text is empty and becomes the end id alone; repeated rows are all packed; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.row_index import row_index
from plumbline.session import materialize

CAPACITY = 4096
#: Coarse lengths of the patterns.
GRAINS = 64
#: Texts between white space whose ids a worker remembers, the words in them, and characters tokenized together.
CACHE_CHUNKS, CACHE_WORDS = 400_000, 700_000
BATCH_CHARS = 500_000

#: Letters, then ASCII signs other than the apostrophe: the tokenizer cuts between them whatever they are.
#: Lower case makes a letter and a mark of İ alone, and the mark would join the signs.
_LETTERS_SIGNS = re.compile(r"([^\W\d_İ]+)([!-&(-/:-@\[-`{-~]*)")


class _Ids:
    """The ids of texts, by a tokenizer that drops white space and case and cuts letters from signs."""

    by_path: dict[str, _Ids] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = any(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> _Ids:
        if path not in cls.by_path:
            cls.by_path[path] = cls(path)
        return cls.by_path[path]

    def split(self, text: str) -> list[str]:
        """Cut at plain white space, which no token spans. ASCII case goes first, unless a special token may be meant."""
        if not (self.special and "<|" in text):
            text = text.encode().lower().decode()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _cut(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, start = ids.astype("<u4").tobytes(), 0
        for word, end in zip(words, (4 * ends).tolist()):
            self.words[word] = data[start:end]
            start = end

    def _learn_any(self, texts: list[str]) -> None:
        if texts:
            found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            owner = np.array(found.word_ids, dtype=np.int64)
            self._cut(texts, np.array(found.ids, dtype=np.int64), np.searchsorted(owner, np.arange(len(texts)), side="right"))

    def _learn_letters(self, words: list[str]) -> None:
        """Many words in one go; each ends with its only token that ends a word."""
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words):
                self._cut(words, ids, ends)
            else:  # lower case has made several words of one
                self._learn_any(words)

    def learn(self, chunks: list[str]) -> None:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        parts = [m.groups() if (m := _LETTERS_SIGNS.fullmatch(c)) else (c, "") for c in chunks]
        new = {part for pair in parts for part in pair}.difference(self.words)
        letters = [part for part in new if part.isalpha()]
        self.words.setdefault("", b"")
        self._learn_letters(letters)
        self._learn_any([part for part in new if part and not part.isalpha()])
        for chunk, (letter, signs) in zip(chunks, parts):
            self.chunks[chunk] = self.words[letter] + self.words[signs]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            until, chars = at, 0
            while until < len(texts) and (until == at or chars + len(texts[until]) <= BATCH_CHARS):
                chars += len(texts[until])
                until += 1
            split = [self.split(t) for t in texts[at:until]]
            if len(self.chunks) > CACHE_CHUNKS:
                self.chunks.clear()
            self.learn(list(set().union(*split).difference(self.chunks)))
            for parts in split:
                yield b"".join([self.chunks[c] for c in parts])
            at = until


def forget() -> None:
    """Give back what this worker remembers of texts, for the work of another operator that follows in it."""
    for ids in _Ids.by_path.values():
        ids.chunks, ids.words = {}, {}


def token_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    return _Ids.of(path)(texts)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def document_pieces(
    docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """One row per piece; with ``keep_ids`` also its ids, as little-endian unsigned 32-bit numbers."""
    schema = PIECES + (", ids binary" if keep_ids else "")
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            rows: list[tuple] = []
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(keys, token_bytes(texts, tokenizer_path)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if keep_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
            columns = list(zip(*rows)) or [[]] * len(kinds)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`")).mapInArrow(cut, schema)


def _patterns(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with one to three lengths, longest first."""
    found = [(units,)] + [(a, units - a) for a in range(units - 1, 0, -1) if a >= units - a]
    return found + [(a, b, units - a - b) for a in range(units - 2, 0, -1) for b in range(min(a, units - a - 1), 0, -1) if b >= units - a - b >= 1]


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by coordinate descent on the normal equations."""
    gram, slope = matrix.T @ matrix, -(matrix.T @ target)
    x = np.zeros(matrix.shape[1])
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(x)):
            new = max(0.0, x[j] - slope[j] / gram[j, j])
            if new != x[j]:
                slope += gram[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.01:
            break
    return x


Runs = tuple[tuple[int, int], ...]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, grains: int = GRAINS) -> list[tuple[Runs, int]]:
    """Kinds of sequences as runs of (length, how many), and how many sequences are of that kind."""
    left = {length: n for length, n in histogram.items() if n}
    open_at: dict[int, list[tuple[Runs, int]]] = {}  # space left -> kinds

    def close(runs: Runs, n: int) -> None:
        if n:
            open_at.setdefault(capacity - sum(length * q for length, q in runs), []).append((runs, n))

    grain = -(-capacity // grains)
    units = capacity // grain

    patterns = _patterns(units)
    matrix = np.zeros((units, len(patterns)))
    for j, pattern in enumerate(patterns):
        for b in pattern:
            matrix[b - 1, j] += 1
    target = np.zeros(units)
    for length, n in left.items():
        target[-(-length // grain) - 1] += n
    weight = np.sqrt(np.arange(1, units + 1) / units)  # short pieces fit anywhere: misfits cost least there
    repeats = np.floor(nnls(matrix * weight[:, None], target * weight)).astype(int)

    available = sorted(left)

    def longest(low: int, high: int, taken: Counter) -> int | None:
        """The longest length in (low, high] of which a piece is left beside the taken ones."""
        i = bisect_right(available, high)
        while i and available[i - 1] > low:
            if left[available[i - 1]] > taken[available[i - 1]]:
                return available[i - 1]
            i -= 1
        return None

    for pattern, n in zip(patterns, repeats.tolist()):
        while n:
            # All but the last come from the pattern's bins; the last is what fits best, mostly of its bin.
            taken: Counter = Counter()
            for b in pattern[:-1]:
                taken[longest((b - 1) * grain, b * grain, taken)] += 1
            if None in taken:
                break
            last = longest(0, capacity - sum(length * q for length, q in taken.items()), taken)
            if last is None:
                break
            taken[last] += 1
            k = min(n, *(left[length] // q for length, q in taken.items()))
            if not k:
                break
            close(tuple(sorted(taken.items(), reverse=True)), k)
            n -= k
            for length, q in taken.items():
                left[length] -= k * q
                if not left[length]:
                    available.remove(length)

    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        for space in sorted(s for s in open_at if s >= length):
            if not n:
                break
            each = space // length
            kinds, rest = open_at.pop(space), []
            for runs, count in kinds:
                k = min(count, n // each)
                close((*runs, (length, each)), k)
                n -= k * each
                if k < count and 0 < n < each:
                    close((*runs, (length, n)), 1)
                    k, n = k + 1, 0
                if k < count:
                    rest.append((runs, count - k))
            if rest:
                open_at.setdefault(space, []).extend(rest)
        each = capacity // length
        close(((length, each),), n // each)
        if n % each:
            close(((length, n % each),), 1)
    return [kind for space in sorted(open_at) for kind in open_at[space]]


def _places(histogram: dict[int, int], plan: list[tuple[Runs, int]]) -> np.ndarray:
    """Rows of first position, pieces per sequence, first sequence, first offset, length; by position.

    A position counts pieces by ascending length."""
    lengths = sorted(histogram)
    next_position = dict(zip(lengths, np.concatenate([[0], np.cumsum([histogram[x] for x in lengths])])[:-1].tolist()))
    rows, sequence = [], 0
    for runs, count in plan:
        offset = 0
        for length, each in runs:
            rows.append((next_position[length], each, sequence, offset, length))
            next_position[length] += each * count
            offset += length * each
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (read twice: write them first) with ``sequence_id`` and ``offset``."""
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    places = _places(histogram, packing_plan(histogram, capacity))
    schema = pieces.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    numbered = row_index(pieces, ["length", "doc_id", "piece", "start"], "position")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            place = places[np.searchsorted(places[:, 0], position, side="right") - 1]
            index = position - place[:, 0]
            sequence, offset = place[:, 2] + index // place[:, 1], place[:, 3] + index % place[:, 1] * place[:, 4]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.select(*pieces.columns, "position").mapInArrow(put, schema.replace(":", " "))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Tokenize, cut and pack; the pieces are written to shared scratch in between."""
    return pack(materialize(document_pieces(docs, tokenizer_path, capacity=capacity, **options), "pieces"), capacity)
