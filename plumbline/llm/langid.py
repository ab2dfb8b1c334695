"""Language identification: known words by log frequency, unseen ones by shorter and shorter n-grams.

Words are runs of letters, lower-cased. A known word counts its smoothed log frequency in every
language. An unseen word counts the mean of its known n-grams of the longest size of which any is
known. The score is the posterior of the best language under equal priors, with at most
``EVIDENCE`` words' worth of evidence, so that long texts do not all score 1.

Fitting reads a bounded sample: of each language, rows whose hashed id falls below the share that
makes ``SAMPLE`` rows; its ``WORDS`` most frequent words are kept. Prediction covers every text whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if
there was nothing to learn from; repeated rows are predicted one by one; ties go to the first
language by name. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import packing
from plumbline.llm._columns import named, other_columns

SAMPLE = 4_000  # documents of each language
WORDS = 30_000  # words of each language
SIZES = (5, 4, 3, 2, 1)
EVIDENCE = 20
UNKNOWN = "und"
_SMOOTH = 0.5
_CACHE = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters. Numerals such as ½ or Ⅷ are not letters and part them."""
    found = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for run in found for part in "".join(c if c.isalpha() else " " for c in run).split()]


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``word``, ``n`` over all given rows; counted within batches before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(language, Counter()).update(words_of(body or ""))
            rows = [(language, word, n) for language, found in counts.items() for word, n in found.items()]
            columns = zip(*rows) if rows else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "word", "n"])

    counted = docs.select(F.col(f"`{lang}`"), F.col(f"`{text}`")).mapInArrow(count, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by language of words and of n-grams (word ends are marked by spaces)."""

    def __init__(self, counts: list[tuple[str, str, int]]) -> None:
        self.languages = sorted({language for language, _, _ in counts})
        place = {language: i for i, language in enumerate(self.languages)}
        grams: list[dict[str, np.ndarray]] = [{} for _ in range(max(SIZES) + 1)]
        for language, word, n in counts:
            for size in (0, *SIZES):
                marked = f" {word} "
                parts = [word] if size == 0 else {marked[i : i + size] for i in range(len(marked) - size + 1)}
                for part in parts:
                    row = grams[size].get(part)
                    if row is None:
                        row = grams[size][part] = np.zeros(len(place), dtype=np.float32)
                    row[place[language]] += n
        self.tables: list[tuple[dict[str, int], np.ndarray]] = []
        for found in grams:
            table = np.array(list(found.values()), dtype=np.float32).reshape(-1, max(1, len(place)))
            logs = np.log((table + _SMOOTH) / (table.sum(axis=0) + _SMOOTH * max(1, len(table))))
            self.tables.append(({part: i for i, part in enumerate(found)}, (logs - logs.max(axis=1, keepdims=True)).astype(np.float32)))

    def vector(self, word: str) -> np.ndarray:
        """Log likelihood of each language, less the best one's."""
        known, table = self.tables[0]
        if word in known:
            return table[known[word]]
        marked = f" {word} "
        for size in SIZES:
            known, table = self.tables[size]
            found = [known[g] for g in (marked[i : i + size] for i in range(len(marked) - size + 1)) if g in known]
            if found:
                mean = table[found].mean(axis=0)
                return mean - mean.max()
        return np.zeros(len(self.languages), dtype=np.float32)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, vocabulary: int = WORDS) -> Model:
    """A model from the rows whose ``lang`` is not null. The driver holds at most ``vocabulary`` words per language."""
    rows = labelled.where(F.col(lang).isNotNull())
    sizes = {row[lang]: row["count"] for row in rows.groupBy(lang).count().collect()}
    if not sizes:
        return Model([])
    shares = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, sample / n))])
    hashed = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1_000_003)) / 1_000_003.0  # a key may repeat or be null
    counts = word_counts(rows.where(hashed < shares[F.col(lang)]), text, lang)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= vocabulary)
    return Model(sorted((r["lang"], r["word"], r["n"]) for r in kept.select("lang", "word", "n").collect()))


class _Scorer:
    """Scores texts; remembers the vectors of a bounded number of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.vectors = np.zeros((1 << 12, len(self.model.languages)), dtype=np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.place) + len(words) > _CACHE:
            self.forget()
        while len(self.place) + len(words) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        for word in words:
            i = self.place[word] = len(self.place)
            self.vectors[i] = self.model.vector(word)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            if missing := set(part).difference(self.place):
                # all of the part's words, should the others be forgotten
                self.learn(missing) if len(self.place) + len(missing) <= _CACHE else (self.forget(), self.learn(set(part)))
            total += self.vectors[[self.place[w] for w in part]].sum(axis=0, dtype=np.float64)
        total *= min(1.0, EVIDENCE / len(words))
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


RESULTS = ("lang_pred", "score")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. The model's size is bounded by the parameters of ``fit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = other_columns(docs, RESULTS)
    place = [name.lower() for name in kept].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing.forget()  # of a pipeline run before this one
        scorer = _Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t) for t in batch.column(place).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *RESULTS])

    rows = docs.select(*named(kept))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor
