"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a learned lexicon, closeness of second-person words to its
hits, and rates of capitals, punctuation and obfuscated words. The lexicon holds words and word
beginnings that are much more frequent in toxic rows. Rows are cut into three folds by hash: the
lexicon comes from the first, the trees from the second and the calibration from the third, so that
no stage judges rows which an earlier one has seen; with too few rows of a class all use all rows.

Fitting reads a bounded sample: labelled rows whose hashed id falls below the share that makes
``SAMPLE`` rows (see ``labelled_rows`` for null, repeated and shared ids). Scoring covers every text whole.

Defined cases: null labels are left out; without rows of both classes every score is the share of
toxic rows (0 without any); null and empty texts have all features zero and are scored like others;
repeated rows are scored one by one. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm._columns import named, other_columns
from plumbline.session import materialize

SAMPLE = 20_000
LEXICON = 5_000
MIN_TOXIC = 6  # toxic rows that a lexicon entry needs
MIN_ODDS = 2.0  # log odds that it needs
TREES, DEPTH, STEP = 30, 4, 0.2
_CACHE = 200_000
_NEAR = 5  # words between a hit and a second-person word
_FOLD_ROWS = 20  # of each class
_PARTS = 1_000_003

SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vos".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)

FEATURES = (
    "lexicon_weight lexicon_density lexicon_max lexicon_hits lexicon_kinds obfuscated_hits obfuscation second_person proximity "
    "capitals shouted punctuation exclamation words"
).split()


def _normal(token: str) -> tuple[str, bool]:
    """The word inside a token, lower-cased, and whether signs or digits were put among its letters."""
    m = _CORE.search(token)
    if not m:
        return "", False
    core = m[0].lower()
    if core.isalpha():
        return core, False
    plain = "".join(c for c in core.translate(_LEET) if c.isalpha())
    return plain, len(plain) > 2 and any(c.isalpha() for c in core) and core.count("-") + core.count("'") < len(core) - len([c for c in core if c.isalpha()])


def _entries(word: str) -> list[str]:
    """A word and its beginnings, as the lexicon writes them."""
    return [word] + [f"{word[:n]}*" for n in range(4, min(8, len(word)))]


def term_counts(rows: DataFrame) -> DataFrame:
    """``term``, ``toxic`` and ``clean``: rows (``text``, ``label``) that hold it, counted within batches first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {_normal(t)[0] for t in set((text or "").split())}
                counts[int(label)].update({e for w in words if w for e in _entries(w)})
            terms = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

    counted = rows.select("text", "label").mapInArrow(count, "term string, toxic bigint, clean bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(rows: DataFrame, toxic: int, clean: int, size: int = LEXICON) -> dict[str, float]:
    """Terms by log odds of a toxic row holding them; at most ``size``."""
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    kept = term_counts(rows).where(F.col("toxic") >= MIN_TOXIC).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
    best = kept.orderBy(F.desc("odds"), F.desc("toxic"), "term").limit(size)
    return {row["term"]: row["odds"] for row in best.select("term", "odds").collect()}


class _Features:
    """Features of texts; remembers what is known of a bounded number of tokens."""

    # of a token: lexicon weight, hit, obfuscated hit, obfuscated, second person, letters, capitals, shouted, punctuation, exclamation
    _SIZE = 10

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, self._SIZE))

    def learn(self, tokens: set[str]) -> None:
        while len(self.place) + len(tokens) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for token in tokens:
            i = self.place[token] = len(self.place)
            word, hidden = _normal(token)
            weight = max([self.lexicon.get(e, 0.0) for e in _entries(word)]) if word else 0.0
            letters = sum(map(str.isalpha, token))
            capitals = sum(map(str.isupper, token))
            signs = sum(not c.isalnum() for c in token)
            shouted = letters > 1 and capitals == letters
            self.table[i] = (weight, weight > 0, hidden and weight > 0, hidden, word in SECOND_PERSON, letters, capitals, shouted, signs, token.count("!"))

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(len(FEATURES))
        unknown = set(tokens).difference(self.place)
        if len(self.place) + len(unknown) > _CACHE:
            self.forget()
            unknown = set(tokens)
        self.learn(unknown)
        places = np.array([self.place[t] for t in tokens])
        rows = self.table[places]
        n, sums = len(tokens), rows.sum(axis=0)
        hits, seconds = np.flatnonzero(rows[:, 1]), np.flatnonzero(rows[:, 4])
        near = 0.0
        if len(hits) and len(seconds):
            after = np.searchsorted(seconds, hits)
            right = np.abs(seconds[np.minimum(after, len(seconds) - 1)] - hits)
            left = np.abs(seconds[np.maximum(after - 1, 0)] - hits)
            near = float((np.minimum(left, right) <= _NEAR).mean())
        chars = max(1, len(text))
        return np.array(
            [
                *(sums[0] / n, sums[1] / n, rows[:, 0].max(), np.log1p(sums[1]), len(np.unique(places[hits])), sums[2] / n, sums[3] / n),
                *(sums[4] / n, near, sums[6] / max(1.0, sums[5]), sums[7] / n, sums[8] / chars, sums[9] / chars, np.log1p(n)),
            ]
        )


def with_features(rows: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """``rows`` with ``features``, an array in the order of ``FEATURES``."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    place = [name.lower() for name in rows.columns].index(text.lower())
    schema = T.StructType([*rows.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(shared.value)
        for batch in batches:
            found = pa.array([features.of(t) for t in batch.column(place).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "features"])

    return rows.mapInArrow(run, schema)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: object | None  # None: every score is ``share``
    calibration: object | None
    share: float


def labelled_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The sample to learn from as rows (text, label, fold), written once, and its rows by fold and label.

    Null keys label nothing, and a key that is labelled more than once counts once, as toxic if any label says so; so about ``sample``
    keys are drawn and sent to the tasks. Where many documents share a drawn key, the rows are thinned once more, each on its own.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isin(0, 1)).groupBy("key").agg(F.max("label").alias("label"))
    n = known.count()
    hashed = F.pmod(F.xxhash64("key"), F.lit(_PARTS)) / float(_PARTS)
    some = known.where(hashed < min(1.0, sample / max(1, n)))  # so many rows that a broadcast is bounded
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), "key")
    fold = F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(10))
    fold = F.when(fold < 5, 0).when(fold < 8, 1).otherwise(2).alias("fold")
    rows = rows.select("text", "label", fold, F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism)), "labelled")

    def counted(frame: DataFrame) -> dict[tuple[int, int], int]:
        return {(r["fold"], r["label"]): r["count"] for r in frame.groupBy("fold", "label").count().collect()}

    counts = counted(rows)
    if (found := sum(counts.values())) > 2 * sample:
        rows = rows.where(F.pmod(F.xxhash64("row"), F.lit(_PARTS)) / float(_PARTS) < sample / found)
        counts = counted(rows)
    return rows.drop("row"), counts


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """``labels``: (key, label) of the rows to learn from. About ``sample`` rows are read, whatever their number."""
    rows, counts = labelled_rows(docs, labels, text, key, label, sample)
    total = [sum(c for (_, y), c in counts.items() if y == k) for k in (0, 1)]
    share = total[1] / max(1, sum(total))
    if not all(total):
        return Model({}, None, None, share)
    apart = all(counts.get((f, y), 0) >= _FOLD_ROWS for f in range(3) for y in (0, 1))
    part = (lambda frame, f: frame.where(F.col("fold") == f)) if apart else (lambda frame, f: frame)
    toxic, clean = (counts[0, 1], counts[0, 0]) if apart else (total[1], total[0])
    lexicon = learn_lexicon(part(rows, 0), toxic, clean)
    dense = materialize(with_features(rows, lexicon).select(F.col("label").cast("double"), "fold", "features"), "features")
    ready = dense.withColumn("vector", array_to_vector("features"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(part(ready, 1))
    raw = _raw(trees, part(ready, 2))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw.select("raw", "label"))
    return Model(lexicon, trees, calibration, share)


def _raw(trees, ready: DataFrame) -> DataFrame:
    return trees.transform(ready).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


RESULTS = ("score", "predicted")
#: Names that the steps of scoring use.
_OWN = ("features", "vector", "raw", "probability", "rawPrediction", "prediction")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5)."""
    kept = other_columns(docs, RESULTS)
    if model.trees is None:
        scored = docs.select(*named(kept), F.lit(model.share).alias("score"))
    else:
        rows = docs.select(F.struct(*named(kept)).alias("doc"), F.col(f"`{text}`").alias("text"))
        ready = with_features(rows, model.lexicon).withColumn("vector", array_to_vector("features")).select("doc", "vector")
        calibrated = model.calibration.transform(_raw(model.trees, ready))
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        scored = calibrated.select(*[F.col("doc")[name].alias(name) for name in kept], value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
