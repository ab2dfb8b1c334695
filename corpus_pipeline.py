"""From raw documents to packed training sequences.

``STAGES`` run in order; each gets what the one before it kept, written as Parquet and read again.
All but the last return the columns of their input, whatever their names.

Defined cases: a null text is empty. It has no language, so the first stage drops it, as it does texts without a letter. Rows
that repeat are rows of their own; of equal ones the line or the near-copy stage leaves one. A null doc_id
comes after all others. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, langid, lines, packing, simhash
from plumbline.llm._columns import named
from plumbline.llm.queries import let_workers_import
from plumbline.session import materialize

TOKENIZER = "word_bpe_49k.json"


#: Columns that stages read or change; the others go along in one struct, out of the way of result columns.
OWN = ("doc_id", "text", "lang", "n_chars")


def _beside(stage: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """``stage`` over the columns it works on, with the others unchanged."""
    own = [c for c in docs.columns if c in OWN]
    rest = [c for c in docs.columns if c not in OWN]
    if not rest:
        return stage(docs).select(*named(docs.columns))
    out = stage(docs.select(*named(own), F.struct(*named(rest)).alias("__rest")))
    return out.select(*[F.col("__rest")[c].alias(c) if c in rest else F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found. It is learned from the labelled documents of ``sf_dir``."""
    let_workers_import(spark)
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(labelled.where(langid.remainder("doc_id", 4) != 2))
    return _beside(lambda rows: langid.predict(rows, model).where(F.col("lang_pred") != langid.UNKNOWN), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that equal, or are within two edits of, a line that stays elsewhere; emptied documents go."""
    let_workers_import(spark)
    return _beside(lines.dedup_lines, docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    let_workers_import(spark)
    return _beside(simhash.keep_first, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(lambda rows: decontamination.decontaminate(rows, benchmark), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    let_workers_import(spark)
    return packing.pack_documents(docs, tokenizer_path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Models, edit joins and a tokenizer: SQL cannot express the stages. Tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
