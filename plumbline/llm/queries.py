"""The queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, chat, decontamination, fingerprints, langid, lines, mixing, packing, repeats, simhash, toxicity, vector_codes, warc
from plumbline.llm._columns import whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this library where the driver has it (a cluster installs it there or elsewhere on the path)."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def query(name: str, oracle: str | None = None):
    def register(run):
        @functools.wraps(run)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            return run(spark, sf_dir)

        QUERIES[name] = prepared
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# The first statement splits both tables into words; the rest cuts windows as long as those of the items.
DECONTAMINATION = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
dw AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d JOIN (SELECT DISTINCT m FROM i) ON len(w) >= m)),
hit AS (SELECT doc_id, k, m, item_id FROM dw JOIN iw USING (m, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_decontamination", DECONTAMINATION)
def op1(spark, sf_dir):
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    marked = decontamination.mark_contamination(documents, benchmark, keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return marked.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op2_fingerprints")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text("text").alias("text"))
    sums = fingerprints.fingerprint_documents(docs, "text", "sums")
    paired = fingerprints.with_next(sums, "doc_id", "text", ["text", "sums"], buckets=4 * partitions(spark))
    edited = paired.withColumn("edited", fingerprints.edited_text(F.col("text"), F.col("next_text")))
    edited = edited.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "sums",
        "next_sums",
        fingerprints.fingerprint(F.col("edited")).alias("edited_sums"),
    )
    lanes = edited.withColumns({f"{c}_lanes": fingerprints.projection(F.col(c)) for c in ("sums", "next_sums", "edited_sums")})
    likeness = lambda other: fingerprints.likeness(F.col("sums"), F.col(other), F.col("sums_lanes"), F.col(f"{other}_lanes"))
    return lanes.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(F.col("sums")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sums")).alias("edited_fingerprint"),
        likeness("edited_sums").alias("near_edited"),
        likeness("next_sums").alias("near_next"),
    )


@query("op9_packing")
def op9(spark, sf_dir):
    from public_tokenizers import path

    return packing.pack_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


@query("op5_simhash")
def op5(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_warc")
def op7(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query("op3_chat_format")
def op3(spark, sf_dir):
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    framed = sum(len(part) for part in chat.frame())
    return chat.conversation_digests(chat.read_back(chat.format_conversations(rows)), framed)


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.remainder("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_line_dedup")
def op6(spark, sf_dir):
    marked = lines.mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", "sources", "n_links")


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


# Four rounds and the last assignment are the same two steps; positions count from 1.
def _vector_codes_sql(rounds: int = 4, size: int = 256) -> str:
    steps = [
        """WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT r, (p - 1) // (w // 4) AS part, (p - 1) % (w // 4) AS pos, CAST(floor(CAST(v AS DOUBLE) * 1024) AS BIGINT) AS x
  FROM (SELECT r, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p, len(embedding) AS w FROM kept)),
b0 AS (SELECT part, r - 1 AS entry, pos, x AS c FROM cells WHERE r <= {size})"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT r, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM
  (SELECT r, cells.part, entry, sum((x - c) * (x - c)) AS d FROM cells JOIN b{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
        )
        if k < rounds:
            steps.append(
                f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(n.c, b{k}.c) AS c FROM b{k} LEFT JOIN
  (SELECT part, entry, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c FROM cells JOIN a{k} USING (r, part) GROUP BY ALL) n USING (part, entry, pos))"""
            )
    steps.append(
        """coded AS (SELECT r, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} JOIN kept USING (r) GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM coded"""
    )
    return ",\n".join(steps).replace("{size}", str(size)).replace("{rounds}", str(rounds))


@query("op13_vector_codes", _vector_codes_sql())
def op13(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.concat(*(F.lpad(F.lower(F.hex(F.col("code")[part])), 2, "0") for part in range(4)))
    return coded.select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", F.col("group_error").alias("label_error"), F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256")
    )


@query("op12_mixing")
def op12(spark, sf_dir):
    mixed, sources = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    aims = spark.createDataFrame([(source, size, float(target)) for source, (size, target) in sources.items()], "of string, source_size bigint, target double")
    source = F.col("members")[0]
    return mixed.join(F.broadcast(aims), source.eqNullSafe(F.col("of"))).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op11_alignment")
def op11(spark, sf_dir):
    from public_tokenizers import path

    aligned = alignment.cross_align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    return aligned.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
