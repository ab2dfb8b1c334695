"""The corpus queries over the given tables, against SQL or plain versions."""

import duckdb
import pytest

from plumbline.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm import brute


@pytest.fixture(scope="module")
def tables(sf_dir):
    read = lambda sql: duckdb.sql(sql).fetchall()
    return {
        "documents": read(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'"),
        "pages": read(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'"),
        "conversations": read(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'"),
        "labels": dict(read(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'")),
        "langs": dict(read(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'")),
    }


def result(spark, sf_dir, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).select(*columns).collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), QUERIES[name], ORACLES[name], sf_dir) is None


def test_fingerprints(spark, sf_dir, tables):
    rows = [r.asDict() for r in QUERIES["op2_fingerprints"](spark, sf_dir).collect()]
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(brute.edits(tables["documents"]))
    texts = dict(tables["documents"])
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in rows if r["n_chars"] > 2000]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5
    assert sum(r["near_next"] for r in long) / len(long) < 0.15


def test_chat_format(spark, sf_dir, tables):
    says = "</s>[INST] ok [/INST]"
    want = brute.conversations([*tables["conversations"], (-1, 0, "user", says), (-1, 1, "assistant", says)])
    got = result(spark, sf_dir, "op3_chat_format", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(want)


def test_language_id(spark, sf_dir, tables):
    rows = QUERIES["op4_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(tables["documents"])
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == tables["langs"][r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_simhash(spark, sf_dir, tables):
    got = result(spark, sf_dir, "op5_simhash", "doc_id", "fingerprint", "component_id")
    assert {r[0]: r[1:] for r in got} == brute.simhash_components(tables["documents"]) and len(got) == len(tables["documents"])


def test_warc(spark, sf_dir, tables):
    got = QUERIES["op7_warc"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(brute.warc(tables["pages"]))


def test_packing(spark, sf_dir, tables):
    from public_tokenizers import path

    rows = QUERIES["op9_packing"](spark, sf_dir).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    assert got == brute.token_pieces(tables["documents"], path("word_bpe_49k.json")) and len(got) == len(rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert len(sequences) <= least * 1.01 + 1


def test_line_dedup(spark, sf_dir, tables):
    rows = QUERIES["op6_line_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_lines"], r["removed"], r["sources"], r["n_links"]) for r in rows} == brute.line_dedup(tables["documents"])
    assert all(r["n_removed"] == len(r["removed"]) == len(r["sources"]) for r in rows)


def test_toxicity(spark, sf_dir, tables):
    rows = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert len(rows) == len(tables["documents"])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in tables["labels"]]
    right = sum(r["predicted"] == tables["labels"][r["doc_id"]] for r in held)
    assert right >= 0.8 * len(held)


def test_suffix_dedup(spark, sf_dir, tables):
    got = result(spark, sf_dir, "op10_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeats(tables["documents"]))
