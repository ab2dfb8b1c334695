"""Each stage of the pipeline against a plain version, on its own input."""

import pytest
from public_tokenizers import path

import corpus_pipeline
from plumbline.llm import langid
from plumbline.session import materialize
from tests.llm import brute


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf_dir), name)
        out.append((docs, after))
        docs = after
    return dict(zip((name for name, _ in corpus_pipeline.STAGES), out))


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns_stay(steps):
    for name, (before, after) in steps.items():
        if name != "best_fit_packing":
            assert after.dtypes == before.dtypes, name


def test_language_id(spark, sf_dir, steps):
    before, after = steps["language_id"]
    model = langid.fit(before.where(langid.remainder("doc_id", 4) != 2))
    scorer = langid._Scorer(model)
    want = [(doc, text) for doc, text in rows(before) if scorer.predict(text)[0] != "und"]
    assert rows(after) == want
    assert want == [(doc, text) for doc, text in rows(before) if any(c.isalpha() for c in text or "")]


def test_line_dedup(steps):
    before, after = steps["line_dedup"]
    judged = brute.line_dedup(rows(before))
    want = []
    for doc, text in rows(before):
        lines = text.split("\n")
        if len(judged[doc][1]) < len(lines):
            want.append((doc, "\n".join(line for at, line in enumerate(lines) if at not in judged[doc][1])))
    assert rows(after) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_simhash(steps):
    before, after = steps["simhash_near_dedup"]
    groups = brute.simhash_components(rows(before))
    assert rows(after) == [(doc, text) for doc, text in rows(before) if groups[doc][1] == doc]


def test_decontamination(spark, sf_dir, steps):
    before, after = steps["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.decontamination(rows(before), items) if r[5]}
    assert dirty and rows(after) == [r for r in rows(before) if r[0] not in dirty]


def test_packing(spark, sf_dir, steps):
    before, after = steps["best_fit_packing"]
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in after.collect()}
    assert got == brute.token_pieces(rows(before), path("word_bpe_49k.json"))


def test_run_is_the_stages(spark, sf_dir, steps):
    assert corpus_pipeline.ORACLE_SQL is None
    sort = lambda df: sorted(map(tuple, df.drop("sequence_id", "offset").collect()))
    assert sort(corpus_pipeline.run(spark, sf_dir)) == sort(steps["best_fit_packing"][1])
