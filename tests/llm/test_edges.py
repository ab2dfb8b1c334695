"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import random
from collections import Counter

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, decontamination, edit_join, fingerprints, langid, lines, packing, repeats, simhash, suffix_array, toxicity, warc
from plumbline.llm.chat_template import TemplateError, compile_template, fold, parse
from plumbline.llm.components import connected_components
from tests.llm import brute

WORDS = "the of and to thing ending other under after water letter number people sound place right along while might story".split()
random.seed(11)
LONG = " ".join(random.choice(WORDS) + str(random.randint(0, 99)) for _ in range(20_000))
PASSAGE = "A passage of words that repeats, with some letters é and ñ, across documents of this small table. " * 4
ROWS = [
    (1, "First text.\n" + PASSAGE + "\nits own end", "en"),
    (1, "First text.\n" + PASSAGE + "\nits own end", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "A text without an id.\n" + PASSAGE, "de"),
    (None, None, None),
    (4, LONG, "en"),
    (5, LONG, "en"),
    (5, "another row with an id that is in use", "fr"),
    (6, "!!! ... 123 ---\n\n\n", "en"),
    (7, "é\U0001f600 short \x00 <|endoftext|> [INST]", "xx"),
    (8, "Other beginning.\n" + PASSAGE.replace("some", "sone") + "\nlast", "en"),
]
SCHEMA = "doc_id bigint, text string, lang string"
# Names that results or steps use.
EXTRA = ["n_words", "score", "features", "prediction", "key", "h", "id", "place", "n", "spans", "bits", "line", "label", "fold", "raw", "n_lines"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({name: F.lit(f"given {name}") for name in EXTRA})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts():
    return [(doc, text) for doc, text, _ in ROWS]


ITEMS = [(10, "passage of words that repeats with some letters"), (11, None), (12, ""), (None, "another row with an id that is in use"), (10, "First text"), (13, "First text"), (13, "First text")]


@pytest.mark.parametrize("block", [100, 2])
def test_decontamination(spark, docs, none, block):
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("window_hash", F.lit(1))
    marked = decontamination.mark_contamination(docs, items, block=block)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], brute.sha(",".join(r["items"])), r["contaminated"]) for r in marked.collect())
    assert got == sorted((r[0] or 0, *r[1:]) for r in brute.decontamination(texts(), ITEMS))
    assert marked.first()["key"] == "given key"
    assert decontamination.mark_contamination(none, items).count() == 0
    assert not decontamination.mark_contamination(docs, items.limit(0)).where("contaminated").count()
    kept = decontamination.decontaminate(docs, items)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in brute.decontamination(texts(), ITEMS) if not r[5])


def test_decontamination_of_spans(spark):
    docs = spark.createDataFrame([(1, "Keep This. Drop, the ONE: two three! Keep that."), (2, "clean"), (3, "drop the one two three")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "drop the one two three")], "item_id int, text string")
    kept = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items, remove="spans").collect()}
    assert kept == {1: "Keep This! Keep that.", 2: "clean", 3: ""}
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, remove="words")


def test_fingerprints(spark, docs, none):
    given_ids = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = fingerprints.with_next(given_ids, "doc_id", "text", ["text"], buckets=3).select("doc_id", "text", "next_text").collect()
    order = sorted(((d, t or "") for d, t in texts()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter(zip(order, [t for _, t in order[1:] + order[:1]]))
    assert Counter(((r["doc_id"], r["text"]), r["next_text"]) for r in rows) == want
    assert fingerprints.with_next(given_ids.limit(0), "doc_id", "text", ["text"], 4).count() == 0
    assert fingerprints.fingerprint_documents(none).count() == 0
    df = spark.createDataFrame([("one\ntwo. Three!\nfour", "four\n\none\ntwo. Three!", "one\ntwo. Three!", "four")], "a string, b string, c string, d string")
    f = df.select(*[fingerprints.fingerprint(F.col(c)).alias(c) for c in "abcd"], fingerprints.fingerprint(F.lit("\n")).alias("z"))
    row = f.select(
        "*", fingerprints.combine(F.col("c"), F.col("d")).alias("cd"), fingerprints.without(F.col("a"), F.col("d")).alias("a_d"),
        fingerprints.without(F.col("a"), F.col("a")).alias("gone"),
    ).first()
    assert row["a"] == row["b"] == row["cd"] and row["a_d"] == row["c"] and row["gone"] == row["z"] == [0] * 26 and row["c"] != row["d"]


@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "a\nb", "\\n", "[INST]", None]), st.text("<|im_end>\\/[INST]s\n é", max_size=30) | st.none()), max_size=12))
@settings(max_examples=60, deadline=None)
def test_chat_texts_come_back(turns):
    render = compile_template(chat.TEMPLATE, chat.FILTERS)
    out = render({"messages": [{"role": role, "text": text} for _, role, text in turns]})
    assert chat.read_turns(out.text()) == [(role or "", text or "") for _, role, text in turns]
    learned = [chat.unescape(out.text()[a:b]) for a, b in out.spans]
    assert learned == [text or "" for _, role, text in turns if role == "assistant"]
    for _, _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL) and chat.unescape(chat.escape(text)) == (text or "")


def test_chat_tables(spark):
    turns = [(1, 0, "user", "q <|im_end|>"), (1, 1, "assistant", None), (1, 1, "assistant", "x" * 50), (1, 1, "assistant", "x" * 50), (None, 0, None, "t"), (2, None, "assistant", "[INST]\\")]
    turns += [(3, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(300)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").withColumn("part", F.lit("x")).repartition(5)
    runs = chat.format_conversations(df, run_chars=200)
    assert runs.where("conv_id = 3").count() > 20
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.read_back(runs)).collect()}
    want = brute.conversations([(c, t, r or "", x) for c, t, r, x in turns if t is not None and c is not None])
    for conv, facts in want.items():
        assert tuple(got[conv][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == facts
    assert got[None]["n_turns"] == 1 and got[2]["loss_sha256"] == brute.sha("[INST]\\")
    assert chat.conversation_digests(chat.read_back(chat.format_conversations(df.limit(0)))).count() == 0


def test_template_language():
    filters = {"upper": lambda v: str(v).upper()}
    render = lambda source, **values: compile_template(source, filters)(values).text()
    assert render("{# no #}a{{ x.y['z'] | upper }}{{ 1 }}", x={"y": {"z": "q"}}) == "aQ1"
    source = "{% if a == 1 %}one{% elif not a or b in 'xyz' %}two{% else %}{{ a ~ '-' ~ b }}{% endif %}"
    assert [render(source, a=a, b=b) for a, b in ((1, "q"), (0, "q"), (2, "x"), (2, "q"))] == ["one", "two", "two", "2-q"]
    assert render("{% for m in messages %}{{ m }},{% endfor %}", messages=[1, 2]) == "1,2,"
    assert fold(parse("x{{ 'a' ~ ('b' | upper) }}{% if 1 == 2 %}no{% else %}y{% endif %}{{ z }}"), filters) == [("text", "xaBy"), ("show", ("name", "z"))]
    for wrong in ("{% if a %}", "{{ a b }}", "{% endfor %}", "{{ x | missing }}", "{{ ().__class__ }}", "{% import os %}", "{{ f(1) }}"):
        with pytest.raises(TemplateError):
            compile_template(wrong, filters)
    assert render("{{ x.__class__ }}", x="text") == ""


def test_language_id(spark, docs, none):
    empty = langid.predict(docs, langid.fit(none))
    assert {(r["lang_pred"], r["score"]) for r in empty.collect()} == {("und", 0.0)}
    found = langid.predict(docs, langid.fit(docs)).collect()
    assert len(found) == len(ROWS) and found[0]["key"] == "given key"
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert langid.predict(none, langid.fit(docs)).count() == 0
    odd = spark.createDataFrame([("½ ² ① Ⅷ",), ("１２ ٣",), ("x²",), ("und½so",)], "text string")
    assert [r["lang_pred"] == "und" for r in langid.predict(odd, langid.fit(docs)).collect()] == [True, True, False, False]


def test_simhash(spark, docs, none):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [(doc, simhash.fingerprint((text or "").encode())) for doc, text in texts()]
    assert [brute.simhash(text) for _, text in texts()] == [p for _, p in prints]
    root = brute.components({p for _, p in prints}, lambda a: [b for _, b in prints if (a ^ b).bit_count() <= 3])
    first = {}
    for doc, p in prints:
        first[root[p]] = min([x for x in (doc, first.get(root[p])) if x is not None], default=None)
    assert got == Counter((doc, f"{p:016x}", first[root[p]]) for doc, p in prints)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d in first.values() if d is not None})


def test_simhash_keeps_a_row_of_each_component(spark):
    """Rows without an id, and rows that share one, are not one document."""
    text = [" ".join(f"{word}{i}" for word in WORDS) for i in range(6)]
    near = text[0].upper()
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (3, text[2]), (7, text[3]), (7, text[4]), (7, text[4]), (None, near), (9, text[5])]
    assert len({brute.simhash(t) for t in text}) == 6
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = [(None, min(near, text[0])), (None, text[1]), (3, text[2]), (7, text[3]), (7, text[4]), (9, text[5])]
    assert Counter(tuple(r) for r in simhash.keep_first(df).collect()) == Counter(want)


@pytest.mark.parametrize("bucket", [2, 7, 512])
def test_covering_finds_every_link(spark, bucket):
    """Crowded buckets are dealt out again, and no link is lost."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            values.add(x)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "bits bigint")
    groups = connected_components(simhash.near_links(df, bucket=bucket)).collect()
    got = {}
    for r in groups:
        got.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    root = brute.components(values, lambda a: [b for b in values if (a ^ b).bit_count() <= 3])
    want = {}
    for v, r in root.items():
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 200)]
    random.shuffle(chain)
    links = spark.createDataFrame(chain, "a int, b int")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200}
    assert connected_components(links.limit(0)).count() == 0


@given(st.text("abé", min_size=4, max_size=24), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["put", "cut", "swap"]), st.sampled_from("abé")), max_size=4), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_edit_distance_and_probes(a, edits, k):
    b = list(a)
    for place, kind, sign in edits:
        place = min(place, len(b) - 1 + (kind == "put"))
        if kind == "put":
            b.insert(place, sign)
        elif b and place >= 0:
            b[place : place + 1] = [] if kind == "cut" else [sign]
    b = "".join(b)
    near = brute.edit_distance(a, b) <= k
    assert edit_join.within(a, b, k) == near
    short, long = sorted((a, b), key=len)
    if near and len(short) > k:
        assert edit_join.common_probe(short, long, k) is not None


@pytest.mark.parametrize("cell", [2000, 3])
def test_line_dedup(spark, cell):
    """Many lines near each other, also in cells; edits of one line at every place."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef ") for _ in range(n)) for n in (24, 25, 26, 40, 41, 90)]
    docs = []
    for i in range(40):
        held = []
        for line in rng.sample(base, 3):
            line = list(line)
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(line))
                line[p : p + 1] = rng.choice([[], ["x"], ["y", line[p]]])
            held.append("".join(line))
        docs.append((i, "\n".join(held + ["short"] * 2)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_lines"], r["removed"], r["sources"], r["n_links"]) for r in lines.mark_lines(df, cell=cell).collect()}
    want = brute.line_dedup(docs)
    assert {doc: (n, links) for doc, (n, _, _, links) in got.items()} == {doc: (n, links) for doc, (n, _, _, links) in want.items()}
    text = {doc: text.split("\n") for doc, text in docs}
    for doc, (_, removed, sources, _) in got.items():
        for at, source in zip(removed, sources):
            left = [line for i, line in enumerate(text[source]) if i not in got[source][1]]
            assert any(line == text[doc][at] or len(line) >= 24 and brute.edit_distance(line, text[doc][at]) <= 2 for line in left)
    if cell >= 40:
        assert got == want


@pytest.mark.parametrize("cell", [2_000, 7])
def test_line_dedup_does_not_follow_chains(spark, cell):
    """Numbered lines are linked all along, but those that differ in more than two signs are different text."""
    docs = [(i, f"Invoice {i:08} of the main office in town") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_lines"], r["removed"], r["sources"], r["n_links"]) for r in lines.mark_lines(df, cell=cell).collect()}
    if cell == 2_000:
        assert got == brute.line_dedup(docs)
    stays = {doc for doc, row in got.items() if not row[1]}
    assert len(stays) >= 3 and all(set(row[2]) <= stays for row in got.values())
    assert all(brute.edit_distance(docs[doc][1], docs[source][1]) <= 2 for doc, row in got.items() for source in row[2])


def test_line_dedup_is_the_same_for_any_cell(spark):
    """Small cells deal the work out; which lines stay does not depend on them."""
    rng = random.Random(1)
    docs = [(i, f"Invoice {rng.randrange(4000):08} of the main office in town") for i in range(120)]
    docs += [(1000 + i, f"{'x' * i}{'y' * (30 - i)} chained") for i in range(30)] + [(None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2)
    got = {r["doc_id"]: (r["n_lines"], r["removed"], r["sources"], r["n_links"]) for r in lines.mark_lines(df, cell=5).collect()}
    assert got == brute.line_dedup(docs)


def test_line_dedup_of_short_lines(spark):
    """Equal lines below the limit of the edit join go as well; near ones and blank ones stay."""
    long = [f"A line of its own, number {word}, which is long enough." for word in ("one hundred", "thousand")]
    docs = [(1, f"All rights reserved.\n\n{long[0]}\n \n"), (2, f"All rights reserved.\n\nAll right reserved.\n{long[1]}\n \nIt.\nIt."), (None, "All rights reserved.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["removed"], r["sources"], r["n_links"]) for r in lines.mark_lines(df).collect()}
    assert got == brute.line_dedup(docs)
    assert {doc: row[1:] for doc, row in got.items()} == {1: ([], [], 0), 2: ([0, 6], [1, 2], 0), None: ([0], [1], 0)}


def test_line_dedup_of_odd_rows(docs, none):
    rows = lines.mark_lines(docs).collect()
    assert len(rows) == len(ROWS) and rows[0]["key"] == "given key"
    by_id = {r["doc_id"]: r for r in rows if r["text"] and r["doc_id"]}
    assert by_id[4]["removed"] == [] and by_id[1]["removed"] == []
    assert [r["removed"] for r in rows if r["doc_id"] is None and r["text"]] == [[1]]
    assert by_id[8]["removed"] == [] and all(not r["removed"] for r in rows if not r["text"])
    kept = lines.dedup_lines(docs)
    assert kept.columns == [c for c in docs.columns if c != "n_lines"] and lines.dedup_lines(none).count() == 0
    assert Counter(r["doc_id"] for r in kept.collect())[5] == 1  # the copy of the long line went


def test_warc(spark):
    html = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a/é \n", html), (2, None, html), (None, "u", html), (3, "u", None), (4, "u", ""), (5, "u", "<p>short</p>"), (6, "u", "<p>short</p>"), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (1, "v", html), (8, "w", LONG)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    got = Counter(tuple(r) for r in warc.archive_pages(pages, archive_bytes=300).drop("url").collect())
    want = brute.warc([(p, h) for p, _, h in rows if p])
    want.append((None, len(html), brute.sha(html), "revisit", 1))
    assert got == Counter(want)
    assert warc.archive_pages(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort"])))


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (4, None), (5, 0), (99, 1)], "doc_id bigint, toxic int")
    one_class = toxicity.score(docs, toxicity.fit(docs, labels))
    assert {(r["score"], r["predicted"]) for r in one_class.collect()} == {(0.0, 0)}
    assert toxicity.score(docs, toxicity.fit(none, labels)).count() == len(ROWS)
    insults = [(i, f"you are {'a stupid idiot, really' if i % 3 == 0 else 'a good friend, really'} number {i}", i % 3 == 0) for i in range(300)]
    train = spark.createDataFrame([(i, t) for i, t, _ in insults], "doc_id bigint, text string")
    model = toxicity.fit(train, spark.createDataFrame([(i, int(y)) for i, _, y in insults], "doc_id bigint, toxic int"))
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(ROWS) and scored[0]["features"] == "given features" and all(0 <= r["score"] <= 1 for r in scored)
    asked = spark.createDataFrame([(1, "what a STUPID idiot you are"), (2, "st.upid 1d10t, you!"), (3, "a very good friend")], "doc_id int, text string")
    assert [r["predicted"] for r in toxicity.score(asked, model).orderBy("doc_id").collect()] == [1, 1, 0]
    assert toxicity.score(none, model).count() == 0


def test_packing(spark, docs, none):
    rows = packing.pack_documents(docs, path("word_bpe_49k.json")).collect()
    want = Counter()
    for row in texts():
        want.update({(*key, *value): 1 for key, value in brute.token_pieces([row], path("word_bpe_49k.json")).items()})
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(none, path("word_bpe_49k.json")).count() == 0
    ids = packing.document_pieces(docs.where("doc_id = 3"), path("word_bpe_49k.json"), keep_ids=True).first()["ids"]
    assert bytes(ids) == b"\1\0\0\0"


def least_sequences(histogram, capacity, k):
    """A bound: pieces over ``capacity - k`` stand alone among those of ``k`` or more, which fill what the other large ones leave, by mass and by number."""
    alone = sum(n for x, n in histogram.items() if x > capacity - k)
    large = {x: n for x, n in histogram.items() if capacity // 2 < x <= capacity - k}
    small = {x: n for x, n in histogram.items() if k <= x <= capacity // 2}
    mass = sum(x * n for x, n in small.items()) - sum((capacity - x) * n for x, n in large.items())
    count = sum(small.values()) - sum((capacity - x) // k * n for x, n in large.items())
    every = -(-sum(x * n for x, n in histogram.items()) // capacity)
    return max(every, alone + sum(large.values()) + max(0, -(-mass // capacity), -(-count // (capacity // k))))


@given(st.dictionaries(st.integers(1, 256), st.integers(1, 500), max_size=60))
@example({86: 17})
@example({86: 7, 171: 5})
@settings(max_examples=200, deadline=None)
def test_packing_plan(histogram):
    plan = packing.packing_plan(histogram, capacity=256, grains=16)
    placed = Counter()
    for runs, n in plan:
        assert sum(length * q for length, q in runs) <= 256
        for length, q in runs:
            placed[length] += q * n
    assert placed == Counter(histogram)
    least = max(least_sequences(histogram, 256, k) for k in range(1, 129))
    assert sum(n for _, n in plan) <= least * 1.25 + 1


@given(st.lists(st.text("İΣσé'.,!?_ 1٣<|>日́ \n", max_size=30), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_tokenizers(odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    for text, found in zip(odd, packing.token_bytes(odd, path("word_bpe_49k.json"))):
        assert found == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


@given(st.lists(st.binary(min_size=8, max_size=60) | st.text("ab", min_size=8, max_size=60).map(str.encode), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_two_stage_sorting(texts):
    import numpy as np

    block = suffix_array.Block(texts, np.array([len(t) - 7 for t in texts]))
    ranked = block.suffix_array(64).tolist()
    cut = {}
    for start, t in zip(block.start.tolist(), texts):
        cut.update({start + i: t[i:] for i in range(len(t))})
    assert [cut[p] for p in ranked] == sorted(cut[p] for p in ranked)
    count = Counter(t[i : i + 8] for t in texts for i in range(len(t) - 7))
    assert block.repeated(8).tolist() == [count[t[i : i + 8]] > 1 for t in texts for i in range(len(t) - 7)]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats(spark, docs, none, hot):
    rng = random.Random(9)
    more = [(20 + i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 80))) + PASSAGE[rng.randint(0, 60) : rng.randint(150, 300)] + str(i)) for i in range(30)]
    more += [(60, "ab" * 300), (61, "a" * 199), (62, "c" * 200), (63, "c" * 201)]
    both = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame(more, "doc_id bigint, text string").withColumn("key", F.lit("k")))
    got = Counter(tuple(r) for r in repeats.remove_repeats(both, hot=hot, block_bytes=2_000).collect())
    assert got == Counter(brute.repeats(texts() + more))
    assert repeats.remove_repeats(none).count() == 0
    kept = {r["doc_id"]: r for r in repeats.remove_repeats(both, keep_bytes=True).where("doc_id in (8, 60)").collect()}
    assert bytes(kept[60]["kept"]) == b"" and kept[60]["removed"] == [[0, 600]]


def test_pipeline_stages(spark, sf_dir, docs, none):
    given = {name: f"given {name}" for name in EXTRA}
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, none):
            out = stage(spark, table, sf_dir)
            found = out.collect()
            if name != "best_fit_packing":
                assert out.columns == table.columns and len(found) <= table.count()
                assert all({n: r[n] for n in EXTRA} == given for r in found)
            assert table is docs or not found


def test_packing_gives_back_what_it_remembers():
    tokenizer = path(corpus_pipeline.TOKENIZER)
    texts = ["Some words, and some (more) words."]
    ids = list(packing.token_bytes(texts, tokenizer))
    assert packing._Ids.of(tokenizer).chunks and packing._Ids.of(tokenizer).words
    packing.forget()
    assert not packing._Ids.of(tokenizer).chunks and not packing._Ids.of(tokenizer).words
    assert list(packing.token_bytes(texts, tokenizer)) == ids
