"""Alignment, mixing and vector codes against plain versions, on odd tables."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F

from plumbline.llm import alignment, mixing, vector_codes
from plumbline.llm.cover_tree import CoverTree, squared
from plumbline.llm.queries import QUERIES
from tests.llm import brute

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
EXTRA = ["row", "hash", "pattern", "size", "members", "pairs", "times", "n", "best", "id", "grp", "code", "error", "n_a", "of", "low", "high", "copies", "key"]
ODD = [
    None, "", " ", "  two  spaces ", "a", "\n\nlines\n \n", "tab\tand\x0bmore\x0c", "nul \x00 here", "▁piece", "of ▁ inside", "<s> and </s> <|endoftext|> <unk> <0x41>",
    "don't we'll 123 4567 ,,, !!", "é ñ ﬁ 日本語 漢字 \U0001f600", "x" * 700, "　wide space ᠎ sep \x1c \x85", "word " * 300, "ab " * 5 + "\n", "the end",
]


def with_extra(df):
    return df.withColumns({name: F.lit(f"given {name}") for name in EXTRA if name not in df.columns})


@given(st.data())
@settings(max_examples=300, deadline=None)
def test_align(data):
    n = data.draw(st.integers(1, 60))
    inner = st.sets(st.integers(1, n))
    ends = [np.array(sorted(data.draw(inner) | {n}), dtype=np.int64) for _ in range(2)]
    groups, links_a, links_b = alignment.align(*map(memoryview, ends))
    starts = [np.concatenate([[0], e[:-1]]) for e in ends]
    want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
    assert list(zip(links_a, links_b)) == want
    common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    assert [int(ends[0][g[2] - 1]) for g in groups] == [int(ends[1][g[3] - 1]) for g in groups] == common
    assert [g[:2] for g in groups[1:]] == [g[2:] for g in groups[:-1]] and groups[0][:2] == (0, 0)


@given(st.lists(st.text("aé'.,!?_ 1日▁<|>s/\n\t\x1c　᠎\U0001f600", max_size=40), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_chunks_give_the_tokenizers_tokens(texts):
    aligner = alignment.Aligner.of(A, B)
    want = {doc: row for doc, *row in brute.alignments(list(enumerate(texts)), A, B)}
    for doc, text in enumerate(texts):
        (n_a, n_b, n_groups, n_links, digest), _, times = alignment._document(aligner, text)
        assert [n_a, n_b, n_groups, n_links, digest] == [*want[doc][:4], want[doc][6]]
        assert times.sum() == n_links


@pytest.mark.parametrize(("head", "stretch", "cache"), [(1_000_000, 1_000_000, 500_000), (20, 30, 10), (0, 1, 0)])
def test_alignment(spark, monkeypatch, head, stretch, cache):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "CACHE", cache)
    rows = [(i % 15 if i % 7 else None, text) for i, text in enumerate(ODD)] * 2 + [(100 + i, "the common words of the table " + "and more " * i) for i in range(20)]
    docs = with_extra(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    found = alignment.cross_align(docs, A, B, head=head)
    got = found.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute.alignments(rows, A, B))
    assert alignment.cross_align(docs.limit(0), A, B).count() == 0
    assert alignment.cross_align(docs.where("text is null"), A, B, head=head).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]


def test_alignment_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_alignment"](spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(brute.alignments(docs, A, B))


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    out, free = dict.fromkeys(order, Fraction(0)), set(order)
    left = Fraction(3, 2) * sum(sizes.values())
    while left and free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        left = Fraction(0)
        for s in list(free):
            out[s] += share[s]
            if out[s] > 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = Fraction(2 * sizes[s])
                free.discard(s)
    return out


@given(st.dictionaries(st.none() | st.text("abé\U0001f600", max_size=2), st.integers(0, 1000), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_targets(sizes):
    got = mixing.targets(sizes, sum(sizes.values()))
    assert got == plain_targets(sizes)
    assert sum(got.values()) == Fraction(3, 2) * sum(sizes.values()) and all(got[s] <= 2 * sizes[s] for s in sizes)


@given(st.data())
@settings(max_examples=100, deadline=None)
def test_route(data):
    sources = ["a", "b", None][: data.draw(st.integers(1, 3))]
    names = ["p", "q", "r", "s"][: data.draw(st.integers(1, 4))]
    members = {p: data.draw(st.lists(st.sampled_from(sources), unique=True)) for p in names}
    sizes = {p: data.draw(st.integers(0, 4)) for p in names}
    quotas = {s: data.draw(st.integers(0, 8)) for s in sources}
    flow = mixing.route(sizes, members, quotas, most=2)
    cost = lambda f: sum(max(0, f[p] - sizes[p]) for p in names)

    def feasible(f):
        """Hall's condition over sets of sources, for flows out of patterns."""
        for bits in range(1, 1 << len(names)):
            some = [p for i, p in enumerate(names) if bits >> i & 1]
            if sum(f[p] for p in some) > sum(quotas[s] for s in {s for p in some for s in members[p]}):
                return False
        return True

    assert all(0 <= flow[p] <= 2 * sizes[p] for p in names) and feasible(flow)
    best = (0, 0)
    for code in range(math.prod(2 * sizes[p] + 1 for p in names)):
        f = {}
        for p in names:
            code, f[p] = divmod(code, 2 * sizes[p] + 1)
        if feasible(f):
            best = max(best, (sum(f.values()), -cost(f)))
    assert (sum(flow.values()), -cost(flow)) == best


def test_words(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0cd\re\n", "日本 語　x", "x y", "\x1cz \x85", "11 1  1", "\x00 \x01"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.words(F.col("text")).alias("n")).collect()
    import re

    assert {r["text"]: r["n"] for r in rows} == {t: len(re.findall("[^\x20\x09-\x0d]+", t)) for t in texts}


def mixed(spark, rows, **options):
    docs = with_extra(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3))
    found, sources = mixing.mix(docs, F.array("source"), **options)
    return [(r["key"], r["members"][0], r["size"], r["copies"]) for r in found.collect()], sources


@pytest.mark.parametrize("window", [64, 2])
def test_mixing(spark, monkeypatch, window):
    monkeypatch.setattr(mixing, "WINDOW", window)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", None, "é", "\U0001f600"])) for i in range(600)]
    rows += [(None, "same row of words", "a")] * 300 + [(7, None, "b"), (8, "", "empty"), (9, "long " * 900, "b")]
    got, sources = mixed(spark, rows)
    assert Counter((k, s, n) for k, s, n, _ in got) == Counter((k, s, len((t or "").split())) for k, t, s in rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    assert {s: v for s, v in sources.items()} == {s: (sizes[s], want[s]) for s in sizes}
    taken = Counter()
    for _, source, size, copies in got:
        assert 0 <= copies <= 2
        taken[source] += size * copies
    for source, target in want.items():
        assert abs(taken[source] - target) <= 20 + (0 if window == 64 else 20), source
    again, _ = mixed(spark, rows[::-1])
    assert sorted(again, key=repr) == sorted(got, key=repr)


def test_mixing_small_and_empty(spark):
    assert mixed(spark, [])[0] == []
    assert mixed(spark, [(1, None, None), (2, "", "a")])[0] in ([(1, None, 0, 0), (2, "a", 0, 0)], [(2, "a", 0, 0), (1, None, 0, 0)])
    got, sources = mixed(spark, [(1, "one two", "a")])
    assert got[0][3] in (1, 2) and sources == {"a": (2, Fraction(3))}


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(40)] + [(50, "x " * 10, None), (51, "x " * 10, []), (52, "y " * 100, ["b", "b"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>")
    found, sources = mixing.mix(docs, "sources", weights=(1, 1), share=Fraction(1))
    got = {r["key"]: r for r in found.collect()}
    assert {s: size for s, (size, _) in sources.items()} == {"a": 400, "b": 300} and got[50]["copies"] == got[51]["copies"] == 0
    # 520 words are asked for, 260 of each source; nothing needs a repetition.
    assert {t for _, t in sources.values()} == {Fraction(260)}
    assert max(r["copies"] for r in got.values()) == 1
    assert abs(sum(r["size"] * r["copies"] for r in got.values()) - 500) <= 20


def test_mixing_query(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_mixing"](spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    sizes, taken = Counter(), Counter()
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = plain_targets(sizes)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and r["target"] == float(want[source])
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op12_mixing"](spark, sf_dir).collect()))


def plain_codes(rows, parts, size, rounds, scale=1024):
    """(id, group, code, error, group error), codebook digest; Python integers throughout."""
    kept = [(i, g, [math.floor(Fraction(x) * scale) for x in v], v) for i, g, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    if not kept:
        return Counter(), hashlib.sha256(b"").hexdigest()
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v, _ in kept[:size]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, _, v, _ in kept:
                held[near(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, book)]
    found = []
    for i, g, v, _ in kept:
        each = [near(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, g, tuple(k for _, k in each), sum(d for d, _ in each)))
    total = Counter()
    for _, g, _, e in found:
        total[g] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((*f, total[f[1]]) for f in found), digest


VECTORS = [
    (5, "x", [0.1, -0.2, 0.3, 0.4]), (5, "x", [0.1, -0.2, 0.3, 0.4]), (1, None, [0.0, 0.0, -0.0, 0.001]), (None, "y", [1.0, 1.0, 1.0, 1.0]), (2, "y", None), (3, "y", []),
    (4, "y", [None, 1.0, 1.0, 1.0]), (6, "y", [float("nan"), 1.0, 1.0, 1.0]), (7, "x", [float("inf"), 1.0, 1.0, 1.0]), (8, None, [9.5, -9.5, 1000.25, -3.0]),
    (8, None, [-9.5, 9.5, -1000.25, 3.0]), (9, "z", [60000.0, -60000.0, 1.0, 2.0]), (10, "z", [60001.0, -60000.0, 1.0, 2.0]),
]


@pytest.mark.parametrize(("size", "parts", "block"), [(256, 4, 8_192), (3, 2, 4), (1, 1, 1)])
def test_vector_codes(spark, size, parts, block):
    rng = random.Random(size)
    rows = VECTORS + [(20 + i % 50, rng.choice("xyz"), [rng.choice([0.5, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(120)] + [(90, "hot", [0.25] * 4)] * 60
    df = with_extra(spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>").repartition(3))
    coded, books = vector_codes.compress(df, parts=parts, size=size, rounds=2, block=block)
    want, digest = plain_codes(rows, parts, size, 2)
    assert Counter((r["id"], r["grp"], tuple(r["code"]), r["error"], r["group_error"]) for r in coded.collect()) == want
    assert vector_codes.books_digest(books) == digest


def test_vector_codes_of_nothing_and_of_odd_lengths(spark):
    schema = "vec_id bigint, label string, embedding array<float>"
    for rows in ([], [(1, "a", None), (2, "b", [])]):
        coded, books = vector_codes.compress(spark.createDataFrame(rows, schema))
        assert coded.collect() == [] and books == []
    for rows in ([(1, "a", [1.0, 2.0, 3.0])], [(1, "a", [1.0] * 4), (2, "a", [1.0] * 8)], [(1, "a", [1e30] * 4)]):
        with pytest.raises(Exception, match="length|large"):
            vector_codes.compress(spark.createDataFrame(rows, schema))[0].collect()


def test_decoded_vectors_are_near(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, books = vector_codes.compress(df)
    rows = {r["id"]: r for r in coded.collect()}
    for r in df.collect():
        near = vector_codes.decode(rows[r["vec_id"]]["code"], books)
        whole = np.floor(np.array(r["embedding"], dtype=np.float64) * 1024)
        assert ((whole - near * 1024) ** 2).sum() == rows[r["vec_id"]]["error"]


@given(st.integers(0, 10_000), st.integers(1, 4), st.sampled_from([3, 50, 3_000_000, 2**25]))
@settings(max_examples=60, deadline=None)
def test_cover_tree(seed, depth, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread, (5, depth))
    rows = centres[rng.integers(0, 5, 300)] + rng.integers(-2, 3, (300, depth))
    tree = CoverTree.from_bytes(CoverTree.build(rows, leaf=3).to_bytes())
    assert (tree.points[tree.place] == rows).all()
    for (low, high, first, last), radius in zip(tree.nodes.tolist(), tree.radius.tolist()):
        away = np.sqrt(squared(tree.points[low:high], tree.points[low : low + 1])[:, 0].astype(float))
        assert away.max() <= radius * (1 + 1e-12)
        if first < last:
            below = tree.nodes[first:last]
            assert below[0, 0] == low and below[-1, 1] == high and (below[1:, 0] == below[:-1, 1]).all()
            scale = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            apart = np.sqrt(squared(tree.points[below[:, 0]], tree.points[below[:, 0]]).astype(float))
            assert (apart[~np.eye(len(below), dtype=bool)] > scale).all() and (tree.radius[first:last] <= scale).all()
    entries = np.concatenate([centres, centres[:2], rows[:4]])
    away = squared(rows, entries)
    nearest, error = tree.codes(entries)
    assert (nearest == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
    count, total = tree.sums(entries)
    assert (count == np.bincount(nearest, minlength=len(entries))).all()
    assert all((total[k] == rows[nearest == k].sum(axis=0)).all() for k in range(len(entries)))


def test_toxicity_sample_is_bounded_for_hot_keys(spark):
    """A third of the labels without key, a third of one key, and that key on a third of the documents."""
    from plumbline.llm import toxicity

    labels = [(None, 1)] * 2000 + [(7, 0)] * 1999 + [(7, 1)] + [(k, k % 2) for k in range(100, 2100)]
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    texts = [(None, f"none {i}") for i in range(2000)] + [(7, f"hot {i}") for i in range(2000)] + [(k, f"own {k}") for k in range(100, 2100)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for sample in (200, 10_000):
        rows, counts = toxicity.labelled_rows(docs, labels, "text", "doc_id", "toxic", sample)
        found = [(r.text.split()[0], r.label) for r in rows.collect()]
        assert len(found) == sum(counts.values()) <= 2 * sample
        assert ("none", 1) not in found and {label for kind, label in found if kind == "hot"} <= {1}
        if sample == 10_000:
            assert found.count(("hot", 1)) == 2000 and sum(kind == "own" for kind, _ in found) == 2000
    hot = labels.where("doc_id = 7")
    rows, counts = toxicity.labelled_rows(docs, hot, "text", "doc_id", "toxic", 100)
    assert 50 <= rows.count() == sum(counts.values()) <= 200
