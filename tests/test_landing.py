"""Files that land together end each by its own content."""

import gzip
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators.profile_state import ROWS
from plumbline.streaming import landing


def _land(spark, root, **options):
    landing.land_files(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", **options).awaitTermination()
    return _outcomes(spark, root)


def _outcomes(spark, root):
    return {os.path.basename(r.path): r for r in landing.file_outcomes(spark, f"{root}/out").collect()}


FILES = {
    "plain.csv": "k,v\nx,1\n,2\nx,1\n",
    "reordered.csv": "v,k\n3,y\n4.5,NA\n",
    "lines.csv": 'k,v\n"a\nb",5\n"c ""q"", d",6\n',
    "wider.csv": "k,v,more\r\nx,7,True\r\ny,8\r\n\r\n",
    "header.csv": "k,v\n",
    "empty.csv": "\n \n",
    "open.csv": 'k,v\n"never closed,1\nx,2\n',
    "long.csv": "k,v\nx,1,2\n",
    "names.csv": "a,a,\n1,2,3\n",
}


TORN = ("torn.csv.gz", "mended.csv.gz", "lost.csv.gz")


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    (root / "in").mkdir()
    for name, text in FILES.items():
        (root / "in" / name).write_text(text, encoding="utf-8", newline="")
    (root / "in" / "bytes.csv").write_bytes(b"k,v\n\xff\xfe,1\n")
    for name in TORN:
        (root / "in" / name).write_bytes(b"this is no gzip stream")
    return root, _land(spark, root)


def test_each_file_ends_by_its_own_content(spark, landed):
    root, found = landed
    assert set(found) == {*FILES, "bytes.csv", *TORN}
    cleaned = {name: (r.row_count, r.column_count, r.missing_cells, r.duplicate_rows) for name, r in found.items() if r.status == "cleaned"}
    assert cleaned == {
        "plain.csv": (3, 2, 1, 1),
        "reordered.csv": (2, 2, 1, 0),
        "lines.csv": (2, 2, 0, 0),
        "wider.csv": (2, 3, 1, 0),
        "header.csv": (0, 2, 0, 0),
        "names.csv": (1, 3, 0, 0),
    }
    failed = {name: (r.status, r.kind, r.error) for name, r in found.items() if name not in cleaned and name not in TORN}
    assert failed == {
        "empty.csv": ("error", "permanent", landing.EMPTY),
        "open.csv": ("error", "permanent", landing.OPEN_QUOTE),
        "long.csv": ("error", "permanent", landing.LONG_RECORD),
        "bytes.csv": ("error", "permanent", landing.NOT_UTF8),
    }
    assert {(found[name].status, found[name].kind, found[name].attempt) for name in TORN} == {("retry", "transient", 1)}
    states = landing.landed_states(spark, f"{root}/out").where(F.col("column") != ROWS).orderBy("path", "ordinal").collect()
    kinds = {}
    for r in states:
        kinds.setdefault(os.path.basename(r.path), []).append((r.column, r.dtype))
    assert kinds["reordered.csv"] == [("v", "double"), ("k", "string")]
    assert kinds["wider.csv"] == [("k", "string"), ("v", "bigint"), ("more", "boolean")]
    assert [name for name, _ in kinds["names.csv"]] == ["a", "a.1", "Unnamed: 2"]


def test_a_batch_that_runs_again_leaves_what_it_left(spark, landed):
    root, want = landed
    landing._land(spark, [(r.path, r.modified) for r in want.values()], f"{root}/out", "landed-0", 3)
    assert _outcomes(spark, root) == want


def test_batches_of_any_size_agree(spark, landed):
    root, want = landed
    landing.land_files(spark, f"{root}/in", f"{root}/each", f"{root}/checkpoint-each", files_per_batch=5).awaitTermination()
    each = {os.path.basename(r.path): r for r in landing.file_outcomes(spark, f"{root}/each").collect()}
    assert each == want


def test_attempts_are_counted_and_run_out(spark, landed):
    """Of three files that could not be read one is mended, one lost, and one stays as it is."""
    root, first = landed
    path = root / "in" / "mended.csv.gz"
    at = path.stat().st_mtime_ns
    path.write_bytes(gzip.compress(b"k,v\nz,9\n"))
    os.utime(path, ns=(at, at))
    os.replace(root / "in" / "lost.csv.gz", root / "elsewhere")
    assert landing.retry_landed(spark, f"{root}/out") == 3
    second = _outcomes(spark, root)
    assert {name: (r.status, r.kind, r.attempt, r.row_count) for name, r in second.items() if name in TORN} == {
        "torn.csv.gz": ("retry", "transient", 2, None),
        "mended.csv.gz": ("cleaned", None, 2, 1),
        "lost.csv.gz": ("error", "permanent", 2, None),
    }
    assert all(second[name] == r for name, r in first.items() if name not in TORN)
    assert landing.retry_landed(spark, f"{root}/out") == 1
    assert landing.retry_landed(spark, f"{root}/out") == 0
    dead = {os.path.basename(r.path): r.attempt for r in landing.dead_letters(spark, f"{root}/out").collect()}
    assert dead == {"torn.csv.gz": 3, "lost.csv.gz": 2, "empty.csv": 1, "open.csv": 1, "long.csv": 1, "bytes.csv": 1}


def test_profile_of_all_files_equals_pandas(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frames = [pd.DataFrame({"n": range(i, 400 + i), "x": [j / 4 for j in range(400)], "t": ["u", None] * 200}) for i in range(3)]
    for i, frame in enumerate(frames):
        frame.iloc[:, :: 1 if i else -1].to_csv(tmp_path / "in" / f"{i}.csv", index=False)
    _land(spark, tmp_path)
    whole = pd.concat(frames)
    found = {r.column: r for r in landing.landed_profile(spark, f"{tmp_path}/out").collect()}
    assert {c: (r.rows, r.missing) for c, r in found.items()} == {ROWS: (1200, 0), "n": (1200, 0), "x": (1200, 0), "t": (1200, 600)}
    for c in ("n", "x"):
        assert (found[c].mean, found[c].least, found[c].most) == pytest.approx((whole[c].mean(), whole[c].min(), whole[c].max()))
        assert found[c].std == pytest.approx(whole[c].std())
        assert abs((whole[c] <= found[c].median).mean() - 0.5) <= 0.03
    assert [found[c].dtype for c in ("n", "x", "t")] == ["bigint", "double", "string"]
    quality = landing.landed_quality(spark, f"{tmp_path}/out").collect()
    assert [(r.total_rows, r.total_cells, r.missing_cells) for r in quality] == [(400, 1200, 200)] * 3
    assert all(r.quality_score == round(100 - 200 / 1200 * 40) for r in quality)
