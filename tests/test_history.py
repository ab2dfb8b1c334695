"""Versions of a table: what readers see, who wins, and what is left."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from plumbline.operators.clean import CleaningOptions
from plumbline.plans import history
from plumbline.plans.history import VersionConflict, VersionedTable
from plumbline.plans.versions import NothingToUndo

ROWS = [("a", 1.0), ("a", 1.0), ("b", None), (None, None), (" c", 4.0)]


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark.createDataFrame(ROWS, "k string, v double"), "people", f"{tmp_path}/people")


def _all(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_follow_each_other_and_stay_readable(table, tmp_path):
    with pytest.raises(NothingToUndo):
        table.undo()
    pinned = table.read()
    table.apply(CleaningOptions(remove_duplicates=True))
    cleaned = table.read()
    table.apply(CleaningOptions(drop_empty_rows=True))
    assert table.read().count() == 4 and ("a", 1.0) in _all(table.read()), "cleaning starts from the original"
    table.undo()
    assert _all(table.read()) == _all(pinned) == sorted(ROWS, key=str) and cleaned.count() == 4
    with pytest.raises(NothingToUndo):
        table.undo()
    found = [(r.version, r.kind, r.total_rows, r.missing_cells, r.duplicate_rows) for r in table.history().orderBy("version").collect()]
    assert found == [(1, "stored", 5, 3, 1), (2, "cleaned", 4, 3, 0), (3, "cleaned", 4, 1, 1), (4, "undone", 5, 3, 1)]
    first, last = table.commit(1), table.head()
    assert (last.data, last.profile, last.schema) == (first.data, first.profile, "struct<k:string,v:double>")
    assert table.commit(2).operations == ["Removed 1 duplicate row(s)"]


def test_copies_carry_the_profile_under_their_own_name(table, tmp_path):
    table.apply(CleaningOptions(remove_duplicates=True))
    copy = table.copy(f"{tmp_path}/copy")
    assert (copy.head().name, copy.head().version, copy.head().kind) == ("people (copy)", 1, "copied")
    assert copy.head().profile == table.head().profile and _all(copy.read()) == _all(table.read())
    with pytest.raises(NothingToUndo):
        copy.undo()
    copy.apply(CleaningOptions(drop_empty_rows=True))
    assert (copy.read().count(), table.read().count()) == (3, 4)
    assert table.copy(f"{tmp_path}/old", "old", version=1).read().count() == 5


def test_a_failed_apply_leaves_the_version(table, monkeypatch):
    def fails(df):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(history, "profile_of", fails)
        with pytest.raises(RuntimeError):
            table.apply(CleaningOptions(remove_duplicates=True))
    assert table.head().version == 1 and table.read().count() == 5
    assert table.expire(1) == 1, "what the writer left"
    assert table.apply(CleaningOptions(remove_duplicates=True)).version == 2


def test_of_two_writers_one_wins(table):
    def write(options):
        try:
            return table.apply(options, seen=1).operations
        except VersionConflict:
            return None

    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(write, [CleaningOptions(remove_duplicates=True), CleaningOptions(drop_empty_rows=True)]))
    assert done.count(None) == 1
    assert table.head().version == 2 and [table.head().operations] == [d for d in done if d]
    with pytest.raises(VersionConflict):
        table.undo(seen=1) if table.commit(1).data != table.commit(1).original else table.apply(CleaningOptions(), seen=1)


def test_a_root_holds_one_table_and_versions_expire(table, spark, tmp_path):
    with pytest.raises(VersionConflict):
        VersionedTable.create(spark.range(3).toDF("x"), "other", table.root)
    with pytest.raises(LookupError):
        VersionedTable(spark, f"{tmp_path}/none").head()
    assert table.read().columns == ["k", "v"]
    table.apply(CleaningOptions(remove_duplicates=True))
    table.apply(CleaningOptions(drop_empty_rows=True))
    assert table.expire(99) == 2, "a lost table and the first cleaning"
    assert len(os.listdir(f"{table.root}/data")) == 2 and table.read().count() == 4
    assert [r.version for r in table.history().orderBy("version").collect()] == [1, 3]
    table.undo()
    assert table.read().count() == 5


def test_an_empty_table(spark, tmp_path):
    table = VersionedTable.create(spark.createDataFrame([], "k string, v double"), "none", f"{tmp_path}/none")
    assert (table.head().profile["total_rows"], table.head().profile["quality_score"], table.read().count()) == (0, None, 0)
