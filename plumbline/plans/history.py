"""Versions of a table under one root: an append-only log of commits, each with its data, its profile and what was done.

``log`` has one small JSON file per version, ``data`` a folder of parquet files per written state of the table. A version is written
in two steps: its data under a name nobody knows, then its commit under the next number. The commit is renamed into
place and the rename fails if the number is taken, so of two writers that saw the same head one wins and the other gets
``VersionConflict``; a writer that fails before leaves the head as it was. Nothing is overwritten: readers pinned to a version
go on until ``expire`` removes it. The rename must refuse an existing target in one step, as that of HDFS does;
object stores need a file system layer that gives this.

Profiles are taken once, when a version is written, and stored in its commit: ``history`` reads no data. An undo is a commit
that points to the data and the profile of the original; a copy is a table of its own whose first commit carries the
profile under the new name.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import side_by_side
from plumbline.operators.clean import CleaningOptions, clean
from plumbline.operators.profile import iqr_bounds, outside, quality_report, score_expression, table_size
from plumbline.plans.versions import NothingToUndo

STORED, CLEANED, UNDONE, COPIED = "stored", "cleaned", "undone", "copied"
PROFILE = (
    "total_rows bigint, total_cells bigint, missing_cells bigint, duplicate_rows bigint, outlier_cells bigint, quality_score int, "
    "missing_columns array<string>, outlier_columns array<string>, suggestions array<string>"
)
COMMIT = f"name string, version int, kind string, data string, original string, origin int, operations array<string>, schema string, profile struct<{PROFILE}>"


class VersionConflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Commit:
    name: str
    version: int
    kind: str
    data: str  # folder under the root, as is the original, from which cleaning starts
    original: str
    origin: int  # the version that wrote the original
    operations: list[str]
    schema: str
    profile: dict


def profile_of(df: DataFrame) -> dict:
    """The quality report of a table with the counts behind its score; an empty table has no score."""
    fences = iqr_bounds(df)
    outliers = sum((F.count_if(outside(c, f)) for c, f in fences.items()), F.lit(0).cast("bigint"))
    size = table_size(df, outliers.alias("outlier_cells")).drop("total_rows")
    facts = side_by_side(quality_report(df, fences), size)
    score = F.when((F.col("total_rows") > 0) & (F.col("total_cells") > 0), score_expression())
    return facts.withColumn("quality_score", score).first().asDict()


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs

    @classmethod
    def create(cls, df: DataFrame, name: str, root: str) -> VersionedTable:
        """Store ``df`` as version 1 under a root without versions."""
        table = cls(df.sparkSession, root)
        table._write(df, name, 1, STORED, None, [])
        return table

    def head(self) -> Commit:
        return self.commit(self._versions()[-1])

    def commit(self, version: int) -> Commit:
        row = self.spark.read.schema(COMMIT).json(self._log(version)).first().asDict(recursive=True)
        return Commit(**row)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last; later commits do not change them."""
        return self._rows(self.head() if version is None else self.commit(version))

    def history(self) -> DataFrame:
        """A row per version: ``COMMIT`` with the profile's columns beside it."""
        commits = self.spark.read.schema(COMMIT).json([self._log(v) for v in self._versions()])
        return commits.select(*[c for c in commits.columns if c != "profile"], "profile.*")

    def apply(self, options: CleaningOptions, seen: int | None = None) -> Commit:
        """Clean the original, whatever the head is, and commit the result after version ``seen`` (the head)."""
        base = self.head() if seen is None else self.commit(seen)
        result = clean(self.spark.read.parquet(f"{self.root}/{base.original}"), options)
        return self._write(result.frame, base.name, base.version + 1, CLEANED, base, result.operations)

    def undo(self, seen: int | None = None) -> Commit:
        """Go back to the original; no data is written or read."""
        base = self.head() if seen is None else self.commit(seen)
        if base.data == base.original:
            raise NothingToUndo("This dataset has no cleaning to undo")
        return self._put(replace(self.commit(base.origin), version=base.version + 1, kind=UNDONE, operations=[]))

    def copy(self, root: str, name: str | None = None, version: int | None = None) -> VersionedTable:
        """A table of its own that begins with a version of this one; the profile goes along under the new name."""
        base = self.head() if version is None else self.commit(version)
        table = VersionedTable(self.spark, root)
        data = f"data/{uuid.uuid4().hex}"
        self._rows(base).write.parquet(f"{table.root}/{data}")
        table._put(replace(base, name=name or f"{base.name} (copy)", version=1, kind=COPIED, data=data, original=data, origin=1))
        return table

    def expire(self, before: int) -> int:
        """Forget versions under ``before``, but neither the head nor what an undo of a later one goes back to, and remove data that no
        version names; for times without writers. Returns the number of folders removed, those of failed writers included."""
        versions = self._versions()
        kept = {v: self.commit(v) for v in versions if v >= min(before, versions[-1])}
        kept |= {v: self.commit(v) for v in {c.origin for c in kept.values()} - kept.keys()}
        named = {c.data.rsplit("/", 1)[-1] for c in kept.values()}
        for v in set(versions) - kept.keys():
            self._files().delete(self._path(self._log(v)), False)
        gone = [f.getPath() for f in self._files().listStatus(self._path(f"{self.root}/data")) if f.getPath().getName() not in named]
        for path in gone:
            self._files().delete(path, True)
        return len(gone)

    def _rows(self, commit: Commit) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{commit.data}")

    def _write(self, df: DataFrame, name: str, version: int, kind: str, base: Commit | None, operations: list[str]) -> Commit:
        data = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{data}")
        written = self.spark.read.parquet(f"{self.root}/{data}")
        original, origin = (base.original, base.origin) if base else (data, version)
        return self._put(Commit(name, version, kind, data, original, origin, operations, written.schema.simpleString(), profile_of(written)))

    def _put(self, commit: Commit) -> Commit:
        """Write the commit, unless its number is taken."""
        rename = getattr(self._fs, "Options$Rename")
        no_options = self.spark.sparkContext._gateway.new_array(rename, 1)
        no_options[0] = rename.NONE
        draft = self._path(f"{self.root}/draft/{uuid.uuid4().hex}")
        out = self._files().create(draft, False)
        out.write(bytearray(json.dumps(asdict(commit)).encode()))
        out.close()
        target = self._path(self._log(commit.version))
        self._files().mkdirs(target.getParent())
        try:
            self._fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, no_options)
        except Py4JJavaError as error:
            self._files().delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                raise VersionConflict(f"Version {commit.version} of {self.root} has been committed by another writer") from None
            raise
        return commit

    def _versions(self) -> list[int]:
        try:
            found = self._files().listStatus(self._path(f"{self.root}/log"))
        except Py4JJavaError as error:
            raise LookupError(f"No table in {self.root}") from error
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found if f.getPath().getName().endswith(".json"))

    def _log(self, version: int) -> str:
        return f"{self.root}/log/{version:08d}.json"

    def _path(self, path: str):
        return self._fs.Path(path)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
