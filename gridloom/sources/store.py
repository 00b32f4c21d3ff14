"""A lake on disk: versions of workbooks, and what has been found in them.

Layout below the root (Spark's readers skip names that start with ``_``, so the root itself reads as the cell table):

* ``commit=<id>/``: the cells of the workbooks that one commit wrote, clustered by workbook, sheet and row;
* ``_parts/<kind>/commit=<id>/``: their sheets (with visibility and protection), merged areas, names and tables;
* ``_versions/version=<n>/``: one row per workbook of commit n, with the file version it came from, or that it is gone;
* ``_regions/commit=<id>/``, ``_views/<table>/<shape>/commit=<id>/``: discovery and typed rows, made when first asked for.

A commit writes its data first and its row of the manifest last. A reader takes the newest version of each workbook that
the manifest names, so a commit that was cut short is never seen, and a job that runs again writes a new commit. What was
found in a commit never changes, so it serves every later session; a new version adds discovery of its own workbooks only.

Two writers of the same workbook: the one whose base is no longer the newest version gets ``version_conflict``. Version
numbers are claimed by creating a file, which is atomic on HDFS and local disks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.sql_guard import GuardError
from gridloom.operators import materialize
from gridloom.operators.bands import SHEET
from gridloom.operators.structure import Structure
from gridloom.session import cut_lineage
from gridloom.sources.grid import CELL_COLUMNS, CELL_SCHEMA, complete_cells

#: Most cells in one file.
FILE_ROWS = 20_000_000
#: A shape or meaning of stored tables that older readers would not expect raises this number.
FORMAT = 2
#: Up to this many workbooks are named in a filter, which prunes files; more are joined.
NAMED_BOOKS = 1_000

PART_SCHEMAS = {
    "sheets": "workbook string, sheet string, sheet_idx int, hidden boolean, protected boolean",
    "merged": "workbook string, sheet string, range string, pos int, min_r long, min_c int, max_r long, max_c int",
    "names": "workbook string, name string, text string",
    "tables": "workbook string, sheet string, name string, range string",
}
VERSION_SCHEMA = "workbook string, commit string, base long, size long, modified timestamp, gone boolean"
#: Provenance in stored views; region columns never start with an underscore.
BOOK = "__workbook"


def of_books(df: DataFrame, books: DataFrame) -> DataFrame:
    """Rows of some workbooks. A few are named, so that the scan reads their files and row groups only."""
    listed = [r[0] for r in books.select("workbook").distinct().limit(NAMED_BOOKS + 1).collect()]
    return df.where(F.col("workbook").isin(listed)) if len(listed) <= NAMED_BOOKS else df.join(books.select("workbook").distinct(), "workbook", "left_semi")


class StoredParts:
    """What a scan knows beside the cells, read from a store."""

    def __init__(self, store: LakeStore, books: list[str] | None = None):
        self._store, self._books = store, books

    def _read(self, kind: str) -> DataFrame:
        return self._store.part(kind, self._books)

    sheets = property(lambda self: self._read("sheets"))
    merged = property(lambda self: self._read("merged"))
    names = property(lambda self: self._read("names"))
    tables = property(lambda self: self._read("tables"))


class LakeStore:
    """One snapshot of a lake on disk; ``commit`` and ``refreshed`` give the next one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files --------------------------------------------------------------------------------------
    def _path(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        target, system = self._path(path)
        return system.exists(target)

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> LakeStore | None:
        """The store below ``root``, None if there is none."""
        store = cls(spark, root)
        return store if store._there(f"{store.root}/_versions") else None

    @property
    def taken(self) -> bool:
        return self._there(self.root)

    # -- versions -----------------------------------------------------------------------------------
    @cached_property
    def history(self) -> DataFrame:
        """Every version of every workbook: version, workbook, commit, base, size, modified, gone."""
        rows = self.spark.read.schema(f"{VERSION_SCHEMA}, version long").option("basePath", f"{self.root}/_versions")
        return cut_lineage(rows.parquet(f"{self.root}/_versions"), "versions")

    @cached_property
    def live(self) -> DataFrame:
        """(workbook, version, commit, size, modified): the newest version of each workbook that is not gone."""
        newest = self.history.groupBy("workbook").agg(F.max_by(F.struct("version", "commit", "size", "modified", "gone"), F.col("version")).alias("v"))
        return cut_lineage(newest.where("not v.gone").select("workbook", "v.version", "v.commit", "v.size", "v.modified"), "live")

    @cached_property
    def version(self) -> int:
        return self.history.agg(F.max("version")).first()[0] or 0

    @cached_property
    def _dead(self) -> DataFrame:
        """(workbook, commit) that a commit still holds but a newer one replaced."""
        return cut_lineage(self.history.where("not gone").select("workbook", "commit").join(
            self.live.select("workbook", "commit"), ["workbook", "commit"], "left_anti"), "dead")

    @cached_property
    def _commits(self) -> list[str]:
        """Commits with a live workbook, oldest first; one entry per commit, not per workbook."""
        return [r["commit"] for r in self.live.groupBy("commit").agg(F.min("version").alias("v")).orderBy("v").collect()]

    def _commits_of(self, books: list[str] | None) -> list[str]:
        if books is None:
            return self._commits
        return [r[0] for r in self.live.where(F.col("workbook").isin(books)).select("commit").distinct().collect()]

    def _alive(self, df: DataFrame, books: list[str] | None, book: str = "workbook") -> DataFrame:
        """Rows (with commit) of live versions. Replaced workbooks are few: only commits that hold some are checked."""
        if books is not None:
            df = df.where(F.col(book).isin(books))
        if self._dead.isEmpty():
            return df.drop("commit")
        dead = self._dead.select(F.col("workbook").alias("_dead_book"), F.col("commit").alias("_dead_commit"))
        return df.join(dead, (F.col(book) == F.col("_dead_book")) & (F.col("commit") == F.col("_dead_commit")), "left_anti").drop("commit")

    def _read(self, base: str, schema: str, commits: list[str]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], f"{schema}, commit string")
        return self.spark.read.schema(f"{schema}, commit string").option("basePath", base).parquet(*[f"{base}/commit={c}" for c in commits])

    # -- the data -----------------------------------------------------------------------------------
    def cells(self, books: list[str] | None = None) -> DataFrame:
        """The cell table of the newest versions; ``books``: of these workbooks, from their commits only."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CELL_SCHEMA)
        return self._alive(self._read(self.root, schema, self._commits_of(books)), books).select(*CELL_COLUMNS)

    def part(self, kind: str, books: list[str] | None = None) -> DataFrame:
        return self._alive(self._read(f"{self.root}/_parts/{kind}", PART_SCHEMAS[kind], self._commits_of(books)), books)

    def parts(self, books: list[str] | None = None) -> StoredParts:
        return StoredParts(self, books)

    # -- writing ------------------------------------------------------------------------------------
    def commit(self, cells: DataFrame, parts=None, files: DataFrame | None = None, gone: DataFrame | None = None, replaces: DataFrame | None = None) -> LakeStore:
        """Write the next version of the workbooks in ``cells`` and ``parts`` (an object with sheets, merged, names, tables).

        ``files``: (workbook, size, modified) they came from. ``gone``: (workbook) no longer there. ``replaces``: workbooks
        that this commit replaces even where nothing of them is left. Without ``parts`` the sheets are those with a cell.
        """
        found = "c" + uuid.uuid4().hex
        # Stored first: range partitioning reads its input twice, and an edit should be computed once.
        made = cut_lineage(complete_cells(cells), "commit")
        clustered = made.repartitionByRange("workbook", "sheet", "r").sortWithinPartitions("workbook", "sheet", "r", "c")
        clustered.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.root}/commit={found}")
        for kind, schema in PART_SCHEMAS.items():
            if parts is not None:
                rows = getattr(parts, kind)
            elif kind == "sheets":
                rows = made.groupBy(*SHEET).agg(F.min("sheet_idx").alias("sheet_idx"))
            else:
                rows = self.spark.createDataFrame([], schema)
            typed = [(F.col(n) if n in rows.columns else F.lit(False if t == "boolean" else None)).cast(t).alias(n)
                     for n, t in (c.split() for c in schema.split(", "))]
            rows.select(*typed).write.parquet(f"{self.root}/_parts/{kind}/commit={found}")
        own = self._read(f"{self.root}/_parts/sheets", PART_SCHEMAS["sheets"], [found])
        books = own.select("workbook").union(made.select("workbook"))
        books = (books if replaces is None else books.union(replaces.select("workbook"))).distinct()
        self._publish(found, books, files, gone)
        return LakeStore(self.spark, self.root)

    def replace(self, cells: DataFrame, parts, replaces: DataFrame) -> LakeStore:
        """A commit after which its workbooks are the only ones."""
        gone = self.live.join(replaces.select("workbook").distinct(), "workbook", "left_anti") if self._there(f"{self.root}/_versions") else None
        return self.commit(cells, parts, gone=gone, replaces=replaces)

    def _publish(self, commit: str, books: DataFrame, files: DataFrame | None, gone: DataFrame | None) -> None:
        """The manifest row of a commit, last of all; refused where a workbook has moved on since this snapshot."""
        base = self.version if self._there(f"{self.root}/_versions") else 0
        if files is None:
            files = self.spark.createDataFrame([], "workbook string, size long, modified timestamp")
        rows = books.join(files.select("workbook", "size", "modified"), "workbook", "left").withColumn("gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select("workbook").withColumn("gone", F.lit(True)), allowMissingColumns=True)
        rows = cut_lineage(rows.select("workbook", F.lit(commit).alias("commit"), F.lit(base).cast("long").alias("base"), "size", "modified", "gone"), "manifest")
        number = base + 1
        while True:
            now = LakeStore(self.spark, self.root)
            if base and now.version > base and not now.history.where(F.col("version") > base).join(rows, "workbook", "left_semi").isEmpty():
                raise GuardError("version_conflict", "a workbook has a newer version than the one that was changed")
            target, system = self._path(f"{self.root}/_claims/{number:012d}")
            if system.createNewFile(target):
                break
            number += 1
        rows.write.parquet(f"{self.root}/_versions/version={number}")

    # -- what is found ------------------------------------------------------------------------------
    def _kept(self, path: str, make: Callable[[], DataFrame]) -> str:
        """Make a table below the root once; it belongs to a commit, so it never goes stale."""
        if not self._there(f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return path

    def _cells_of(self, commit: str) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CELL_SCHEMA)
        return self._read(self.root, schema, [commit]).select(*CELL_COLUMNS)

    def regions(self, books: list[str] | None = None) -> DataFrame:
        """Regions of the newest versions; only commits that nobody has asked for yet are discovered."""
        commits = self._commits_of(books)
        if not commits:
            return Structure(self.cells([])).regions
        paths = [self._kept(f"{self.root}/_regions/commit={c}", lambda c=c: Structure(self._cells_of(c)).regions) for c in commits]
        return self._alive(self.spark.read.option("basePath", f"{self.root}/_regions").parquet(*paths), books)

    def view(self, name: str, books: list[str] | None = None) -> DataFrame:
        """Typed rows of a table name, and the workbook of each in ``BOOK``.

        The columns are those of all live workbooks with that name; a new shape makes new typed rows, an old one is read.
        """
        regions = self.regions(books).where(F.col("table_name") == name)
        columns = materialize.view_columns(regions)
        shape = hashlib.sha256(repr((FORMAT, columns)).encode()).hexdigest()[:16]
        base = f"{self.root}/_views/{name}/{shape}"
        holders = [r[0] for r in regions.join(self.live.select("workbook", "commit"), "workbook").select("commit").distinct().collect()]

        def typed(commit: str) -> DataFrame:
            own = self.spark.read.parquet(f"{self.root}/_regions/commit={commit}").where(F.col("table_name") == name)
            return materialize.wide_rows(self._cells_of(commit), own, columns)

        paths = [self._kept(f"{base}/commit={c}", lambda c=c: typed(c)) for c in holders]
        rows = self._alive(self.spark.read.option("basePath", base).parquet(*paths), books)
        return materialize.view_of(rows, columns, provenance=BOOK)
