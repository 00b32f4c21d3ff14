"""The user-facing object: one cell table, and everything that can be asked of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import a1
from gridloom.functions.sql_guard import GuardError, double_quoted_names, parsed_read_only
from gridloom.operators import audit, edits, lineage, materialize, profile, ranges
from gridloom.operators.structure import Structure
from gridloom.session import cut_lineage, owned_folder, shared_folder
from gridloom.sources.catalog import changed_files
from gridloom.sources.grid import complete_cells
from gridloom.sources.store import BOOK, LakeStore
from gridloom.sources.workbooks import WorkbookScan

# Fixed value: rows a query returns to its caller unless asked otherwise.
QUERY_ROW_LIMIT = 1_000

@dataclass
class QueryResult:
    columns: list[str]
    rows: list[dict]
    row_count: int
    truncated: bool


class Lake:
    """A lake of grids. Build it from cells, from a stored cell table, from workbook files, or open one that was saved.

    A saved lake (``save``, ``open``) keeps every version of its workbooks, and what has been found in them: a later session
    answers queries from typed tables, and after a change only the changed workbooks are discovered.
    """

    def __init__(self, cells: DataFrame, scan=None, source: str | None = None, store: LakeStore | None = None, audit_path: str | None = None):
        """``audit_path``: where the calls are recorded; by default with a saved lake, else for this application only."""
        self.spark = cells.sparkSession
        self.cells = complete_cells(cells)
        self.scan = scan
        self.source = source
        self.store = store
        self._audit_path = audit_path or (f"{store.root}/_audit" if store is not None else None)
        self.trail = audit.Trail(self.spark, self._audit_folder)
        self.structure = Structure(self.cells)
        self._books: dict[str, Structure] = {}
        self.kept: dict = {}
        self._tables: dict[tuple, DataFrame] = {}

    def _audit_folder(self) -> str:
        if self._audit_path is None:
            self._audit_path = owned_folder(self.spark, "audit")
        return self._audit_path

    def audit(self, session_id: str | None = None, path: str | None = None, limit: int | None = audit.AUDIT_LIMIT) -> DataFrame:
        """What was called, newest first."""
        return audit.latest_audit(self.trail.events(), session_id, path, limit)

    @classmethod
    def from_cells(cls, spark: SparkSession, path: str) -> Lake:
        return cls(spark.read.parquet(path), source=path)

    @classmethod
    def from_workbooks(cls, spark: SparkSession, path: str | list[str]) -> Lake:
        scan = WorkbookScan.of_folder(spark, path)
        return cls(scan.cells, scan, path if isinstance(path, str) else None)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Lake:
        """The newest version of a saved lake."""
        store = LakeStore.at(spark, root)
        if store is None:
            raise GuardError("lake_not_found", f"no saved lake at {root!r}")
        return cls._of_store(store)

    @classmethod
    def _of_store(cls, store: LakeStore) -> Lake:
        return cls(store.cells(), store.parts(), store.root, store)

    def save(self, root: str, files: DataFrame | None = None) -> Lake:
        """Store this lake as the first version at ``root`` and open it. ``files``: (workbook, size, modified) of the sources."""
        if LakeStore.at(self.spark, root) is not None:
            raise GuardError("output_exists", f"{root} holds a lake already")
        return self._of_store(LakeStore(self.spark, root).commit(self.cells, self.scan, files))

    @classmethod
    def sync(cls, spark: SparkSession, path: str | list[str], root: str) -> Lake:
        """The workbooks below a folder as a saved lake: only files that are new or changed are scanned, those gone are left out."""
        files = WorkbookScan.versions(spark, path)
        store = LakeStore.at(spark, root)
        if store is None:
            return cls.from_workbooks(spark, path).save(root, files.withColumnRenamed("path", "workbook"))
        known = store.live.where("size is not null").select(F.col("workbook").alias("path"), "size", "modified")
        gone = known.join(files, "path", "left_anti").select(F.col("path").alias("workbook"))
        if changed_files(files, known).isEmpty() and gone.isEmpty():
            return cls._of_store(store)
        scan = WorkbookScan.of_folder(spark, path, known)
        return cls._of_store(store.commit(scan.cells, scan, files.withColumnRenamed("path", "workbook"), gone))

    # -- describe ---------------------------------------------------------------------------
    @property
    def regions(self) -> DataFrame:
        return self.structure.regions if self.store is None else self.store.regions()

    @cached_property
    def profile(self) -> DataFrame:
        extra = {}
        if self.scan is not None:
            extra = {k: getattr(self.scan, k) for k in ("sheets", "merged", "names", "tables")}
        return profile.sheet_profile(self.bounds, self.regions, **extra)

    @cached_property
    def bounds(self) -> DataFrame:
        """Used range of every sheet, those without a stored cell included."""
        return self.structure.bounds if self.scan is None else profile.with_empty_sheets(self.structure.bounds, self.scan.sheets)

    def sheets(self) -> DataFrame:
        return profile.list_sheets(self.profile)

    def tables(self, sheet: str | None = None) -> DataFrame:
        return profile.list_tables(self.regions, sheet)

    def best_source(self) -> DataFrame:
        return profile.best_source(self.bounds, self.regions)

    # -- query ------------------------------------------------------------------------------
    def table(self, name: str, workbook: str | None = None, keep_keys: bool = False) -> DataFrame:
        """Typed rows of a region table, from one workbook or from all that have it."""
        if self.store is not None and not keep_keys:
            return self.store.view(name, None if workbook is None else [workbook]).drop(BOOK)
        structure = self._structure(workbook)
        return materialize.region_view(structure.cells, structure.regions.where(F.col("table_name") == name), keep_keys)

    def _structure(self, workbook: str | None) -> Structure:
        """Discovery of one workbook reads that workbook only, unless the whole lake is known already."""
        if workbook is None:
            return self.structure
        if workbook not in self._books:
            cells = self.cells.where(F.col("workbook") == workbook) if self.store is None else self.store.cells([workbook])
            self._books[workbook] = Structure(cells)
        return self._books[workbook]

    def _regions_of(self, workbook: str | None) -> DataFrame:
        if self.store is None:
            return self._structure(workbook).regions
        return self.store.regions(None if workbook is None else [workbook])

    def _view(self, name: str, workbook: str | None, one_book: bool) -> DataFrame:
        """Typed rows of a table; where several workbooks share its name, a column says whose row it is."""
        if self.store is not None:
            view = self.store.view(name, None if workbook is None else [workbook])
        else:
            # Stored typed and column by column: a query, and every mention in it, reads what it needs of that.
            structure = self._structure(workbook)
            own = structure.regions.where(F.col("table_name") == name)
            columns = materialize.view_columns(own)
            view = materialize.view_of(cut_lineage(materialize.wide_rows(structure.cells, own, columns), "view"), columns, provenance=BOOK)
        if one_book:
            return view.drop(BOOK)
        return view.withColumnRenamed(BOOK, "workbook" if "workbook" not in view.columns else "workbook_of_row")

    def _register(self, names: set[str], workbook: str | None) -> None:
        """Temp views for the region tables that a query names; it may name no others.

        Views are session-wide, so they are set again on each call: another lake may use the name.
        """
        found = {}
        if names:
            named = self._regions_of(workbook).where(F.col("table_name").isin(*names))
            found = {r["table_name"]: r["one"] for r in named.groupBy("table_name").agg((F.min("workbook") == F.max("workbook")).alias("one")).collect()}
        if unknown := sorted(names - set(found)):
            raise GuardError("table_not_found", f"no table {unknown[0]!r}")
        for name, one_book in found.items():
            key = (name, workbook)
            if key not in self._tables:
                self._tables[key] = self._view(name, workbook, one_book)
            self._tables[key].createOrReplaceTempView(name)

    def sql(self, sql: str, workbook: str | None = None) -> DataFrame:
        """Q0 without the row limit: the guarded query as a DataFrame over region views."""
        with self.trail.call("query", workbook or self.source, sql=sql) as event:
            body, parsed = parsed_read_only(sql, self.spark)
            self._register(parsed.relations, workbook)
            event["source_refs"] = sorted(parsed.relations)
            with double_quoted_names(self.spark):
                return self.spark.sql(body)

    def query(self, sql: str, workbook: str | None = None, limit: int | None = QUERY_ROW_LIMIT) -> QueryResult:
        """Q0: at most ``limit`` rows with a truncation flag; None returns all (``sql`` keeps them on the cluster)."""
        df = self.sql(sql, workbook)
        rows = [r.asDict() for r in (df if limit is None else df.limit(limit + 1)).collect()]
        if limit is None:
            return QueryResult(df.columns, rows, len(rows), False)
        return QueryResult(df.columns, rows[:limit], len(rows[:limit]), len(rows) > limit)

    # -- ranges and lineage -----------------------------------------------------------------
    def read(self, workbook: str, sheet: str, range_text: str, include: Sequence[str] = ("values",), full: bool = False,
             max_cells: int | None = ranges.MAX_READ_CELLS, row_limit: int | None = ranges.READ_ROW_LIMIT) -> DataFrame:
        """S5. ``trail.warnings`` then says if a small range was read again and again."""
        merged, sheets = (self.scan.merged, self.scan.sheets) if self.scan is not None else (None, None)
        with self.trail.call("read-range", workbook, sheet=sheet, range=range_text, include=list(include)) as event:
            out = ranges.read_range(self.cells, workbook, sheet, range_text, include, full=full, max_cells=max_cells,
                                    row_limit=row_limit, merged=merged, sheets=sheets)
            r1, c1, r2, c2 = a1.parse_range(range_text)
            event["source_refs"] = [f"{sheet}!{range_text}"]
            if told := self.trail.small_read(f"{sheet}!{range_text}", (r2 - r1 + 1) * (c2 - c1 + 1)):
                event["warnings"] = [told]
            return out

    def summary(self, workbook: str, sheet: str, range_text: str, growth: bool = False, max_cells: int | None = None) -> DataFrame:
        with self.trail.call("summary", workbook, sheet=sheet, range=range_text) as event:
            event["source_refs"] = [f"{sheet}!{range_text}"]
            return ranges.summarize_range(self.cells, workbook, sheet, range_text, growth, max_cells)

    def trace(self, workbook: str, sheet: str, cell: str, depth: int = lineage.MAX_DEPTH, **options) -> DataFrame:
        with self.trail.call("trace", workbook, sheet=sheet, cell=cell, depth=depth):
            return self._trace(workbook, sheet, cell, depth, **options)

    def _trace(self, workbook: str, sheet: str, cell: str, depth: int, **options) -> DataFrame:
        known = (F.col("workbook") == workbook) & (F.col("sheet") == sheet)
        listed = self.cells.where(known).select("sheet").limit(1)
        if self.scan is not None:
            listed = listed.union(self.scan.sheets.where(known).select("sheet"))
            options = {"sheets": self.scan.sheets, **options}
        if listed.isEmpty():
            raise GuardError("sheet_not_found", f"no sheet {sheet!r} in {workbook!r}")
        return lineage.trace_cell(self.cells, workbook, sheet, cell, depth, **options)

    # -- edit -------------------------------------------------------------------------------
    def _staging(self) -> str:
        return f"{self.store.root}/_staged" if self.store is not None else f"{shared_folder(self.spark)}/gridloom/staged"

    def stage(self, operations: DataFrame | list[dict], workbook: str | None = None) -> str:
        """Validate a batch and keep it, with its diff and warnings. Returns the id for ``staged`` and ``commit``."""
        with self.trail.call("stage", workbook or self.source) as event:
            if isinstance(operations, list):
                operations = edits.edits_frame(self.spark, workbook, operations)
            found = edits.stage_batch(self.cells, operations, self._staging(), self.scan)
            tables = edits.staged_batch(self.spark, self._staging(), found)
            # The event names some of what a large batch touches and warns of; all of it is in ``staged``.
            few = lambda df, name: [r[0] for r in df.select(name).orderBy("seq").limit(audit.AUDIT_LIMIT).collect()]
            event["touched_ranges"] = few(edits.touched_ranges(tables["staged"]), "touched_range")
            event["warnings"] = few(tables["warnings"], "warning")
            return found

    def staged(self, found: str) -> dict:
        """A staged batch: ok, rejected, touched, changes, warnings. On a saved lake also in later sessions."""
        tables = edits.staged_batch(self.spark, self._staging(), found)
        bad = edits.rejected(tables["staged"])
        return {"id": found, "ok": bad.isEmpty(), "rejected": bad, "touched": edits.touched_ranges(tables["staged"]),
                "changes": tables["changes"], "warnings": tables["warnings"], "committed": None}

    def commit(self, found: str, output: str | None = None, overwrite: bool = False) -> str:
        """A staged batch becomes a new version of its workbooks, with all their sheets, areas, names and protection.

        A saved lake gets the version itself when no ``output`` is named. Otherwise ``output`` becomes a saved lake of the
        touched workbooks; by default it stands next to the source; ``overwrite`` makes them the only ones in a lake that is
        there. Read it with ``Lake.open``, or its cells as Parquet.
        """
        with self.trail.call("commit", self.source, staged=found, output=output):
            return self._commit(found, output, overwrite)

    def _commit(self, found: str, output: str | None, overwrite: bool) -> str:
        staged = edits.staged_batch(self.spark, self._staging(), found, ("staged",))["staged"]
        if not edits.rejected(staged).isEmpty():
            raise GuardError("rejected_operations", "a batch with rejected operations is not committed")
        if self.store is not None and output is None:
            self.store.commit(*edits.edited(staged, self.cells, self.scan), replaces=staged)
            return self.store.root
        if output is None:
            books = [r[0] for r in staged.select("workbook").distinct().limit(2).collect()]
            output = edits.commit_path(books[0] if len(books) == 1 and "/" in books[0] else self.source or "")
            if output == edits.commit_path(""):
                raise GuardError("invalid_operation", "an output is needed for a lake without a source path")
        target = LakeStore.at(self.spark, output)
        if target is None:
            target = LakeStore(self.spark, output)
            if target.taken:
                raise GuardError("output_exists", f"{output} exists and is no saved lake")
        elif not overwrite:
            raise GuardError("output_exists", f"{output} exists and overwrite is off")
        target.replace(*edits.edited(staged, self.cells, self.scan), replaces=staged)
        return output

    def edit(self, operations: DataFrame | list[dict], output: str | None = None, workbook: str | None = None, *,
             dry_run: bool = False, overwrite: bool = False) -> dict:
        """Stage a batch and, unless a rejection or ``dry_run`` stops it, commit it."""
        done = self.staged(self.stage(operations, workbook))
        if done["ok"] and not dry_run:
            done["committed"] = self.commit(done["id"], output, overwrite)
        return done
