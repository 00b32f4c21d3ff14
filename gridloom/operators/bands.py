"""Rectangular regions of a sparse grid, as gaps-and-islands over rows, then columns.

The scan reads only coordinates and the blank test. Before the first shuffle a column of 64 rows is reduced to the bits of a
long; runs and column bands are read off such bits. Entries of 64 rows are chained inside fixed blocks, and blocks over a sheet
by one row of each. No step sorts a whole sheet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.sources.grid import ROW_BLOCK, block_row_number

SHEET = ["workbook", "sheet"]


def cell_non_empty(kind: Column | None = None, text: Column | None = None) -> Column:
    """R1 on a cell (raw columns by default): values that are not text always print something."""
    kind = F.col("raw_kind") if kind is None else kind
    text = F.col("raw_text") if text is None else text
    return F.when(kind == "text", tx.non_empty(text)).otherwise(kind.isNotNull())


#: Rows of one entry of the row index: the bits of a long.
INDEX_ROWS = 64


def row_runs(cells: DataFrame, block_rows: int = ROW_BLOCK) -> DataFrame:
    """Runs of consecutive non-empty rows, cut at blocks and index entries, with the row band each belongs to.

    One row per (sheet, block, run): start, end, band_start, and the run's column bits (a chunk may be listed more than once).
    """
    columns = (
        cells.where(cell_non_empty())
        .select(*SHEET, F.expr(f"r div {block_rows}L").alias("block"), F.expr("shiftright(r, 6)").alias("entry"), "c",
                F.expr("shiftleft(1L, cast(r & 63 as int))").alias("bit"))
        .groupBy(*SHEET, "block", "entry", "c").agg(F.bit_or("bit").alias("rows"))
    )
    chunk = F.expr("(c - 1) div 64")
    # At most 16 384 columns of 64 rows each.
    entries = columns.groupBy(*SHEET, "block", "entry").agg(
        F.bit_or("rows").alias("taken"), F.min(chunk).alias("chunk"), (F.max(chunk) > F.min(chunk)).alias("wide"),
        F.collect_list(F.struct("c", "rows")).alias("cols"))
    # A run begins at a bit whose lower neighbour is not set, and ends at one whose upper neighbour is not.
    entries = entries.withColumn("begins", F.expr("taken & ~shiftleft(taken, 1)")).withColumn("ends", F.expr("taken & ~shiftrightunsigned(taken, 1)"))
    places = "filter(sequence(0, 63), i -> shiftrightunsigned(%s, i) & 1L = 1L)"
    mask = "shiftleft(shiftrightunsigned(-1L, 63 - b + a), a)"
    masks = f"zip_with({places % 'begins'}, {places % 'ends'}, (a, b) -> named_struct('lo', a, 'hi', b, 'mask', {mask}))"
    bit = "coalesce(shiftleft(1L, cast((y.c - 1) % 64 as int)), 0L)"
    narrow = f"array(named_struct('chunk', chunk, 'bits', aggregate(cols, 0L, (a, y) -> if(y.rows & x.mask != 0L, a | {bit}, a))))"
    spread = f"transform(filter(cols, y -> y.rows & x.mask != 0L), y -> named_struct('chunk', (y.c - 1) div 64, 'bits', {bit}))"
    run = f"named_struct('start', entry * 64 + x.lo, 'end', entry * 64 + x.hi, 'chunks', if(wide, {spread}, {narrow}))"
    # Cells without a row number have a run of their own that begins nowhere.
    every = f"transform(cols, y -> named_struct('chunk', (y.c - 1) div 64, 'bits', {bit}))"
    unplaced = f"array(named_struct('start', cast(null as bigint), 'end', cast(null as bigint), 'chunks', {every}))"
    entries = entries.select(*SHEET, "block", "entry", F.expr(f"if(entry is null, {unplaced}, transform({masks}, x -> {run}))").alias("runs"))
    return _chained(entries).select(*SHEET, "block", F.posexplode("runs").alias("_i", "_run"), "came_from").select(
        *SHEET, "block", "_run.start", "_run.end",
        F.when((F.col("_i") == 0) & F.col("came_from").isNotNull(), F.col("came_from")).otherwise(F.col("_run.start")).alias("band_start"),
        "_run.chunks")


def _chained(entries: DataFrame) -> DataFrame:
    """``came_from``: where the band began that the first run of an entry goes on with, if it began in an earlier entry.

    Entries are chained inside their block, and blocks over a sheet by one row of each.
    """
    def chain(df, order, first, last_start, last_end, name):
        """Gaps and islands over rows that each have a first run, and a last one that may be the same."""
        goes_on = F.coalesce(F.lag(last_end).over(order) + 1 == F.col(first), F.lit(False))
        through = goes_on & (F.col(last_start) == F.col(first))
        opened = F.when(~F.coalesce(through, F.lit(False)), F.col(last_start))
        earlier = F.last("_opened", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("_on", goes_on).withColumn("_opened", opened).withColumn(name, F.when(F.col("_on"), earlier)).drop("_on", "_opened")

    in_block = Window.partitionBy(*SHEET, "block")
    ends = (
        entries.withColumn("_first", F.expr("get(runs, 0).start"))
        .withColumn("_last", F.expr("element_at(runs, -1).start")).withColumn("_end", F.expr("element_at(runs, -1).end"))
    )
    linked = chain(ends, in_block.orderBy("entry"), "_first", "_last", "_end", "_near")
    # The band of the last run, as far as its block tells.
    tail = F.when((F.col("_last") == F.col("_first")) & F.col("_near").isNotNull(), F.col("_near")).otherwise(F.col("_last"))
    told = (
        linked.withColumn("_block_first", F.min("_first").over(in_block)).withColumn("_block_end", F.max("_end").over(in_block))
        .withColumn("_block_last", F.max(tail).over(in_block)).withColumn("_head", F.col("_first") == F.col("_block_first"))
    )
    heads = Window.partitionBy(*SHEET, "_head", F.when(F.col("_head"), F.lit(None)).otherwise(F.col("block"))).orderBy("block")
    far = chain(told, heads, "_block_first", "_block_last", "_block_end", "_from")
    spread = far.withColumn("_far", F.max(F.when(F.col("_head"), F.col("_from"))).over(in_block))
    own = F.when(F.col("_head"), F.col("_first")).otherwise(F.col("_near"))
    return spread.select(*SHEET, "block", "runs", F.when(
        (own == F.col("_block_first")) & F.col("_far").isNotNull(), F.col("_far")).otherwise(F.col("_near")).alias("came_from"))


def row_bands(runs: DataFrame) -> DataFrame:
    """R2: (sheet, band_start, band_end), maximal runs of rows with any non-empty cell."""
    return runs.groupBy(*SHEET, "band_start").agg(F.max("end").alias("band_end"))


def band_layout(runs: DataFrame) -> DataFrame:
    """Per row band its end and the sorted column bands (array of min_c, max_c)."""
    band = [*SHEET, "band_start"]
    by_chunk = (
        runs.select(*band, "end", F.inline("chunks"))
        .groupBy(*band, "chunk").agg(F.bit_or("bits").alias("bits"), F.max("end").alias("end"))
    )
    # At most 16 384 columns per band: the width of a sheet bounds this group.
    chunks = by_chunk.groupBy(*band).agg(
        F.max("end").alias("band_end"), F.array_sort(F.collect_list(F.when(F.col("bits") != 0, F.struct("chunk", "bits")))).alias("chunks"))
    # A column band begins at a bit whose lower neighbour is not set, and ends at one whose upper neighbour is not.
    before = "coalesce(get(chunks, i - 1).chunk = x.chunk - 1 and get(chunks, i - 1).bits < 0, false)"
    after = "coalesce(get(chunks, i + 1).chunk = x.chunk + 1 and get(chunks, i + 1).bits & 1L = 1L, false)"
    marked = chunks.where(F.size("chunks") > 0).withColumn("_marks", F.expr(
        "transform(chunks, (x, i) -> named_struct('chunk', x.chunk, "
        f"'begins', x.bits & ~(shiftleft(x.bits, 1) | if({before}, 1L, 0L)), "
        f"'ends', x.bits & ~(shiftrightunsigned(x.bits, 1) | if({after}, shiftleft(1L, 63), 0L))))"))

    def places(mask: str) -> str:
        # No place is looked at beyond the highest bit.
        return ("flatten(transform(_marks, x -> transform(filter(sequence(0, length(bin(x.%s)) - 1), i -> shiftrightunsigned(x.%s, i) & 1L = 1L), "
                "i -> cast(x.chunk * 64 + i + 1 as int))))" % (mask, mask))

    bounds = f"zip_with({places('begins')}, {places('ends')}, (a, b) -> named_struct('min_c', a, 'max_c', b))"
    return marked.select(*band, "band_end", F.expr(bounds).alias("col_bands"))


def number_regions(layout: DataFrame, block_rows: int = ROW_BLOCK) -> DataFrame:
    """Rectangles numbered from 1 per sheet, by first row, then first column."""
    rects = layout.select(
        *SHEET, F.col("band_start").alias("min_r"), F.col("band_end").alias("max_r"), F.inline("col_bands"))
    numbered = block_row_number(
        rects, SHEET, F.expr(f"min_r div {block_rows}L"), [F.col("min_r"), F.col("min_c")], "region_no")
    return numbered.select(*SHEET, "region_no", "min_r", "min_c", "max_r", "max_c")


def banded_runs(runs: DataFrame, layout: DataFrame) -> DataFrame:
    """Runs with the bounds and column bands of their row band (still block-sized data)."""
    return runs.select(*SHEET, "block", "start", "end", "band_start").join(layout, [*SHEET, "band_start"])


def row_index(banded: DataFrame, *extra: str) -> DataFrame:
    """Where rows find their band: per (sheet, 64 rows) the runs there, in order, and a bit for each row a run begins at.

    A run that began in an earlier entry begins at the first bit. An entry has at most 32 runs, and there is one for 64 rows,
    so the index is far smaller than the rows it stands for. ``extra`` columns of ``banded`` go with each run.
    """
    pieces = banded.select("*", F.explode(F.expr(f"sequence(start div {INDEX_ROWS}, end div {INDEX_ROWS})")).alias("entry"))
    first = F.greatest(F.col("start"), F.col("entry") * INDEX_ROWS) - F.col("entry") * INDEX_ROWS
    run = F.struct(F.col("start"), F.col("end"), F.col("band_start").alias("min_r"), F.col("band_end").alias("max_r"), "col_bands", *extra)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), first.cast("int"))
    return pieces.withColumn("_bit", bit).groupBy(*SHEET, "entry").agg(F.bit_or("_bit").alias("begins"), F.array_sort(F.collect_list(run)).alias("runs"))


def label_cells(cells: DataFrame, index: DataFrame, extra: str | None = None) -> DataFrame:
    """Attach region bounds to every stored cell that lies in a region.

    ``index`` is a stored row index, so Spark knows its size: cells are not shuffled where it can be sent to every task. A
    cell finds its run by counting the bits up to its row, not by a search. ``extra``: keep rows up to that column of the run.
    """
    places = index.select(*[F.col(k).alias(f"_{k}") for k in SHEET], "entry", "begins", "runs")
    at = F.expr(f"r div {INDEX_ROWS}")
    joined = cells.join(places, (cells["workbook"] == F.col("_workbook")) & (cells["sheet"] == F.col("_sheet")) & (at == F.col("entry")))
    upto = F.expr(f"begins & shiftrightunsigned(-1L, cast({INDEX_ROWS - 1} - r % {INDEX_ROWS} as int))")
    run = joined.withColumn("_run", F.get(F.col("runs"), F.bit_count(upto) - 1)).where("r <= _run.end" + (f" and r <= _run.{extra}" if extra else ""))
    # At most one band has the column; inlined, it is looked for once.
    hit = F.filter(F.col("_run.col_bands"), lambda b: (F.col("c") >= b["min_c"]) & (F.col("c") <= b["max_c"]))
    return run.select(*cells.columns, F.col("_run.min_r").alias("min_r"), F.col("_run.max_r").alias("max_r"), F.inline(hit))
