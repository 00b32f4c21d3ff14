"""Rows that move: inserts and deletes of a batch as piecewise maps, composed.

A *layout* says where the rows of a sheet come from: pieces of consecutive rows, each from one origin (0: the rows before;
otherwise the number of the insert that made them) and starting at some row of it. An insert is a layout of three pieces, a
delete one of two. Layouts compose: the pieces of the later one that come from before are cut out of the earlier one.

Layouts are composed as a binary tree over the shifts of a sheet, so a shift takes part in as many steps as the tree has
levels. A write that stood behind ``rank`` shifts climbs the same tree: where its node is the later one of a pair, it asks the
layout of the earlier one. The lowest levels of ``NODE`` shifts each are done in one task; above them the two layouts of a
pair, and the points that ask, meet by ranges of rows, which a sample of them bounds. No task gets a whole sheet, and neither a
cell nor a write ever meets the list of shifts; a cell finds its final row by an equi-join on row blocks with the pieces of
the final layout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.bands import SHEET
from gridloom.session import cut_lineage, ship_package

#: Shifts whose layouts are composed in one task.
NODE = 65_536
#: Operations that are numbered in one task.
SEQ_BLOCK = 65_536
#: Points that one task looks up.
POINTS_A_TASK = 500_000
#: Pieces and points of a range of rows in which the layouts of a pair meet, about.
MEET = 32_768
#: Height of the blocks by which rows find their piece of the final layout: at most so many pieces per row.
ROWS_A_BLOCK = 64
#: Rows of a piece that goes on to the end of the sheet, and the most that one shift can name.
_OPEN, _FAR = 1 << 60, 1 << 40

# A piece of a layout, or a point that asks for its row (``rank`` not negative, ``r`` the row it had then). ``start`` and
# ``length``: where a piece lies; ``origin`` and ``row``: where it, or the point, comes from.
_ITEM = "workbook string, sheet string, node long, rank long, r long, start long, length long, origin long, row long"
_ITEM_COLUMNS = [part.split()[0] for part in _ITEM.split(", ")]


def _places(keys: np.ndarray, starts: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the last of some pieces, ordered by key and start, that begins at or before each row."""
    asked = np.r_[np.zeros(len(keys), bool), np.ones(len(key), bool)]
    order = np.lexsort((asked, np.r_[starts, at], np.r_[keys, key]))
    met = np.cumsum(~asked[order]) - 1
    out = np.empty(len(order), np.int64)
    out[order] = met
    return out[len(keys):]


def _cut(early: pd.DataFrame, late: pd.DataFrame, low: int = 0, high: int = 2 * _OPEN) -> pd.DataFrame:
    """Pieces from before (origin 0) of later layouts, cut out of the earlier layouts of their ``pair``.

    ``early`` is ordered by pair and start. Only what begins from ``low`` to before ``high`` in the earlier layout is given.
    """
    keys, starts = early["pair"].to_numpy(), early["start"].to_numpy()
    row, ends = late["row"].to_numpy(), (late["row"] + late["length"]).to_numpy()
    pair = late["pair"].to_numpy()
    both = _places(keys, starts, np.r_[pair, pair], np.r_[np.maximum(row, low), np.minimum(ends, high) - 1])
    first, last = np.maximum(both[:len(row)], 0), both[len(row):]
    n = np.maximum(last - first + 1, 0)
    own = np.repeat(np.arange(len(n)), n)
    place = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lo = np.maximum(starts[place], row[own])
    hi = np.minimum(starts[place] + early["length"].to_numpy()[place], ends[own])
    made = pd.DataFrame({
        "pair": pair[own], "start": late["start"].to_numpy()[own] + lo - row[own], "length": hi - lo,
        "origin": early["origin"].to_numpy()[place], "row": early["row"].to_numpy()[place] + lo - starts[place]})
    return made[(lo >= low) & (lo < high)]


def _ask(early: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """Points with the origin and row that the earlier layout of their ``pair`` gives their row."""
    place = _places(early["pair"].to_numpy(), early["start"].to_numpy(), points["pair"].to_numpy(), points["row"].to_numpy())
    return points.assign(origin=early["origin"].to_numpy()[place],
                         row=early["row"].to_numpy()[place] + points["row"].to_numpy() - early["start"].to_numpy()[place])


_PIECE = ["node", "start", "length", "origin", "row"]


def _single_layouts(shifts: pd.DataFrame) -> pd.DataFrame:
    """The layout of every shift on its own; its node is its number in the task."""
    node, idx, amount = (shifts[k].to_numpy(np.int64) for k in ("nth", "r", "amount"))
    insert = shifts["insert"].to_numpy(bool)
    new, zero = np.where(insert, amount, 0), np.zeros(len(node), np.int64)
    above = pd.DataFrame(dict(zip(_PIECE, (node, zero + 1, idx - 1, zero, zero + 1))))
    made = pd.DataFrame(dict(zip(_PIECE, (node, idx, new, shifts["origin"].to_numpy(np.int64), zero))))
    below = pd.DataFrame(dict(zip(_PIECE, (node, idx + new, zero + _OPEN, zero, np.where(insert, idx, idx + amount)))))
    out = pd.concat([above, made, below], ignore_index=True)
    return out[out["length"] > 0]


def _compose_node(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    """The layout of a node's shifts, and where the rows of points were when the node began."""
    asks = items["is_point"].to_numpy(bool)
    points = items[asks][["rank", "r", "nth"]].rename(columns={"nth": "node"}).reset_index(drop=True)
    points = points.assign(origin=0, row=points["r"])
    shifts = items[~asks]
    pieces = _single_layouts(shifts)
    top, found = len(shifts) - 1, []
    for _ in range(len(shifts).bit_length()):
        pieces = pieces.sort_values(["node", "start"], ignore_index=True)
        pieces, points = pieces.assign(pair=pieces["node"] // 2), points.assign(pair=points["node"] // 2)
        late = pieces["node"] % 2 == 1
        early, old = pieces[~late], late & (pieces["origin"] == 0)
        kept = [pieces[late & ~old], early[early["node"] == top]]
        moved = points["node"] % 2 == 1
        asked = _ask(early, points[moved])
        found.append(asked[asked["origin"] != 0])
        points = pd.concat([points[~moved], asked[asked["origin"] == 0]], ignore_index=True)
        pieces = pd.concat([*kept, _cut(early, pieces[old])], ignore_index=True)
        pieces, points, top = pieces.assign(node=pieces["pair"]), points.assign(node=points["pair"]), top // 2
    points = pd.concat([points, *found], ignore_index=True).assign(start=0, length=0)
    pieces = (pieces if key[3] == 0 else pieces[:0]).assign(rank=-1, r=0)
    out = pd.concat([pieces, points], ignore_index=True).assign(workbook=key[0], sheet=key[1], node=key[2])
    return out[_ITEM_COLUMNS].astype({k: "int64" for k in _ITEM_COLUMNS[2:]})


def _deal(bounds: dict[tuple, np.ndarray]):
    """Items of pairs, dealt to the ranges of rows that they touch: adds ``range``, ``low`` and ``high``.

    A row that was sampled more than once bounds empty ranges too; only points are dealt over those.
    """
    none = np.zeros(0, np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, own in batch.groupby(["workbook", "sheet", "pair"]):
                edges = bounds.get(tuple(key), none)
                is_point, early = own["rank"].to_numpy() >= 0, own["early"].to_numpy(bool)
                at = np.where(early, own["start"], own["row"])
                left, right = np.searchsorted(edges, at, "left"), np.searchsorted(edges, at, "right")
                end = np.searchsorted(edges, at + own["length"].to_numpy() - 1, "right")
                spot = right - own["rank"].to_numpy() % np.maximum(right - left, 1)
                first = np.where(is_point, spot, np.where(early, np.minimum(left + 1, right), right))
                n = np.where(is_point, 1, end - first + 1)
                again = np.repeat(np.arange(len(own)), n)
                place = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield own.iloc[again].assign(range=place, low=np.r_[0, edges][place], high=np.r_[edges, 2 * _OPEN][place])

    return deal


def _meet(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    """One range of rows of a pair: its later pieces cut out of the earlier ones, its points answered."""
    low, high = int(items["low"].iloc[0]), int(items["high"].iloc[0])
    early = items[items["early"]].sort_values("start", ignore_index=True)
    asks = items["rank"] >= 0
    made = _cut(early, items[~items["early"] & ~asks], low, high).assign(rank=-1, r=0)
    out = pd.concat([made, _ask(early, items[asks])], ignore_index=True).assign(workbook=key[0], sheet=key[1], node=key[2])
    return out[_ITEM_COLUMNS].astype({k: "int64" for k in _ITEM_COLUMNS[2:]})


def shift_ranks(ops: DataFrame) -> DataFrame:
    """Adds ``rank``: how many inserts and deletes of the sheet come before each operation. No task numbers a whole sheet."""
    moves = F.col("type").isin("insert_rows", "delete_rows").cast("long")
    parted = ops.withColumn("_part", F.expr(f"seq div {SEQ_BLOCK}"))
    sums = parted.groupBy(*SHEET, "_part").agg(F.sum(moves).alias("_n"))
    before = Window.partitionBy(*SHEET).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*SHEET, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*SHEET, "_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = parted.withColumn("_in", F.coalesce(F.sum(moves).over(inside), F.lit(0)))
    return counted.join(sums, [*SHEET, "_part"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


class RowShifts:
    """The inserts and deletes of a batch. ``ops`` carry ``rank``. The sizes change how the work is dealt, not the result."""

    def __init__(self, ops: DataFrame, node: int = NODE, meet: int = MEET, points_a_task: int = POINTS_A_TASK):
        self.node, self.meet, self.points_a_task = node, meet, points_a_task
        ship_package(ops.sparkSession)
        shifts = ops.where(F.col("type").isin("insert_rows", "delete_rows")).select(
            *SHEET, "rank", "seq", (F.col("type") == "insert_rows").alias("insert"),
            F.least("idx", F.lit(_FAR)).alias("idx"), F.least("amount", F.lit(_FAR)).alias("amount"))
        self.shifts = cut_lineage(shifts, "shifts")

    @cached_property
    def sheets(self) -> DataFrame:
        """Sheets with a shift."""
        return cut_lineage(self.shifts.select(*SHEET).distinct(), "shifted")

    @cached_property
    def any(self) -> bool:
        return not self.sheets.isEmpty()

    @cached_property
    def layout(self) -> DataFrame:
        """Pieces of the layout after the whole batch."""
        return self._climb(None).where("rank < 0")

    def origins(self, points: DataFrame) -> DataFrame:
        """(workbook, sheet, rank, r) of sheets with shifts -> the same with origin and row: where a row came from that
        stood at r when ``rank`` shifts were done."""
        items = self._climb(cut_lineage(points.select(*SHEET, "rank", "r").distinct(), "points"))
        self.__dict__.setdefault("layout", items.where("rank < 0"))
        return items.where("rank >= 0").select(*SHEET, "rank", "r", "origin", "row")

    def _climb(self, points: DataFrame | None) -> DataFrame:
        """Pieces of the final layout, and points with their origins."""
        node = [F.expr(f"rank div {self.node}").alias("node"), F.expr(f"rank % {self.node}").alias("nth")]
        long = lambda v: F.lit(v).cast("long")
        items = self.shifts.select(*SHEET, *node, "rank", F.lit(False).alias("is_point"), "insert", F.col("idx").cast("long").alias("r"),
                                   F.col("amount").cast("long").alias("amount"), (F.col("seq") + 1).cast("long").alias("origin"))
        if points is None:
            items = items.withColumn("salt", long(0))
        else:
            asked = points.select(*SHEET, *node, "rank", F.lit(True).alias("is_point"), F.lit(False).alias("insert"), F.col("r").cast("long").alias("r"),
                                  long(0).alias("amount"), long(0).alias("origin"))
            # Nodes with many points: dealt over tasks, each with its own copy of the shifts.
            many = asked.groupBy(*SHEET, "node").agg(F.ceil(F.count(F.lit(1)) / self.points_a_task).alias("salts")).where("salts > 1")
            salts = {} if many.isEmpty() else {"salts": many}
            salted = lambda df: df.join(F.broadcast(salts["salts"]), [*SHEET, "node"], "left") if salts else df.withColumn("salts", long(1))
            count = F.coalesce("salts", long(1))
            items = salted(items).withColumn("salt", F.explode(F.sequence(long(0), count - 1))).drop("salts").unionByName(
                salted(asked).withColumn("salt", F.pmod(F.xxhash64("rank", "r"), count)).drop("salts"))
        items = cut_lineage(items.groupBy(*SHEET, "node", "salt").applyInPandas(_compose_node, _ITEM), "layouts")
        # Sheets with more nodes go on; there is at most one for a full node of shifts.
        tall = cut_lineage(self.shifts.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.node), "tall_sheets")
        most = tall.agg(F.max("n")).first()[0]
        if most is None:
            return items
        done = items.join(F.broadcast(tall), SHEET, "left_anti")
        items = items.join(F.broadcast(tall), SHEET).withColumn("last", F.expr(f"(n - 1) div {self.node}")).drop("n")
        for _ in range((most // self.node).bit_length()):
            items = self._level(items)
        return done.unionByName(items.drop("last"))

    def _level(self, items: DataFrame) -> DataFrame:
        """Layouts of pairs of nodes composed, points taken to the beginning of their pair."""
        items = items.withColumns({"pair": F.expr("node div 2"), "early": F.expr("node % 2 = 0 and rank < 0")})
        # The last node may have none after it, but points behind it that ask.
        alone = F.expr("early and node = last")
        meets = items.where(F.expr("early or node % 2 = 1 and origin = 0"))
        passes = items.where(F.expr("not early and not (node % 2 = 1 and origin = 0)") | alone)
        at = F.expr("if(early, start, row)").alias("at")
        sample = meets.select(*SHEET, "pair", at, F.pmod(F.xxhash64("node", "rank", "r", "start", "row"), F.lit(self.meet)).alias("h")).where("h = 0")
        bounds: dict[tuple, list] = {}
        for s in sample.collect():  # one item in ``meet``
            bounds.setdefault((s["workbook"], s["sheet"], s["pair"]), []).append(s["at"])
        edges = {key: np.sort(np.array(found, np.int64)) for key, found in bounds.items()}
        dealt = meets.select(*_ITEM_COLUMNS, "pair", "early").mapInPandas(_deal(edges), f"{_ITEM}, pair long, early boolean, range long, low long, high long")
        met = dealt.groupBy(*SHEET, "pair", "range").applyInPandas(_meet, _ITEM)
        lasts = F.broadcast(items.select(*SHEET, "last").distinct())
        out = met.join(lasts, SHEET).unionByName(passes.withColumn("node", F.col("pair")).drop("pair", "early"))
        return cut_lineage(out.withColumn("last", F.expr("last div 2")), "layouts")

    @cached_property
    def final(self) -> DataFrame:
        """Pieces of the layout after the whole batch: (workbook, sheet, origin, lo, hi, down, level), rows lo to hi of an
        origin end ``down`` further down. ``level``: 1 to 4 by height."""
        pieces = self.layout.select(*SHEET, "origin", F.col("row").alias("lo"), F.expr("row + length - 1").alias("hi"), F.expr("start - row").alias("down"))
        size = F.col("hi") - F.col("lo") + 1
        level = F.when(size <= _HEIGHTS[1], 1).when(size <= _HEIGHTS[2], 2).when(size <= _HEIGHTS[3], 3).otherwise(4)
        return cut_lineage(pieces.withColumn("level", level), "layout")

    def move(self, rows: DataFrame) -> DataFrame:
        """Rows (of sheets with shifts) with origin and row -> the same with ``r``, the final row; deleted rows are left out.

        Pieces are looked up in blocks of about their height: a tall one is not cut into many blocks, and few short ones
        share a block.
        """
        levels = [r["level"] for r in self.final.select("level").distinct().collect()]  # at most 4
        height = F.element_at(F.array(*[F.lit(_HEIGHTS[i]) for i in (1, 2, 3, 4)]), F.col("level"))
        pieces = self.final.withColumn("_h", height).select(
            *SHEET, "origin", "level", "lo", "hi", "down", F.explode(F.expr("sequence(lo div _h, hi div _h)")).alias("block"))
        asked = rows.select("*", F.explode(F.array(*[F.lit(i) for i in levels])).alias("level")).withColumn("_h", height)
        asked = asked.withColumn("block", F.expr("row div _h")).drop("_h")
        joined = asked.join(pieces, [*SHEET, "origin", "level", "block"]).where(F.col("row").between(F.col("lo"), F.col("hi")))
        return joined.withColumn("r", F.col("row") + F.col("down")).drop("level", "block", "lo", "hi", "down")


#: Height of the blocks of each level; a piece spans at most two of its own.
_HEIGHTS = {1: ROWS_A_BLOCK, 2: ROWS_A_BLOCK ** 2, 3: ROWS_A_BLOCK ** 4, 4: _OPEN}


def sheet_ends(steps: DataFrame, shifts: DataFrame) -> DataFrame:
    """The last row of a sheet before each stretch of operations between two shifts.

    ``steps``: (workbook, sheet, rank, part, sheet_max_r, added, rel_end), a stretch with the rows it appends and the end of its
    writes; ``shifts`` as in ``RowShifts``. Returns (workbook, sheet, rank, part, at). A sheet's stretches and shifts pass
    through one task in order, which keeps one number.
    """
    ship_package(steps.sparkSession)
    null = lambda *names: [F.lit(None).cast("long").alias(k) for k in names]
    one = steps.select(*SHEET, "rank", F.lit(0).alias("what"), "part", "sheet_max_r", "added", "rel_end", *null("idx", "amount"))
    # The shift that has ``rank`` shifts before it comes after the stretches of that rank.
    two = shifts.join(steps.select(*SHEET, "sheet_max_r").distinct(), SHEET).select(
        *SHEET, "rank", F.when(F.col("insert"), 1).otherwise(2).alias("what"), *null("part"), "sheet_max_r", *null("added", "rel_end"), "idx", "amount")
    dealt = one.unionByName(two).repartition(*SHEET).sortWithinPartitions(*SHEET, "rank", "what", "part")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, end = None, 0
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                if (x.workbook, x.sheet) != current:
                    current, end = (x.workbook, x.sheet), int(x.sheet_max_r)
                if x.what == 0:
                    out.append((x.workbook, x.sheet, x.rank, int(x.part), end))
                    end = int(x.added) + (end if pd.isna(x.rel_end) else max(end, int(x.rel_end)))
                else:
                    end = _shifted(end, x.what, int(x.idx), int(x.amount))
            yield pd.DataFrame(out, columns=["workbook", "sheet", "rank", "part", "at"])

    return dealt.mapInPandas(scan, "workbook string, sheet string, rank long, part long, at long")


def _shifted(end: int, what: int, idx: int, amount: int) -> int:
    if what == 1:
        return end + amount if end >= idx else end
    return end - amount if end >= idx + amount else min(end, idx - 1) if end >= idx else end


def final_rows(rows: DataFrame, shifts: RowShifts) -> DataFrame:
    """``r`` of rows with origin and row, whether or not their sheet has shifts."""
    if not shifts.any:
        return rows.withColumn("r", F.col("row"))
    still = rows.join(shifts.sheets, SHEET, "left_anti").withColumn("r", F.col("row"))
    return still.unionByName(shifts.move(rows.join(shifts.sheets, SHEET, "left_semi")))
