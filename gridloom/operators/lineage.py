"""L1-L4: formula precedents as edges, traced from many roots at once, level by level; circular references."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import a1
from gridloom.functions.references import extract_refs
from gridloom.operators.bands import SHEET
from gridloom.operators.ranges import RANGE_BLOCK
from gridloom.session import cut_lineage, ship_package

# Default depth of a trace, and the largest range whose values are listed by default.
MAX_DEPTH = 5
VALUE_CAP = 32
#: Ranges up to this size are spread to single cells; larger ones meet the formulas of their row blocks. Same result.
SPREAD_CELLS = 32

#: Edges on and between cycles that one task searches.
CORE_EDGES = 2_000_000
#: Trimming and chains end when a round leaves more than this share of the edges.
LEAST_SHRINK = 0.95
#: Nodes of a frontier that are named in the filter of the scan; a larger one is joined.
NAMED_NODES = 200

NODE = ["workbook", "sheet", "ref"]


def formula_refs(cells: DataFrame) -> DataFrame:
    """L1: (workbook, sheet, r, c, pos, ref_sheet, ref), one row per distinct reference of a formula."""
    formulas = cells.where(F.col("formula").isNotNull()).select(*SHEET, "r", "c", "formula")
    return formulas.select(
        *SHEET, "r", "c", F.posexplode(extract_refs(F.col("formula"), F.col("sheet"))).alias("pos", "x")
    ).select(*SHEET, "r", "c", "pos", F.col("x.sheet").alias("ref_sheet"), F.col("x.ref").alias("ref"))


def with_area(refs: DataFrame) -> DataFrame:
    # Steps of their own: each is worked out once a row.
    bounded = refs.withColumn("_hit", a1.range_hit(F.col("ref"))).withColumn("_b", a1.hit_bounds(F.col("_hit"))).select("*", "_b.*").drop("_hit", "_b")
    area = (F.col("max_r") - F.col("min_r") + 1) * (F.col("max_c") - F.col("min_c") + 1)
    return bounded.withColumn("is_range", F.col("ref").contains(":")).withColumn("area", area)


def spread_cells(refs: DataFrame, most: int | None = None) -> DataFrame:
    """L2: the single cells behind each reference, for ranges of up to ``most`` cells (None: all)."""
    return (
        (refs if most is None else refs.where(F.col("area") <= most))
        .select(*NODE, F.explode(F.sequence("min_r", "max_r")).alias("r"), "min_c", "max_c")
        .select(*NODE, "r", F.explode(F.sequence("min_c", "max_c")).alias("c"))
    )


def mentioned_nodes(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """All references that some formula mentions, and the roots: (workbook, sheet, ref)."""
    refs = formula_refs(cells).select("workbook", F.col("ref_sheet").alias("sheet"), "ref")
    return refs.union(roots.select(*NODE)).distinct()


class LineageGraph:
    """Precedents of some reference nodes, found on demand: only formulas that a trace reaches are read and taken apart.

    A node is a (sheet, reference text). A range node leads to the distinct references of the formulas inside it: the cell
    level is skipped. Every node is expanded once, however many roots and depths reach it. A short frontier is named in the
    scan's filter, so a trace of one cell reads the row groups it reaches and no others.

    ``range_cap``: ranges of more cells are not followed (None, the default, follows all). ``value_cap``: ranges of more
    cells list no values (None lists all; the array then has an entry per cell of the range).
    """

    def __init__(self, cells: DataFrame, roots: DataFrame, range_cap: int | None = None, value_cap: int | None = VALUE_CAP,
                 sheets: DataFrame | None = None):
        """``roots``: (workbook, sheet, ref). ``sheets``: all known sheets, some perhaps without a stored cell."""
        self.cells, self.range_cap, self.value_cap, self.sheets = cells, range_cap, value_cap, sheets
        self.roots = cut_lineage(roots.select(
            "workbook", "sheet", F.upper(F.replace(F.col("ref"), F.lit("$"), F.lit(""))).alias("ref")).distinct(), "trace_roots")
        self.expanded: DataFrame | None = None
        #: (workbook, sheet, ref, child_sheet, child_ref) of all expanded nodes.
        self.edges: DataFrame | None = None

    def _cells_at(self, nodes: DataFrame) -> DataFrame:
        """The cells that nodes (with bounds) can need: by name while they are few."""
        listed = nodes.select(*SHEET, "min_r", "max_r").limit(NAMED_NODES + 1).collect()
        if len(listed) > NAMED_NODES:
            return self.cells
        spots: dict[tuple, list[tuple]] = {}
        for n in listed:
            if n["min_r"] is not None:
                spots.setdefault((n["workbook"], n["sheet"]), []).append((n["min_r"], n["max_r"]))
        meant = F.lit(False)
        for (workbook, sheet), rows in spots.items():
            inside = F.lit(False)
            for lo, hi in sorted(set(rows)):
                inside = inside | F.col("r").between(lo, hi)
            meant = meant | ((F.col("workbook") == workbook) & (F.col("sheet") == sheet) & inside)
        return self.cells.where(meant)

    def _children(self, new: DataFrame) -> DataFrame:
        # Read several times below, with filters on the bounds.
        nodes = cut_lineage(with_area(new), "bounded")
        nodes = nodes if self.range_cap is None else nodes.where(F.col("area") <= self.range_cap)
        formulas = self._cells_at(nodes).where(F.col("formula").isNotNull()).select(*SHEET, "r", "c", "formula")
        # Exploded, so larger than its estimate: never broadcast on that.
        hits = spread_cells(nodes, SPREAD_CELLS).hint("merge").join(formulas, [*SHEET, "r", "c"])
        refs = F.posexplode(extract_refs(F.col("formula"), F.col("sheet"))).alias("pos", "x")
        links = hits.select(*NODE, "r", "c", refs).select(*NODE, "r", "c", "pos", F.col("x.sheet").alias("child_sheet"), F.col("x.ref").alias("child_ref"))
        tall = nodes.where(F.col("area") > SPREAD_CELLS)
        if not tall.isEmpty():
            block = lambda at: F.expr(f"{at} div {RANGE_BLOCK}")
            pieces = tall.select(*NODE, "min_r", "max_r", "min_c", "max_c", F.explode(F.sequence(block("min_r"), block("max_r"))).alias("block"))
            met = formulas.withColumn("block", block("r")).join(pieces.hint("merge"), [*SHEET, "block"]).where(
                F.col("r").between(F.col("min_r"), F.col("max_r")) & F.col("c").between(F.col("min_c"), F.col("max_c")))
            met = cut_lineage(met.select(*NODE, "r", "c", "formula"), "range_formulas")
            # Ranges overlap: each formula in them is taken apart once.
            own = formula_refs(met.select(*SHEET, "r", "c", "formula").distinct()).withColumnsRenamed({"ref_sheet": "child_sheet", "ref": "child_ref"})
            links = links.unionByName(met.select(*NODE, "r", "c").join(own.hint("merge"), [*SHEET, "r", "c"]).select(
                *NODE, "r", "c", "pos", "child_sheet", "child_ref"))
        return links.select(*NODE, "child_sheet", "child_ref").distinct()

    def expand(self, nodes: DataFrame) -> DataFrame:
        """The edges that start at nodes (distinct, stored). Nodes met before are not expanded again."""
        new = nodes if self.expanded is None else cut_lineage(nodes.join(self.expanded, NODE, "left_anti"), "frontier")
        made = cut_lineage(self._children(new), "ref_edges")
        if self.expanded is None:
            self.expanded, self.edges = new, made
            return made
        old = self.edges.join(nodes.join(self.expanded, NODE, "left_semi"), NODE, "left_semi")
        self.expanded, self.edges = self.expanded.unionByName(new), self.edges.unionByName(made)
        return cut_lineage(made.unionByName(old), "level_edges")

    def node_values(self, nodes: DataFrame) -> DataFrame:
        """Value(s), formula and error of nodes (distinct, stored)."""
        nodes = with_area(nodes)
        found = self._cells_at(nodes).select(*SHEET, "r", "c", "val_text", "formula")
        spread = spread_cells(nodes, self.value_cap).join(found, [*SHEET, "r", "c"], "left")
        values = spread.groupBy(*NODE).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "val_text"))), lambda x: x["val_text"]).alias("vals"),
            F.max("formula").alias("formula"))
        sheets = self.cells.select(*SHEET)
        if self.sheets is not None:
            sheets = sheets.union(self.sheets.select(*SHEET))
        asked = [tuple(r) for r in nodes.select(*SHEET).distinct().limit(NAMED_NODES + 1).collect()]
        if len(asked) <= NAMED_NODES:
            sheets = sheets.where(F.col("workbook").isin(sorted({w for w, _ in asked})) & F.col("sheet").isin(sorted({s for _, s in asked})))
        sheets = sheets.distinct().withColumn("known", F.lit(True))
        return (
            nodes.select(*NODE, "is_range").join(values, NODE, "left").join(sheets, SHEET, "left")
            .select(
                *NODE, "is_range",
                F.when(~F.col("is_range") & F.col("known"), F.get(F.col("vals"), F.lit(0))).alias("value"),
                F.when(F.col("is_range") & F.col("known"), F.col("vals")).alias("values"),
                F.when(~F.col("is_range"), F.col("formula")).alias("formula"),
                F.when(F.col("known").isNull(), F.lit("sheet_not_found")).alias("error"))
        )

    @staticmethod
    def _ends(edges: DataFrame) -> DataFrame:
        return edges.select("workbook", F.col("child_sheet").alias("sheet"), F.col("child_ref").alias("ref")).distinct()

    def trace(self, depth: int = MAX_DEPTH, with_values: bool = True) -> DataFrame:
        """L3: every node reached from every root, one row per path.

        Columns: root_sheet, root_ref, depth, path, parent_ref, node columns. Cycles end by depth.
        """
        label = lambda sheet, ref: F.concat_ws("!", sheet, ref)
        child = label("child_sheet", "child_ref")
        # Down: the edges that start at each depth, once per distinct node however many roots share it.
        edges, nodes = [], self.roots
        for _ in range(max(0, depth)):
            found = self.expand(nodes)
            if found.isEmpty():
                break
            edges.append(found)
            nodes = cut_lineage(self._ends(found), "frontier")
        # Up: what lies below a node, as paths relative to it. Roots meet it in the last join only.
        below = None
        for step in reversed(edges):
            first = step.select(
                *NODE, F.col("child_sheet").alias("to_sheet"), F.col("child_ref").alias("to_ref"), F.lit(1).cast("long").alias("depth"),
                label("sheet", "ref").alias("parent_ref"), child.alias("path"))
            if below is not None:
                under = below.select("workbook", F.col("sheet").alias("child_sheet"), F.col("ref").alias("child_ref"), "to_sheet", "to_ref", "depth", "parent_ref",
                                     F.col("path").alias("rest"))
                first = first.unionByName(step.join(under, ["workbook", "child_sheet", "child_ref"]).select(
                    *NODE, "to_sheet", "to_ref", (F.col("depth") + 1).alias("depth"), "parent_ref", F.concat_ws(" > ", child, "rest").alias("path")))
            below = first
        own = label("sheet", "ref")
        reached = self.roots.select(
            "workbook", F.col("sheet").alias("root_sheet"), F.col("ref").alias("root_ref"), "sheet", "ref",
            F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent_ref"), own.alias("path"))
        if below is not None:
            reached = reached.unionByName(below.select(
                "workbook", F.col("sheet").alias("root_sheet"), F.col("ref").alias("root_ref"), F.col("to_sheet").alias("sheet"), F.col("to_ref").alias("ref"),
                "depth", "parent_ref", F.concat_ws(" > ", own, "path").alias("path")))
        if not with_values:
            return reached
        met = self.roots
        for found in edges:
            met = met.unionByName(self._ends(found))
        return reached.join(self.node_values(cut_lineage(met.distinct(), "traced")), NODE, "left")

    def reachable(self, depth: int | None = MAX_DEPTH) -> DataFrame:
        """The distinct nodes that each root reaches, with the least depth. Paths are not kept, so shared parts cost once.

        ``depth`` None: to the end. A node that a root has reached is not followed again, so cycles end there.
        """
        level = self.roots.select(*NODE, F.col("sheet").alias("to_sheet"), F.col("ref").alias("to_ref"), F.lit(0).cast("long").alias("depth"))
        seen = level = cut_lineage(level, "reached")
        step = 0
        while depth is None or step < depth:
            step += 1
            ends = cut_lineage(level.select("workbook", F.col("to_sheet").alias("sheet"), F.col("to_ref").alias("ref")).distinct(), "frontier")
            further = level.select("workbook", F.col("sheet").alias("_s"), F.col("ref").alias("_r"), F.col("to_sheet").alias("sheet"), F.col("to_ref").alias("ref")).join(
                self.expand(ends), NODE).select(
                "workbook", F.col("_s").alias("sheet"), F.col("_r").alias("ref"), F.col("child_sheet").alias("to_sheet"), F.col("child_ref").alias("to_ref")).distinct()
            level = cut_lineage(further.join(seen, [*NODE, "to_sheet", "to_ref"], "left_anti").withColumn("depth", F.lit(step).cast("long")), "reached")
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        return seen.select("workbook", F.col("sheet").alias("root_sheet"), F.col("ref").alias("root_ref"), F.col("to_sheet").alias("sheet"), F.col("to_ref").alias("ref"), "depth")

    def close(self) -> DataFrame:
        """All edges that the roots reach, however deep."""
        nodes = self.roots
        while not nodes.isEmpty():
            found = self.expand(nodes)
            nodes = cut_lineage(self._ends(found).join(self.expanded, NODE, "left_anti"), "frontier")
        return self.edges

    def cycles(self) -> DataFrame:
        """Circular references: (workbook, sheet, ref, cycle_sheet, cycle_ref), a node of a cycle and the least node of its
        strongly connected component."""
        edges = self.close()
        # One text per node that sorts by sheet, then by reference.
        label = lambda sheet, ref: F.concat(F.col(sheet), F.lit("\1"), F.col(ref))
        found = strong_components(edges.select("workbook", label("sheet", "ref").alias("a"), label("child_sheet", "child_ref").alias("b")), ["workbook"])
        part = lambda of, i: F.split(F.col(of), "\1")[i]
        return found.select("workbook", part("node", 0).alias("sheet"), part("node", 1).alias("ref"), part("root", 0).alias("cycle_sheet"), part("root", 1).alias("cycle_ref"))


def _searched(edges: DataFrame, key: list[str], core_edges: int) -> tuple[DataFrame, DataFrame]:
    """Components of the graphs that one task can search, and the edges of the others."""
    ship_package(edges.sparkSession)
    small = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= core_edges).select(*key)
    types = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in key)
    found = edges.join(small, key, "left_semi").groupBy(*key).applyInPandas(_core_components, f"{types}, node string, root string")
    return cut_lineage(found, "cycle_part"), cut_lineage(edges.join(small, key, "left_anti"), "cycle_edges")


def strong_components(edges: DataFrame, key: list[str], core_edges: int = CORE_EDGES) -> DataFrame:
    """(key, a, b), edges between texts -> (key, node, root) for every node of a cycle; root: the least node of its component.

    A graph of up to ``core_edges`` edges is searched in one task. Of a larger one, nodes without a way in or a way out go
    first, as they are on no cycle; chains, whose nodes have one of each, are followed by doubling, so a long one costs the
    logarithm of its length. What is left, the core, lies on or between cycles: it is searched in one task if it is small
    enough now, else told apart by the least node that reaches each node, and by going back from it (the nodes met both ways
    are its component), in as many rounds as its longest way.
    """
    edges = cut_lineage(edges.select(*key, "a", "b").distinct(), "cycle_edges")
    part, left = _searched(edges, key, core_edges)
    parts, skipped, before = [part], [], None
    while not left.isEmpty():
        # Trim, then replace chains by one edge each, while that makes the graph notably smaller.
        size = left.count()
        if before is not None and size > LEAST_SHRINK * before:
            break
        before = size
        ins, outs = left.groupBy(*key, F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n_in")), left.groupBy(*key, F.col("a").alias("node")).agg(
            F.count(F.lit(1)).alias("n_out"))
        both = cut_lineage(ins.join(outs, [*key, "node"]), "cycle_nodes")  # nodes with a way in and a way out
        keep = both.select(*key, "node")
        left = cut_lineage(left.join(keep.withColumnRenamed("node", "a"), [*key, "a"], "left_semi").join(
            keep.withColumnRenamed("node", "b"), [*key, "b"], "left_semi"), "cycle_edges")
        now = left.count()
        if now < size:
            continue
        thin = both.where("n_in = 1 and n_out = 1").select(*key, "node")
        chain = cut_lineage(left.join(thin.withColumnRenamed("node", "a"), [*key, "a"], "left_semi"), "cycle_chain")  # thin node -> its only way out
        if chain.isEmpty():
            break
        # low: the least node between here and there, so that a ring of thin nodes finds its name.
        run = chain.select(*key, F.col("a").alias("node"), F.col("b").alias("to"), F.least("a", "b").alias("low"))
        rounds, longest = 0, chain.count()
        while True:
            nxt = run.select(*key, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
            run = cut_lineage(run.join(nxt, [*key, "to"], "left").select(
                *key, "node", F.coalesce("_to", "to").alias("to"), F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("_to").isNotNull().alias("on")), "cycle_run")
            rounds += 1
            if run.where("on").isEmpty() or 2 ** rounds > 2 * longest:
                break
            run = run.drop("on")
        ring = run.where("on")  # never left the thin nodes: a ring of its own
        parts.append(cut_lineage(ring.select(*key, "node", F.col("low").alias("root")), "cycle_part"))
        ends = run.where("not on").select(*key, "node", "to")
        # An edge into a chain goes to its end; the thin nodes on the way are remembered with both ends of it.
        into = left.join(thin.withColumnRenamed("node", "a"), [*key, "a"], "left_anti").join(ends.select(*key, F.col("node").alias("b"), "to"), [*key, "b"], "left")
        whole = cut_lineage(into.select(*key, "a", F.col("b").alias("via"), F.coalesce("to", "b").alias("b"), F.col("to").isNotNull().alias("long")), "cycle_whole")
        firsts = chain.select(*key, F.col("a").alias("node"), F.col("b").alias("next"))
        back = _chain_starts(firsts, key)
        skipped.append(cut_lineage(back.join(whole.where("long").select(*key, F.col("via").alias("start"), "a", "b"), [*key, "start"]).select(*key, "node", "a", "b"), "cycle_skipped"))
        left = cut_lineage(whole.select(*key, "a", "b").distinct(), "cycle_edges")
    part, left = _searched(left, key, core_edges)
    parts.append(part)
    while not left.isEmpty():
        parts.append(_component_round(left, key))
        done = parts[-1].select(*key, "node")
        left = cut_lineage(left.join(done.withColumnRenamed("node", "a"), [*key, "a"], "left_anti").join(
            done.withColumnRenamed("node", "b"), [*key, "b"], "left_anti"), "cycle_edges")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    for passed in reversed(skipped):  # a chain lies on a cycle when both its ends lie on the same one
        one = found.select(*key, F.col("node").alias("a"), F.col("root").alias("_a"))
        two = found.select(*key, F.col("node").alias("b"), F.col("root").alias("_b"))
        on = passed.join(one, [*key, "a"]).join(two, [*key, "b"]).where("_a = _b").select(*key, "node", F.col("_a").alias("root"))
        found = cut_lineage(found.unionByName(on.distinct()), "cycle_found")
    # A single node is a cycle only with an edge to itself.
    sizes = found.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_least"))
    loops = edges.where("a = b").select(*key, F.col("a").alias("node"), F.lit(True).alias("_loop"))
    named = found.join(sizes, [*key, "root"]).join(loops, [*key, "node"], "left").where("_n > 1 or _loop")
    return named.select(*key, "node", F.col("_least").alias("root"))


def _core_components(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of one graph: depth-first with low links, without recursion."""
    codes, nodes = pd.factorize(pd.concat([edges["a"], edges["b"]]), sort=True)
    start, end = codes[:len(edges)], codes[len(edges):]
    order = np.argsort(start, kind="stable")
    ways, first = end[order].tolist(), np.searchsorted(start[order], np.arange(len(nodes) + 1)).tolist()
    index, low, on, root, path, count = [-1] * len(nodes), [0] * len(nodes), [False] * len(nodes), [0] * len(nodes), [], 0
    for begin in range(len(nodes)):
        if index[begin] >= 0:
            continue
        work = [begin]
        at = {begin: first[begin]}
        while work:
            node = work[-1]
            if index[node] < 0:
                index[node] = low[node] = count
                count += 1
                path.append(node)
                on[node] = True
            while at[node] < first[node + 1]:
                to = ways[at[node]]
                if index[to] < 0:
                    work.append(to)
                    at[to] = first[to]
                    break
                at[node] += 1
                if on[to]:
                    low[node] = min(low[node], low[to])
            else:
                work.pop()
                del at[node]
                if low[node] == index[node]:
                    members = [path.pop()]
                    while members[-1] != node:
                        members.append(path.pop())
                    least = min(members)
                    for m in members:
                        on[m], root[m] = False, least
    out = pd.DataFrame({"node": nodes, "root": nodes[np.array(root, dtype=np.int64)]})
    for name, value in zip(edges.columns, key):
        out[name] = value
    return out


def _chain_starts(chain: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, next): thin nodes -> (key, node, start), the first thin node of each one's chain, by doubling."""
    before = chain.join(chain.select(*key, F.col("node").alias("next"), F.lit(True).alias("_thin")), [*key, "next"]).select(
        *key, F.col("next").alias("node"), F.col("node").alias("start"))
    run = chain.select(*key, "node").join(before, [*key, "node"], "left").select(*key, "node", F.coalesce("start", "node").alias("start"))
    run, rounds, longest = cut_lineage(run, "chain_starts"), 0, chain.count()
    while 2 ** rounds <= 2 * longest:
        hop = run.select(*key, F.col("node").alias("start"), F.col("start").alias("_start"))
        further = cut_lineage(run.join(hop, [*key, "start"]).select(*key, "node", F.col("_start").alias("start"), (F.col("_start") != F.col("start")).alias("on")), "chain_starts")
        run, rounds = further.drop("on"), rounds + 1
        if further.where("on").isEmpty():
            break
    return run


def _component_round(edges: DataFrame, key: list[str]) -> DataFrame:
    """Components of the nodes that are the least among all that reach them: (key, node, root)."""
    nodes = edges.select(*key, F.col("a").alias("node")).union(edges.select(*key, F.col("b").alias("node"))).distinct()
    color = cut_lineage(nodes.withColumn("root", F.col("node")), "cycle_color")
    while True:  # the least node that reaches each node
        sent = edges.join(color.withColumnRenamed("node", "a"), [*key, "a"]).groupBy(*key, F.col("b").alias("node")).agg(F.min("root").alias("_new"))
        moved = cut_lineage(color.join(sent, [*key, "node"], "left").select(
            *key, "node", F.least("root", F.coalesce("_new", "root")).alias("root"), (F.col("_new") < F.col("root")).alias("on")), "cycle_color")
        color = moved.drop("on")
        if moved.where("on").isEmpty():
            break
    # Back from each such node, within what it reaches.
    inner = edges.join(color.select(*key, F.col("node").alias("a"), F.col("root").alias("_a")), [*key, "a"]).join(
        color.select(*key, F.col("node").alias("b"), F.col("root").alias("_b")), [*key, "b"]).where("_a = _b").select(*key, "a", "b")
    inner = cut_lineage(inner, "cycle_inner")
    met = level = cut_lineage(color.where("node = root"), "cycle_met")
    while True:
        further = inner.join(level.select(*key, F.col("node").alias("b"), "root"), [*key, "b"]).select(*key, F.col("a").alias("node"), "root").distinct()
        level = cut_lineage(further.join(met, [*key, "node"], "left_anti"), "cycle_met")
        if level.isEmpty():
            return met
        met = met.unionByName(level)


def trace_cell(cells: DataFrame, workbook: str, sheet: str, cell: str, depth: int = MAX_DEPTH, **options) -> DataFrame:
    root = cells.sparkSession.range(1).select(
        F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), F.lit(cell).alias("ref"))
    book = cells.where(F.col("workbook") == workbook)
    return LineageGraph(book, root, **options).trace(depth)


def direct_precedents(refs: DataFrame) -> DataFrame:
    """L4 input: ordered references and the sheets they lie on, per formula cell."""
    return refs.groupBy(*SHEET, "r", "c").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("precedents"),
        F.array_sort(F.collect_set("ref_sheet")).alias("precedent_sheets"))


def precedents_cover(precedents, expected):
    """L4: every expected precedent is present."""
    return F.size(F.array_except(expected, precedents)) == 0
