"""Shifts of a sheet composed as a tree, against a list of rows that is edited shift by shift."""

import random

import pytest

from gridloom.operators.shifts import RowShifts


def _plain(n_shifts, rng, heights):
    """(operations, asked points with their origins, rows in the end) of one sheet; a row is (origin, row there)."""
    rows, ops, asked = [(0, i) for i in range(1, 400)], [], set()
    for rank in range(n_shifts + 1):
        for r in (5, rng.randint(1, 150)):
            asked.add((rank, r, *rows[r - 1]))
        if rank == n_shifts:
            return ops, asked, rows
        seq, insert, idx, amount = 2 * rank, rng.random() < 0.5, rng.randint(1, heights), rng.randint(1, 9)
        ops.append((seq, "insert_rows" if insert else "delete_rows", idx, amount, rank))
        rows[idx - 1:idx - 1 + (0 if insert else amount)] = [(seq + 1, i) for i in range(amount)] if insert else []


@pytest.mark.parametrize("sizes", [{}, {"node": 4, "meet": 3, "points_a_task": 7}])
def test_a_tree_of_layouts_moves_rows_like_the_shifts_one_by_one(spark, sizes):
    # 8: a whole number of nodes, so that points after the last shift stand in a node without one.
    rng, sheets = random.Random(5), {"one": (1, 50), "eight": (8, 3), "many": (41, 120)}
    made = {name: _plain(n, rng, heights) for name, (n, heights) in sheets.items()}
    ops = spark.createDataFrame([("b", s, *op) for s, (found, _, _) in made.items() for op in found],
                                "workbook string, sheet string, seq long, type string, idx long, amount long, rank long")
    points = spark.createDataFrame([("b", s, p[0], p[1]) for s, (_, asked, _) in made.items() for p in asked] * 2,
                                   "workbook string, sheet string, rank long, r long")
    shifts = RowShifts(ops, **sizes)
    got = shifts.origins(points).collect()
    assert sorted(tuple(r) for r in got) == sorted(("b", s, *p) for s, (_, asked, _) in made.items() for p in asked)
    for layout in (shifts.layout, RowShifts(ops, **sizes).layout):
        pieces = layout.collect()
        for s, (_, _, rows) in made.items():
            out = []
            for p in sorted((p["start"], p["length"], p["origin"], p["row"]) for p in pieces if p["sheet"] == s):
                assert p[0] == len(out) + 1 or len(out) == 600
                out += [(p[2], p[3] + i) for i in range(min(p[1], 600 - len(out)))]
            assert out[:len(rows)] == rows
