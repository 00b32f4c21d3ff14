"""Tolerance and text matching, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import normalize_text


def relative_match(got: Column, expected: Column, tol: Column) -> Column:
    close = F.abs(got - expected) <= tol * F.greatest(F.lit(1.0), F.abs(expected))
    return F.coalesce(close, F.lit(False))


def absolute_match(got: Column, expected: Column, tol: Column) -> Column:
    return F.coalesce(F.abs(got - expected) <= tol, F.lit(False))


def percent_or_fraction_match(got: Column, expected: Column, tol: Column) -> Column:
    return absolute_match(got, expected, tol) | absolute_match(got, expected / 100.0, tol)


def bool_match(got: Column, expected: Column) -> Column:
    """Null counts as false on either side."""
    return F.coalesce(got, F.lit(False)) == F.coalesce(expected, F.lit(False))


def map_match(got: Column, expected: Column, tol: Column) -> Column:
    """Every expected key present and within the relative tolerance."""
    misses = F.map_filter(expected, lambda k, v: ~relative_match(F.try_element_at(got, k), v, tol))
    return F.size(misses) == 0


def enum_match(answer: Column, accept: Column) -> Column:
    """Any accepted text contained in the answer, or the answer in it, after normalising both."""
    got = normalize_text(answer)
    hit = F.exists(accept, lambda a: got.contains(normalize_text(a)) | normalize_text(a).contains(got))
    return F.coalesce(hit, F.lit(False))


def all_groups_match(answer: Column, groups: Column) -> Column:
    """Each group has at least one token in the answer."""
    got = normalize_text(answer)
    hit = F.forall(groups, lambda g: F.exists(g, lambda t: got.contains(normalize_text(t))))
    return F.coalesce(hit, F.lit(True))


def formula_contains(formula: Column, tokens: Column) -> Column:
    text = F.coalesce(formula, F.lit(""))
    return F.forall(tokens, lambda t: text.contains(t))
