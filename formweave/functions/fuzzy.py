"""Fuzzy scores from 0 to 100, as Column builders.

``ratio`` is the indel similarity (a substitution costs two), from the longest common subsequence. It is computed by
higher-order functions; score different strings only, as the operators do, since a pair costs the product of lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda would compute what it captures at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lcs_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence, row by row of the usual table."""

    def filled(chars: Column) -> Column:
        own, other = chars["a"], chars["b"]

        def next_row(before: Column, c: Column) -> Column:
            def cell(now: Column, j: Column) -> Column:
                step = F.get(before, j - 1) + F.when(F.get(own, j - 1) == c, 1).otherwise(0)
                return F.array_append(now, F.greatest(F.get(before, j), F.get(now, j - 1), step))

            return F.aggregate(F.sequence(F.lit(1), F.size(own)), F.array(F.lit(0)), cell)

        table = F.aggregate(other, F.array_repeat(F.lit(0), F.size(own) + 1), next_row)
        return F.when((F.size(own) > 0) & (F.size(other) > 0), F.get(table, F.size(own))).otherwise(0)

    return _with(F.struct(_chars(a).alias("a"), _chars(b).alias("b")), filled)


def ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 0).otherwise(F.floor(F.lit(200.0) * lcs_length(a, b) / total + F.lit(0.5))).cast("int")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9_]", " ")), " +"), lambda w: w != ""))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio between the common words and either side's, sorted. Other than [A-Za-z0-9_] counts as blank."""

    def joined(w: Column) -> Column:
        both = F.array_sort(F.array_intersect(w["a"], w["b"]))
        side = lambda x, y: F.array_join(F.concat(both, F.array_sort(F.array_except(x, y))), " ")
        return F.struct(F.array_join(both, " ").alias("both"), side(w["a"], w["b"]).alias("a"), side(w["b"], w["a"]).alias("b"))

    best = lambda t: F.greatest(ratio(t["both"], t["a"]), ratio(t["both"], t["b"]), ratio(t["a"], t["b"]))
    return _with(_with(F.struct(_words(a).alias("a"), _words(b).alias("b")), joined), best)


def similarity(a: Column, b: Column) -> Column:
    """A whole-string match outranks a match of word sets."""
    return F.greatest(ratio(a, b), token_set_ratio(a, b) - 1)


def cannot_reach(a: Column, b: Column, least: int) -> Column:
    """Whether lengths alone keep ``ratio`` below ``least`` (not so for word sets)."""
    return 200.0 * F.least(F.length(a), F.length(b)) < (least - 0.5) * (F.length(a) + F.length(b))
