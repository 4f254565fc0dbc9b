"""Taint: the names of a file that carry outside input, closed over its assignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def closure(seeds: Column, edges: Column) -> Column:
    """Names reachable from ``seeds`` over ``edges``, an array of (names read, name written) of one file.

    Each step adds what all edges reach from the names so far; once a step adds nothing, what is left of the steps
    does nothing. Nothing leaves the row, so no shuffle.
    """

    def grow(s: Column, _: Column) -> Column:
        hit = F.filter(edges, lambda e: F.arrays_overlap(e["reads"], s["known"]) & ~F.array_contains(s["known"], e["writes"]))
        more = F.struct(F.array_union(s["known"], F.transform(hit, lambda e: e["writes"])).alias("known"), F.size(s["known"]).alias("before"))
        return F.when(F.size(s["known"]) == s["before"], s).otherwise(more)

    start = F.struct(F.array_distinct(seeds).alias("known"), F.lit(-1).alias("before"))
    return F.when(F.size(edges) == 0, F.array_distinct(seeds)).otherwise(F.aggregate(edges, start, grow, lambda s: s["known"]))


def taints(names: Column, tainted: Column) -> Column:
    return F.coalesce(F.arrays_overlap(names, tainted), F.lit(False))
