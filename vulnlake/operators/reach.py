"""Taint over tables: the closure of assignments whose graph doesn't fit in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def reachable(seeds: DataFrame, edges: DataFrame, on: str = "file", read: str = "src", written: str = "dst", name: str = "name", most_rounds: int | None = None) -> DataFrame:
    """(on, name): the seeds of each file and all names that its edges (read -> written) reach from them.

    Semi-naive rounds: a round joins only the names that the one before it found with the edges and keeps those not known yet, so each edge
    is followed once. Each round's names are staged; the number of rounds is the longest shortest path. Nothing is grouped by file, so a file
    of any size is spread over tasks. Null keys and names are left out; repeated edges and cycles do no harm.
    """
    keys = [on, name]
    links = stage(edges.select(on, F.col(read).alias(name), F.col(written).alias("to")).dropna().distinct(), "edges")
    known = new = stage(seeds.select(on, name).dropna().distinct(), "reached")
    rounds = 0
    while most_rounds is None or rounds < most_rounds:
        reached = links.join(new, keys).select(on, F.col("to").alias(name)).distinct()
        new = stage(reached.join(known, keys, "left_anti"), "reached")
        if new.isEmpty():
            break
        known, rounds = known.unionByName(new), rounds + 1
    return known


def recursive_sql(seeds: str, edges: str, on: str = "file", read: str = "src", written: str = "dst", name: str = "name", levels: int = 300) -> str:
    """The same as one statement of Spark SQL over views. Each path carries the names it went through, so cycles end; on dense graphs the paths are many."""
    return f"""
WITH RECURSIVE reached({on}, {name}, path) MAX RECURSION LEVEL {levels} AS (
  SELECT {on}, {name}, array({name}) FROM {seeds}
  UNION ALL
  SELECT r.{on}, e.{written}, array_append(r.path, e.{written}) FROM reached r JOIN {edges} e ON e.{on} = r.{on} AND e.{read} = r.{name}
  WHERE NOT array_contains(r.path, e.{written})
)
SELECT DISTINCT {on}, {name} FROM reached"""
