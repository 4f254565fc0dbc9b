"""Confusion counts, rates, set scores and means by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, key: str, truth: Column, found: Column, total: bool = False) -> DataFrame:
    """(key, tp, fn, fp, tn); with ``total`` also a row with a null key for all."""
    counts = [F.count_if(truth & found).alias("tp"), F.count_if(truth & ~found).alias("fn"), F.count_if(~truth & found).alias("fp"), F.count_if(~truth & ~found).alias("tn")]
    return (rows.rollup(key) if total else rows.groupBy(key)).agg(*counts)


def rates(counts: DataFrame) -> DataFrame:
    """Detection and false-positive percentages; null where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, 100.0 * F.col(a) / (F.col(a) + F.col(b)))
    return counts.withColumn("detection", share("tp", "fn")).withColumn("false_positive", share("fp", "tn"))


def compared(left: DataFrame, right: DataFrame, key: str = "cwe") -> DataFrame:
    """Counts of two analyzers side by side; a key that one lacks counts as zero."""
    names = ("tp", "fn", "fp", "tn")
    a = left.select(key, *[F.col(n).alias(f"left_{n}") for n in names])
    b = right.select(key, *[F.col(n).alias(f"right_{n}") for n in names])
    return a.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for s in ("left", "right") for c in [f"{s}_{n}" for n in names]])


def f1(truth: Column, predicted: Column) -> Column:
    """F1 of two arrays as sets; 1 if both are empty, 0 if one is."""
    a, b = F.array_distinct(F.coalesce(truth, F.array())), F.array_distinct(F.coalesce(predicted, F.array()))
    hit = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * hit / (F.size(a) + F.size(b)))


def count_by_cwe(findings: Column) -> Column:
    """Map of CWE to number of findings in an array of findings."""
    cwes = F.transform(findings, lambda f: f["cweId"])
    return F.map_from_entries(F.transform(F.array_distinct(cwes), lambda c: F.struct(c, F.size(F.filter(cwes, lambda x: x == c)))))


def reduction(before: Column, after: Column, cwes: Column) -> Column:
    """struct<score, findings>: the share of findings of the given CWEs that a fix removed; (0, 0) without any."""
    of = lambda a: F.size(F.filter(a, lambda f: F.array_contains(cwes, f["cweId"])))
    old, new = of(before), of(after)
    score = F.when(old == 0, 0.0).otherwise(F.greatest(F.lit(0), old - new) / old)
    return F.struct(score.cast("double").alias("score"), old.alias("findings"))


def introduced(before: Column, after: Column) -> Column:
    """Findings that a fix added, by CWE, in all."""
    old, new = count_by_cwe(before), count_by_cwe(after)
    added = F.transform(F.map_entries(new), lambda e: F.greatest(F.lit(0), e["value"] - F.coalesce(F.try_element_at(old, e["key"]), F.lit(0))))
    return F.aggregate(added, F.lit(0), lambda n, x: n + x)


def fix_score(language: Column, reduced: Column, compiles: Column, added: Column) -> Column:
    """Java counts the reduction alone, others 0.8 of it and 0.2 of compiling; 0.05 off for each added finding, 0.8 at most."""
    penalty = F.least(F.lit(0.8), 0.05 * added)
    raw = F.when(language == "java", reduced - penalty).otherwise(0.8 * reduced + 0.2 * compiles - penalty)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def final_score(truth: Column, predicted: Column, cwe_score: Column, fix: Column) -> Column:
    """Half the CWE score and half the fix score; of a safe sample the fix score is 1 if nothing is predicted, else 0."""
    safe = F.size(F.coalesce(truth, F.array())) == 0
    own = F.when(safe, F.when(F.size(F.coalesce(predicted, F.array())) == 0, 1.0).otherwise(0.0)).otherwise(fix)
    return 0.5 * cwe_score + 0.5 * own


def means(rows: DataFrame, scores: list[str], by: str | None = None) -> DataFrame:
    """Means of the scores, overall or by a column; an array column counts a row for each of its items."""
    agg = [F.avg(s).alias(s) for s in scores] + [F.count(F.lit(1)).alias("samples")]
    if by is None:
        return rows.agg(*agg)
    key = F.explode(by) if dict(rows.dtypes)[by].startswith("array") else F.col(by)
    return rows.select(key.alias(by), *scores).groupBy(by).agg(*agg)


def grouped_means(rows: DataFrame, scores: list[str], by: list[str]) -> DataFrame:
    """Means of the scores by each column of ``by`` and over all, in one pass: grouping sets over one expansion.

    Result: grouping (the column's name, or "all"), group (its value as text; null for all and for rows without one), the means, samples. A sample counts
    once for each item of an array column, and once in all other groups, however many items it has.
    """
    arrays = [c for c in by if dict(rows.dtypes)[c].startswith("array")]
    if len(arrays) > 1:
        raise ValueError("one array column at most")
    marked = rows.select(*by, *scores, F.lit(0).alias("first"))
    if arrays:  # an item's place tells the row that stands for the whole sample
        others = [c for c in (*by, *scores) if c not in arrays]
        marked = rows.select(*others, F.posexplode_outer(arrays[0]).alias("first", arrays[0]))
    sets = [[c] for c in by] + [[]]
    whole = F.coalesce(F.col("first"), F.lit(0)) == 0
    kinds = F.expr(f"grouping_id({', '.join(by)})")
    own = {c: 2 ** len(by) - 1 - 2 ** (len(by) - 1 - i) for i, c in enumerate(by)}
    # Items after the first count in the groups of the array column alone, so sums and counts of both kinds are kept apart.
    sums = [x for s in scores for x in (F.sum(s).alias(f"{s}__items"), F.sum(F.when(whole, F.col(s))).alias(f"{s}__whole"), F.count(s).alias(f"{s}__n"), F.count(F.when(whole, F.col(s))).alias(f"{s}__m"))]
    grouped = marked.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(kinds.alias("kind"), F.count(F.lit(1)).alias("items"), F.count_if(whole).alias("wholes"), *sums)
    itemised = F.col("kind") == own[arrays[0]] if arrays else F.lit(False)
    name = F.lit("all")
    value = F.lit(None).cast("string")
    for c in by:
        name, value = F.when(F.col("kind") == own[c], c).otherwise(name), F.when(F.col("kind") == own[c], F.col(c).cast("string")).otherwise(value)
    mean = lambda s: F.when(itemised, F.try_divide(f"{s}__items", f"{s}__n")).otherwise(F.try_divide(f"{s}__whole", f"{s}__m")).alias(s)
    return grouped.select(name.alias("grouping"), value.alias("group"), *[mean(s) for s in scores], F.when(itemised, F.col("items")).otherwise(F.col("wholes")).alias("samples"))


def report(rows: DataFrame, scores: list[str], by: str, digits: int = 4) -> DataFrame:
    """Rounded means by group in ascending order; rows without a group, and groups without a score, are left out."""
    shown = means(rows, scores, by).where(F.col(by).isNotNull() & F.coalesce(*scores).isNotNull())
    return shown.select(by, *[F.round(s, digits).alias(s) for s in scores], "samples").orderBy(by)


def tags(findings: Column) -> Column:
    """The distinct CWEs of an array of findings, in the order in which they are first seen; (none) without any."""
    return F.when(F.coalesce(F.size(findings), F.lit(0)) > 0, F.array_join(F.array_distinct(F.transform(findings, lambda f: f["cweId"])), ", ")).otherwise(F.lit("(none)"))


def passed(rows: DataFrame, key: str, found: Column) -> DataFrame:
    """How many of each key pass."""
    return rows.groupBy(key).agg(F.count_if(found).alias("passed"), F.count(F.lit(1)).alias("total"))


def new_best(rows: DataFrame, score: str, order: str) -> DataFrame:
    """Marks the rows whose score is above all before; for keeping checkpoints. One row for each epoch of a training run, so one task is enough."""
    before = F.max(score).over(Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("best", F.coalesce(F.col(score) > before, F.lit(True)))
