"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, running_sums


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(is_null, name, source_size, target): word targets for sources, from (is_null, name, source_size) with one row for each.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes.
    A target stops at ``max_epochs`` times its source; the excess is shared again by weight. Sources
    reach their cap in ascending order of cap / weight, so the level at which resharing ends follows
    from running sums over that order. Both orders are cut into ranges, so there may be any number of sources.
    """
    nth = running_sums(totals.withColumn("one", F.lit(1)), ["is_null", "name"], {"place": "one"})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = nth.select("is_null", "name", "source_size", w.alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    rows = running_sums(rows.withColumn("ratio", F.col("cap") / F.col("w")), ["ratio", "is_null", "name"], {"capped": "cap", "passed": "w"})
    whole = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    left = F.lit(whole.w) - F.col("passed")
    fits = (F.lit(whole.size) - F.col("capped")) * F.col("w") <= F.col("cap") * left
    level = rows.where(fits).agg(F.min(F.struct("capped", left.alias("left"))).alias("level")).first().level
    at = (level.capped, level.left) if level else (0, 1)
    share = (F.lit(whole.size - at[0]) * F.col("w")).cast("double") / F.lit(at[1])
    return rows.select("is_null", "name", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", buckets: int = 4096) -> DataFrame:
    """Give every document the number of its words that the mix takes.

    The key of a document is a hash of its id and ``seed``; the first bits of the key split each
    source into ``buckets`` ranges of equal width, as even as sampled splitters would be because the
    keys are uniform, and the same on every run and retry. Documents are sorted by key in their range;
    sums of the ranges before it plus the running sum inside it give the words before a document, and
    the source is cut at floor(target): full epochs are taken of all, the rest in key order. The
    document on the cut is taken in part.

    Result: all columns of ``docs`` plus size, source_size, target, taken. Null text has size 0, a very long one is counted to its end; null
    is a source of its own; repeated rows are documents of their own (ties by id, then size). An empty
    table gives an empty result; columns named like a result are replaced, others are kept whatever their names.
    """
    names = ("size", "source_size", "target", "taken")
    rest = [c for c in docs.columns if c not in names]
    taken = docs.select(*rest)
    null, name, key, bucket, size, own = free_names(taken, "is_null", "name", "key", "bucket", "size", "own")
    of = [null, name, bucket]
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    base = docs.select(*rest, word_count(F.col(text)).alias(size), F.isnull(source).cast("int").alias(null), F.coalesce(source, F.lit("")).alias(name), hashed.alias(key))
    base = base.withColumn(bucket, F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    ranges = base.groupBy(F.col(null).alias("is_null"), F.col(name).alias("name"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("words"))
    targets = source_targets(ranges.groupBy("is_null", "name").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("is_null", "name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(targets, ["is_null", "name"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = F.struct("source_size", "target", "before", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("cut"))
    inside = Window.partitionBy(*of).orderBy(key, id_col, size).rowsBetween(Window.unboundedPreceding, -1)
    (p,) = free_names(base.withColumn(own, F.lit(0)), "plan")
    ranges = ranges.select(F.col("is_null").alias(null), F.col("name").alias(name), F.col("bucket").alias(bucket), plan.alias(p))
    rows = base.withColumn(own, F.coalesce(F.sum(size).over(inside), F.lit(0))).join(ranges, of)
    part = F.least(F.col(size), F.greatest(F.lit(0), F.col(p)["cut"] - F.col(p)["before"] - F.col(own)))
    return rows.select(*rest, F.col(size).alias("size"), F.col(p)["source_size"].alias("source_size"), F.col(p)["target"].alias("target"), (F.col(p)["epochs"] * F.col(size) + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: a document for each time that the mix takes it.

    The one document on a source's cut stays whole, so a source may exceed its budget by less
    than a document; documents of which nothing is taken, those without a word among them, go.
    """
    rows = mix(docs, **options).where("taken > 0")
    times = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    (time,) = free_names(rows, "time")
    return rows.withColumn(time, F.explode(times)).select(*docs.columns)
