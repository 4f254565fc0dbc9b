"""Joins that Spark has no operator for: as-of joins of two tables, and points inside intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import free_names, stage


def _no_clash(left: DataFrame, names: list[str]) -> None:
    clash = {c.lower() for c in left.columns} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str | None = None, strict: bool = False, direction: str = "backward", tie: Sequence[str] = ()) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` at or before it (forward: the first at or after it) of the same key.

    ``at`` and ``right_at`` are places or times of one type; ``strict`` leaves out equal ones. Of rows of ``right`` at one place the
    last by the columns ``tie`` (all given columns without it) counts, going forward the first.

    Rows of both sides go into one table in one order (key, place, side, hash) that is cut into ranges and staged, so a key with most rows
    lies in many partitions. The last row of ``right`` is carried down inside a partition by one window, and from partition to
    partition by another over one row for each key and partition.

    Result: columns of ``left``, then those of ``right`` but the key, null without a match. A column name that both sides have is an error. A
    null key or place matches nothing. Each row of ``left`` comes once, repeated ones too. An empty side is no special case.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    forward, right_at, on = direction == "forward", right_at or at, list(on)
    gives = [c for c in right.columns if c not in on]
    _no_clash(left, gives)
    key, place, side, spread, own, given, order, part, carried = free_names(
        [*left.columns, *right.columns], "key", "place", "side", "spread", "own", "given", "order", "part", "carried"
    )
    usable = F.col(at).isNotNull()
    for c in on:
        usable &= F.col(c).isNotNull()
    # In ascending order, right stands before left at the same place if it is to be met there going up, after it otherwise.
    right_last = int(strict != forward)
    tied = F.struct(*[F.col(c) for c in (tie or gives)])
    best = (F.min_by if forward else F.max_by)(F.struct(*gives), tied)
    theirs = right.where(F.col(right_at).isNotNull()).groupBy(F.struct(*on).alias(key), F.col(right_at).alias(place)).agg(best.alias(given))
    theirs = theirs.select(key, place, F.lit(right_last).alias(side), F.lit(0).cast("long").alias(spread), given)
    mine = left.where(usable).select(
        F.struct(*on).alias(key), F.col(at).alias(place), F.lit(1 - right_last).alias(side), F.xxhash64(*left.columns).alias(spread), F.struct(*left.columns).alias(own)
    )
    both = mine.unionByName(theirs, allowMissingColumns=True).repartitionByRange(key, place, side, spread)
    dealt = stage(both.withColumn(part, F.spark_partition_id()), "as-of")
    step = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    # Running "last so far" of (place, given), where given isn't null: an ordered frame inside the partition ...
    inside = Window.partitionBy(key, part).orderBy(step(place), step(side)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last(F.col(given), ignorenulls=True).over(inside)
    # ... and the last of each partition for those that follow.
    ends = dealt.groupBy(key, part).agg((F.min_by if forward else F.max_by)(given, F.when(F.col(given).isNotNull(), F.col(place))).alias(carried))
    before = Window.partitionBy(key).orderBy(step(part)).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, part, F.last(carried, ignorenulls=True).over(before).alias(carried))
    found = dealt.withColumn(given, near).where(F.col(own).isNotNull()).join(ends, [key, part], "left")
    value = F.coalesce(given, carried)
    out = found.select(F.col(own), value.alias(given)).select(f"{own}.*", *[F.col(given)[c].alias(c) for c in gives])
    types = dict(right.dtypes)
    return out.unionByName(left.where(~usable | usable.isNull()).select("*", *[F.lit(None).cast(types[c]).alias(c) for c in gives]))


def containing(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, start: str, end: str, how: str = "inner", innermost: bool = False) -> DataFrame:
    """Every row of ``points`` with the rows of ``spans`` of the same key with start <= at < end; ``innermost``: with the shortest alone.

    Places are integers. Intervals are dealt to bins as wide as they are long, by powers of two, so each lies in two bins at most however
    long it is; a point looks into one bin of each width that occurs (64 at most, which the driver asks for). The join is on equal key, width and
    bin, so only intervals within two lengths of a point are compared with it, and nothing joins on a condition alone. It is a sort-merge join whatever
    size Spark expects: points repeated for each width are many times the file they come from, which would be broadcast through the driver.

    ``how``: inner, left (a point outside all intervals comes once, with nulls), semi or anti. Of equally short intervals the one with the smaller
    start, then the smaller columns, is the innermost. Result: columns of ``points``, then those of ``spans`` but the key; a name that both have is an
    error. A null key, place or border matches nothing, and neither does an empty interval. Repeated rows match each on their own.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError("how is inner, left, semi or anti")
    on = list(on)
    gives = [c for c in spans.columns if c not in on]
    if how in ("inner", "left"):
        _no_clash(points, gives)
    width, bucket, row, best, span = free_names([*points.columns, *spans.columns], "width", "bucket", "row", "best", "span")
    whole = lambda c: F.col(c).cast("long")
    length = whole(end) - whole(start)
    binned = spans.where(length > 0).select(*on, F.struct(*gives).alias(span), whole(start).alias("lo"), whole(end).alias("hi"), length.alias("size"))
    binned = binned.withColumn(width, F.when(F.col("size") <= 1, F.lit(0)).otherwise(F.char_length(F.bin(F.col("size") - 1))))
    shifted = lambda x: F.call_function("shiftright", x, F.col(width))
    binned = binned.withColumn(bucket, F.explode(F.array_distinct(F.array(shifted(F.col("lo")), shifted(F.col("hi") - 1)))))
    widths = [r[0] for r in binned.select(width).distinct().collect()]
    if how != "inner" or innermost:
        points = stage(points.withColumn(row, F.monotonically_increasing_id()), "points")
    own = [c for c in points.columns if c != row]
    probes = points.withColumn(width, F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>"))).withColumn(bucket, shifted(whole(at)))
    hit = probes.alias("p").join(binned.hint("merge").alias("s"), [*on, width, bucket]).where(F.expr(f"CAST(p.`{at}` AS BIGINT) >= s.lo AND CAST(p.`{at}` AS BIGINT) < s.hi"))
    shown = lambda df: df.select(*own, *[F.col(span)[c].alias(c) for c in gives])
    if how == "inner" and not innermost:
        return shown(hit)
    if how in ("semi", "anti"):
        return points.join(hit.select(row).distinct(), row, f"left_{how}").select(*own)
    found = hit.select(row, span, F.struct("size", "lo", span).alias(best))
    if innermost:
        found = found.groupBy(row).agg(F.min_by(span, best).alias(span))
    return shown(points.join(found.select(row, span), row, how))
