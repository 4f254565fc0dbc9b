"""Exact deduplication by content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names


def normalised(text: Column) -> Column:
    """Null as empty; every run of ASCII white space as one space.

    A single space is left alone by the pattern, so only other white space and longer runs are rewritten.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]" + r"[\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", hot_rows: int = 1000, hot_share: int = 10_000, salts: int = 64, with_text: bool = False, prefix: int = 64) -> DataFrame:
    """Mark each row with the smallest id that carries the same normalised text.

    Rows are range-partitioned with sampled splitters and sorted inside the partitions (spilling as needed), so
    equal texts are neighbours; the window compares neighbours in full and takes the first id of each run. The
    order is that of the first ``prefix`` characters, a hash, then the whole text: equal texts are equal in all of them, and
    what the driver samples for splitters stays small however long texts are. A text with more than
    max(``hot_rows``, rows / ``hot_share``) copies, found by a pre-aggregated count of hashes (at most ``hot_share`` such
    texts can exist, so that list may be broadcast), is first split by a salt on the id; the few runs
    it leaves are merged on the full text.

    Result: all columns of ``docs`` (the text itself only ``with_text``), plus keep_id, group_size, kept, text_sha256.
    Null text equals empty text. Rows that repeat an id and text count in group_size; of rows
    with the id that stays only one is kept. A null id sorts last, so it stays only in a group of null ids.
    An empty table gives an empty result; columns named like a result are replaced.
    """
    names = ("keep_id", "group_size", "kept", "text_sha256")
    rest = [c for c in docs.columns if c != text and c.lower() not in names]
    kept_rest = docs.select(*rest)
    own = free_names(kept_rest, *names, "text", "norm", "hash", "begin", "hot", "salt", "at", "least", "copies")
    raw, normal, hashed, begin, is_hot, salted, at, least, copies = own[4:]
    sha = own[3]
    rows = docs.select(*rest, F.col(text).alias(raw), normalised(F.col(text)).alias(normal))
    rows = rows.select(*rest, raw, normal, F.xxhash64(normal).alias(hashed), F.substring(normal, 1, prefix).alias(begin))
    if with_text:  # the normalised text travels beside the text where they differ
        rows = rows.withColumn(normal, F.when(F.col(raw).isNull() | (F.col(normal) != F.col(raw)), F.col(normal)))
    norm = F.coalesce(normal, raw) if with_text else F.col(normal)
    bodies = [raw, normal] if with_text else [normal]
    limit = max(hot_rows, docs.count() // hot_share)
    hot = rows.groupBy(hashed).count().where(F.col("count") > limit).select(hashed, F.lit(True).alias(is_hot))
    marked = rows.join(F.broadcast(hot), hashed, "left").withColumn(is_hot, F.coalesce(is_hot, F.lit(False)))
    salt = F.when(F.col(is_hot), F.pmod(F.xxhash64(id_col), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    keys = [begin, hashed, salted]
    dealt = marked.select(*rest, *bodies, is_hot, begin, hashed, salt.alias(salted)).repartitionByRange(*keys)
    run = Window.partitionBy(*keys, norm).orderBy(F.col(id_col).asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.select(
        *rest, *bodies, is_hot, F.sha2(norm, 256).alias(sha), F.first(id_col).over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"), F.row_number().over(run).alias(at),
    )
    # Salted runs of a hot text: one row for each text after pre-aggregation, hot_share of them at most.
    merged = (
        marked.where(is_hot).groupBy(norm.alias("whole")).agg(F.min(id_col).alias(least), F.count(F.lit(1)).alias(copies))
        .select(F.coalesce(F.sha2("whole", 256), F.lit("")).alias(sha), least, copies)
    )
    out = runs.join(F.broadcast(merged), sha, "left")
    keep, size = F.when(F.col(is_hot), F.col(least)).otherwise(F.col("keep_id")), F.coalesce(copies, "group_size")
    first = (F.col(at) == 1) & F.col(id_col).eqNullSafe(keep)
    return out.select(*rest, *[F.col(raw).alias(text)] * with_text, keep.alias("keep_id"), size.alias("group_size"), first.alias("kept"), sha)
