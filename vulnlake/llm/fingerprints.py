"""Bottom-k document fingerprints, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stage

#: Smallest 64-bit hash, where the uniform scale of hash values starts.
_LOW = -(2**63)


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """Hashes of all runs of ``words`` words; the whole sequence where there are fewer, nothing without a word."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        return (
            F.when(n >= words, F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)])))
            .when(n > 0, F.array(F.aggregate(h, F.lit(7).cast("long"), lambda acc, w: F.xxhash64(acc, w))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    # A let-binding: the word hashes are computed once and named by the lambda's variable.
    return F.get(F.transform(F.array(hashes), runs), F.lit(0))


def sketch(text: Column, k: int = 128, words: int = 5) -> Column:
    """The ``k`` smallest distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(rows: DataFrame, key: str, sketch_col: str = "sketch", k: int = 128) -> DataFrame:
    """(``key``, ``sketch_col``): the sketch of all parts of each group.

    Hashes are made distinct across the tasks and cut to each task's ``k`` smallest before a group meets, so a
    group of any size sends at most ``k`` hashes from each task. A null or empty sketch adds nothing; a group of such alone
    has an empty one. A null key is a group. An empty table gives an empty result; other columns are left out.
    """
    hashes = rows.select(F.col(key), F.explode(sketch_col).alias("__h")).distinct()
    order = Window.partitionBy(key).orderBy("__h")
    low = hashes.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias("__s"))
    every = rows.select(F.col(key).alias("__key")).distinct()
    found = every.join(low, F.col("__key").eqNullSafe(F.col(key)), "left")
    return found.select(F.col("__key").alias(key), F.coalesce("__s", F.array().cast("array<bigint>")).alias(sketch_col))


def distinct_count(s: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) / (k-th smallest on the unit scale)."""
    top = (F.element_at(s, -1).cast("double") - float(_LOW)) / float(2**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / F.greatest(top, F.lit(1e-300)))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard likeness: the share of the union's bottom ``k`` that both have. Two empty sketches: 1."""

    def ratio(x: Column) -> Column:
        low = F.slice(F.sort_array(F.array_union(x["a"], x["b"])), 1, k)
        return F.size(F.array_intersect(F.array_intersect(low, x["a"]), x["b"])) / F.size(low)

    both = F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), ratio), F.lit(0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has: resemblance times the union over ``a``."""
    union = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def encoded(s: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal, joined by commas."""
    return F.array_join(F.transform(s, lambda h: F.hex(h)), ",")


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key) for distinct keys, in ascending order; after the largest comes the smallest.

    Keys are cut into ranges by sampled splitters, however they are spread, and staged, so that the borders stay. A window inside each range
    gives the next key; the last of a range goes to the first of the next one, over one row for each range.
    """
    dealt = stage(ids.select(F.col(key).alias("k")).distinct().repartitionByRange("k").withColumn("part", F.spark_partition_id()), "keys")
    inner = dealt.withColumn("next", F.lead("k").over(Window.partitionBy("part").orderBy("k")))
    heads = dealt.groupBy("part").agg(F.min("k").alias("head"))
    order = Window.orderBy("part")
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), first).alias("link"))
    return inner.join(F.broadcast(heads), "part").select(F.col("k").alias(key), F.coalesce("next", "link").alias("next_key"))


def neighbour_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 128, words: int = 5) -> DataFrame:
    """Fingerprints of every document, of its edited text and of the next document.

    The edited text has the last quarter of its code points replaced by the first as many of the next
    document in ascending order of id. Texts are shuffled once, by id, with their sketch; the beginning
    of the next document comes back by a second, narrower exchange.

    Result: id, n_chars, edited_text, sketch, edited_sketch, next_sketch. Null text is empty. Rows that
    share an id each get a result; as a next document such an id stands for its smallest text. A null
    id comes before all others. A text of any length is one row and hashed whole. An empty table gives an empty
    result; other columns are left out, so their names can't clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("__k"), F.col(id_col), body.alias("__t"))
    rows = docs.withColumn("__s", sketch(F.col("__t"), k, words)).repartition("__k")
    after = successors(docs, "__k")
    need = F.floor(F.char_length("__t") / 4).cast("int")
    wanted = docs.groupBy("__k").agg(F.max(need).alias("__need")).join(after, "__k")
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy("__t", id_col))).where("__n = 1")
    heads = (
        one.select(F.col("__k").alias("next_key"), F.col("__t").alias("__nt"), F.col("__s").alias("next_sketch"))
        .join(wanted, "next_key").select("__k", F.expr("substring(__nt, 1, __need)").alias("__head"), "next_sketch")
    )
    n = F.char_length("__t")
    edited = F.concat(F.expr("substring(__t, 1, char_length(__t) - cast(floor(char_length(__t) / 4) as int))"), F.expr("substring(__head, 1, cast(floor(char_length(__t) / 4) as int))"))
    out = rows.join(heads, "__k").select(id_col, n.cast("long").alias("n_chars"), edited.alias("edited_text"), F.col("__s").alias("sketch"), "next_sketch")
    return out.withColumn("edited_sketch", sketch(F.col("edited_text"), k, words))
