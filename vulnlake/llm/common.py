"""What the operators share: reading tables, the shared folder, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ragged import PRIME

#: ASCII white space and its complement, as every word rule here defines them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def secret(spark: SparkSession) -> bytes:
    """32 bytes for keyed hashes, from the setting spark.vulnlake.secret. Without it they are the same for everyone, which is enough for texts nobody made to collide."""
    return hashlib.blake2b(spark.conf.get("spark.vulnlake.secret", "").encode(), digest_size=32).digest()


def hash_base(spark: SparkSession) -> int:
    """The base of polynomial hashes that goes with ``secret``."""
    return 2 + int.from_bytes(secret(spark)[:8], "little") % (PRIME - 3)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_folders[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` plus, for each name in ``sums``, the sum of that column over all rows before, in the order of ``order``.

    Rows are cut into ranges, which are staged so that their borders stay; sums run inside each range, and over one row for each range for those before it.
    """
    (part,) = free_names(rows, "part")
    dealt = stage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = free_names(dealt, *(f"before_{n}" for n in sums))
    totals = dealt.groupBy(part).agg(*(F.sum(c).alias(n) for n, c in zip(names, sums.values(), strict=True)))
    totals = totals.select(part, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names))
    out = dealt.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items())).join(F.broadcast(totals), part)
    return out.select(*rows.columns, *((F.col(n) + F.col(b)).alias(n) for n, b in zip(sums, names, strict=True)))


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A staged ``df`` of narrow rows to be broadcast if it has at most ``most`` of them; else as it is, for Spark to choose a join that shuffles and splits hot keys."""
    return F.broadcast(df) if df.count() <= most else df


def path_exists(spark: SparkSession, path: str) -> bool:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def delete_path(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files behind staged frames that no later step reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, folder)


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component among these edges."""
    nodes, of = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = of[: len(u)], of[len(u) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(top, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (top[top] != top).any():
            top = top[top]
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[below], nodes[top[below]]


def _contract(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Edges of a task, up to ``most`` at a time, as stars: what a task can join by itself needs no round of joins."""
    held, size = [], 0

    def star() -> pa.RecordBatch:
        u, v = contracted(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGE)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield star()
            held, size = [], 0
    if held:
        yield star()


def _tally(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.max("u").alias("m")).first()
    return row.n, row.x, row.m


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge list, as (node, component) with the smallest node as name.

    Alternates large-star and small-star steps until the edges stop changing; before each round the tasks contract the edges that they
    read to stars, so that few rounds are left. A round is two aggregations and two joins on nodes, so hubs are pre-aggregated and a
    skewed node can be split.
    Nodes without an edge don't occur in the result. Self-loops and repeated edges are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = stage(e, "edges")
    seen = _tally(e)
    while seen[0]:
        stars = e.mapInArrow(_contract, "u bigint, v bigint")
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _tally(after)
        drop_staged(e)
        e = after
        if now == seen:
            break
        seen = now
    if not seen[0]:
        return spark.createDataFrame([], "node bigint, component bigint")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
