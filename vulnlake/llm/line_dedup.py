"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, free_names, shared_path, stage

_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENTRY = "h BINARY, n BIGINT, last BIGINT"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def digest(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


class LineIndex:
    """How many documents hold a line, and the largest of their ids, in levelled sorted runs in the folder ``path``.

    A run is a partition of one Parquet table bucketed and sorted by line hash, with one entry (h, n, last) for each hash of a batch.
    ``add`` merge-joins a batch's entries with the runs: what is settled there (enough documents, and one with a larger id than
    any of the batch) is left out by an anti join, the rest becomes a run of level 0. Once a level has ``fanout`` runs
    they are merged into one of the next level, so an entry is rewritten once a level. Runs have the same
    buckets, so neither joins nor merges shuffle them. Runs are never changed; a manifest names those that count,
    the newest whole one wins, and runs that a merge replaced are deleted one merge later. ``LineIndex.open`` continues in another session.

    Each document id must come in one batch only.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = 3, min_docs: int = 5, buckets: int | None = None):
        self.spark, self.path, self.fanout, self.min_docs = spark, path.rstrip("/"), fanout, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.version, self._stale = 0, []
        self._name = f"line_runs_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self._name} ({_ENTRY}, run STRING) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'"
        )

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The index that another session left in ``path``."""
        found = spark.read.schema("version bigint, body string").json(f"{path.rstrip('/')}/manifest/*")
        body = json.loads(found.orderBy(F.desc("version")).first().body)
        index = cls(spark, path, body["fanout"], body["min_docs"], body["buckets"])
        index.version, index.levels = body["version"], body["levels"]
        spark.catalog.recoverPartitions(index._name)
        return index

    def _commit(self) -> None:
        self.version += 1
        body = {"version": self.version, "fanout": self.fanout, "min_docs": self.min_docs, "buckets": self.buckets, "levels": self.levels}
        row = self.spark.createDataFrame([(self.version, json.dumps(body))], "version bigint, body string")
        row.coalesce(1).write.json(f"{self.path}/manifest/{self.version:09d}")

    def _write(self, entries: DataFrame) -> str:
        run = uuid.uuid4().hex
        rows = entries.repartition(self.buckets, "h").withColumn("run", F.lit(run))
        writer = rows.write.format("parquet").partitionBy("run").bucketBy(self.buckets, "h").sortBy("h").mode("append")
        writer.option("path", f"{self.path}/runs").option("compression", "zstd").saveAsTable(self._name)
        return run

    def _merged(self, runs: list[str]) -> DataFrame:
        # One scan: a union of bucketed scans loses rows' places in Spark 4.1.
        found = self.spark.table(self._name).where(F.col("run").isin(runs)).drop("run")
        return found.groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def entries(self) -> DataFrame:
        """One row for each line hash: h, n (documents), last (their largest id)."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else self.spark.createDataFrame([], _ENTRY)

    def add(self, holders: DataFrame) -> None:
        """Add a batch of (h, id) rows; repeated ones count once."""
        new = holders.groupBy("h", "id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        if any(self.levels):
            settled = self.entries().where(F.col("n") >= self.min_docs).select("h", F.col("last").alias("settled"))
            new = new.alias("b").join(settled.alias("s"), F.expr("b.h = s.h AND (b.last IS NULL OR s.settled > b.last)"), "left_anti")
        self.levels = self.levels or [[]]
        self.levels[0] = [*self.levels[0], self._write(new)]
        self.compact()
        self._commit()

    def compact(self) -> None:
        """Merge each level that is full into one run of the next."""
        for run in self._stale:
            self.spark.sql(f"ALTER TABLE {self._name} DROP IF EXISTS PARTITION (run = '{run}')")
            delete_path(self.spark, f"{self.path}/runs/run={run}")
        self._stale, level = [], 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self._stale += self.levels[level]
                self.levels[level + 1] = [*self.levels[level + 1], self._write(self._merged(self.levels[level]))]
                self.levels[level] = []
            level += 1

    def close(self) -> None:
        """Forget the table of this session; files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")


def _lines(docs: DataFrame, text: str, id_col: str, min_chars: int) -> DataFrame:
    """(id, mark of the row's text, at, h) of each line whose key is long enough; lines are numbered from 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest(body).alias("mark"), F.posexplode(F.split(body, "\n", -1)).alias("at", "line"))
    keyed = rows.select("id", "mark", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("id", "mark", "at", digest(F.col("key")).alias("h"))


def _repeated(lines: DataFrame, entries: DataFrame, min_docs: int, hot_share: int) -> DataFrame:
    """Of ``lines``, those that enough documents hold, less those of the largest id.

    A hash that more than one in ``hot_share`` of all counted (document, hash) pairs has is hot: at most ``hot_share`` hashes can be, so
    these are broadcast and their lines don't meet in one task.
    """
    total = entries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(min_docs, total // hot_share + 1)
    often = entries.where(F.col("n") >= min_docs).select("h", "last", (F.col("n") >= limit).alias("hot"))
    hot, cold = (often.where(c).select("h", "last", F.lit(True).alias("found")) for c in (F.col("hot"), ~F.col("hot")))
    marked = lines.join(F.broadcast(hot), "h", "left")
    rest = marked.where(F.col("found").isNull()).drop("last", "found").join(cold, "h")
    keys = ["id", "mark", "at", "last"]
    return marked.where("found").select(*keys).unionByName(rest.select(*keys)).where(~F.col("id").eqNullSafe(F.col("last"))).drop("last")


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, text: str = "text", id_col: str = "doc_id", min_docs: int = 5, min_chars: int = 40, batches: int = 4, hot_share: int = 10_000) -> DataFrame:
    """Drop the lines whose key at least ``min_docs`` documents hold, except in the document with the largest id among them.

    A text is split at each newline; a line's key is ``line_key``. Lines with keys under ``min_chars`` code points stay. Keys are
    compared by 128 bits of SHA-256. Without an ``index`` one is built in the shared folder from ``batches`` ranges of ids, from the
    largest ids down, so that what is settled early is not written again; with one, ``docs`` are added to it as a
    batch and judged by all it holds then, so an older holder of a line with a smaller id keeps what it was given.

    Result: all columns of ``docs``, plus n_lines (before), n_dropped and kept (the other lines joined by a newline); columns with these
    names are replaced. Null text is empty, and empty text is one empty line. Ids are integers; a null id is one more document, smaller than all. Rows that
    repeat an id are one document: their lines stay or go together. Texts of any length go line by line. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = index is None
    lines = _lines(docs, text, id_col, min_chars)
    if own:
        index = LineIndex(spark, shared_path(spark, "lines"), min_docs=min_docs)
        cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [1 - b / batches for b in range(1, batches)], 1000)).first()[0] or []
        batch = reduce(lambda a, c: a + F.when(F.coalesce(F.col("id") <= c, F.lit(True)), 1).otherwise(0), cuts, F.lit(0))
        path = shared_path(spark, "line-hashes")
        lines.withColumn("batch", batch).write.partitionBy("batch").option("compression", "zstd").parquet(path)
        lines = spark.read.schema("id bigint, mark binary, at int, h binary, batch int").parquet(path)
        for b in range(batches):
            index.add(lines.where(F.col("batch") == b).select("h", "id"))
        lines = lines.drop("batch")
    else:
        lines = stage(lines, "line-hashes")
        index.add(lines.select("h", "id"))
    gone = _repeated(lines, index.entries(), min_docs, hot_share).groupBy("id", "mark").agg(F.collect_set("at").alias("gone"))
    names = ("n_lines", "n_dropped", "kept")
    rest = [c for c in docs.columns if c not in names]
    key, mark, cut = free_names(docs, "id", "mark", "gone")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*rest, F.col(id_col).cast("long").alias(key), digest(body).alias(mark))
    gone = gone.select(F.col("id").alias("g_id"), F.col("mark").alias("g_mark"), F.col("gone").alias(cut))
    rows = rows.join(gone, F.col(key).eqNullSafe(F.col("g_id")) & (F.col(mark) == F.col("g_mark")), "left").select(*rest, cut)
    split = rows.select(*rest, cut, F.split(body, "\n", -1).alias(key))
    count = F.size(key)
    stays = F.array_except(F.sequence(F.lit(0), count - 1), F.col(cut))
    kept = F.when(F.col(cut).isNull(), body).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col(key), i)), "\n"))
    return split.select(*rest, count.cast("long").alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
