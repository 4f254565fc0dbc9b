"""Saved files as a stream: analyze each, keep the latest findings and the latest text of every path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import detect_language
from ..operators.rules import analyze
from ..sources.corpus import MAX_CHARS, gathered, relative
from ..sources.versions import FileTable
from ..staging import stage


def saved_files(spark: SparkSession, root: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """A stream of (file, code, language, saved_at) of source files that appear or change below ``root``."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,cpp,cc,cxx,h,hpp,java,py}").load(root)
    rows = rows.select(relative(F.col("_metadata.file_path"), root).alias("file"), F.col("value").alias("code"), F.col("_metadata.file_modification_time").alias("saved_at"))
    return rows.where(F.char_length("code") <= max_chars).withColumn("language", detect_language(F.col("file")))


def latest(rows: DataFrame, key: str = "file", order: tuple[str, ...] = ("saved_at",)) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def watch(stream: DataFrame, path: str, checkpoint: str, analyzer: Callable[[DataFrame], DataFrame] = analyze) -> StreamingQuery:
    """Write (file, saved_at, code, static_findings) of each save to one folder for each batch of ``path``.

    A batch that runs again overwrites its own folder, so results are exactly once; ``current`` reads
    the latest row of each file. Stop and start the query to pause and resume; the checkpoint remembers.
    """

    def batch(rows: DataFrame, number: int) -> None:
        own = latest(rows)
        found = gathered(analyzer(own.select("file", "code")))
        own.join(found, "file", "left").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_table(stream: DataFrame, table: FileTable, checkpoint: str, analyzer: Callable[[DataFrame], DataFrame] = analyze, name: str = "watch") -> StreamingQuery:
    """Put (file, saved_at, code, static_findings) of each save in place of what ``table`` holds of the file.

    A save that is older than what the table holds changes nothing. A batch that runs again finds its number in the table's manifest and does nothing, so results are exactly
    once; readers see whole versions, and ``table.vacuum`` deletes old ones.
    """

    def batch(rows: DataFrame, number: int) -> None:
        own, held = latest(rows), table.read()
        if held is not None:
            newer = held.select(F.col("file").alias("f"), F.col("saved_at").alias("held_at"))
            own = own.join(newer, F.col("file") == F.col("f"), "left_anti").unionByName(own.join(newer, (F.col("file") == F.col("f")) & (F.col("saved_at") >= F.col("held_at")), "left_semi"))
        own = stage(own, "saves")
        found = gathered(analyzer(own.select("file", "code")))
        none = F.array().cast(dict(found.dtypes)["static_findings"])
        rows = own.join(found, "file", "left").select("file", "saved_at", "code", F.coalesce("static_findings", none).alias("static_findings"))
        table.replace(rows, stream=name, batch=number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest findings and text of every file, by path; filter by file for one of them."""
    return latest(spark.read.parquet(path), order=("saved_at", "batch"))
