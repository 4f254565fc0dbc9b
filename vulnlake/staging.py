"""Steps written to the shared folder, so that lineage ends there, and column names that can't clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def free_names(taken: list[str], *names: str) -> list[str]:
    """Names like ``names`` that aren't ``taken``, whatever their case."""
    seen, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in seen:
            name = f"{name}_"
        seen.add(name.lower())
        out.append(name)
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; in a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folders.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _own_folders[spark.sparkContext.applicationId] = folder
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of ``path``."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own
