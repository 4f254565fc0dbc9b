"""Readers of source trees, metadata and enriched documents; writers of findings and enriched documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_language
from ..schemas import ENRICHED, FINDING_NAMES, METADATA

MAX_CHARS = 1_000_000


def relative(path: Column, root: str | None = None) -> Column:
    """A path below ``root``: one leading slash goes."""
    if root:
        path = F.regexp_replace(path, F.lit("^.*" + "".join(f"\\{c}" if not c.isalnum() else c for c in root.rstrip("/")) + "/"), F.lit(""))
    return F.regexp_replace(path, F.lit("^/"), F.lit(""))


def folder_of(path: Column) -> Column:
    """The CWE folder of a metadata path: its first component."""
    return F.element_at(F.split(relative(path), "/"), 1)


def read_sources(spark: SparkSession, root: str, suffixes: str = "{c,cpp,cc,cxx,h,hpp,java,py}", max_chars: int | None = MAX_CHARS) -> DataFrame:
    """(file, code, language) of source files below ``root``, whole; larger files than ``max_chars`` are left out: see all_sources."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffixes}").text(root, wholetext=True)
    rows = rows.select(relative(F.col("_metadata.file_path"), root).alias("file"), F.col("value").alias("code"))
    rows = rows.withColumn("language", detect_language(F.col("file")))
    return rows if max_chars is None else rows.where(F.char_length("code") <= max_chars)


def all_sources(spark: SparkSession, root: str) -> DataFrame:
    """(file, code, language) of all source files below ``root``, of any size, as batch jobs need them."""
    return read_sources(spark, root, max_chars=None)


def _read_json(spark: SparkSession, root: str, schema: str) -> DataFrame:
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE")
    return reader.json(root).withColumn("document", relative(F.col("_metadata.file_path"), root)).withColumn("cwe_folder", folder_of(F.col("document")))


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata documents, with document (path below ``root``), cwe_folder, and _corrupt_record where one can't be parsed."""
    return _read_json(spark, root, METADATA)


def read_enriched(spark: SparkSession, root: str) -> DataFrame:
    return _read_json(spark, root, ENRICHED)


def parsed(documents: DataFrame) -> DataFrame:
    return documents.where("_corrupt_record is null").drop("_corrupt_record")


def in_folders(documents: DataFrame, folders: list[str] | None) -> DataFrame:
    """Documents of these CWE folders; all without a list. On a corpus partitioned by cwe_folder this prunes."""
    return documents.where(F.col("cwe_folder").isin(*folders)) if folders else documents


def of_listed_folders(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents of the CWE folders in a table with column cwe_folder; on a corpus partitioned by it Spark reads those partitions alone, found at run time."""
    return documents.join(folders.select("cwe_folder").distinct(), "cwe_folder", "left_semi")


def with_code(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the code their path names."""
    return documents.join(sources.select(F.col("file").alias("__f"), "code"), relative(F.col("path")) == F.col("__f")).drop("__f")


def without_code(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents whose path names no source."""
    return documents.join(sources.select(F.col("file").alias("__f")), relative(F.col("path")) == F.col("__f"), "left_anti")


def finding_struct() -> Column:
    return F.struct(*FINDING_NAMES)


def gathered(findings: DataFrame, key: str = "file") -> DataFrame:
    """(key, static_findings): findings of each file as an array in report order."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    ordered = F.struct(rank.alias("a"), F.col("line").alias("b"), F.col("column").alias("c"), F.col("rule_order").alias("d"), F.col("match_order").alias("e"), finding_struct().alias("f"))
    return findings.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(ordered)), lambda x: x["f"]).alias("static_findings"))


def findings_json(findings: DataFrame) -> DataFrame:
    """(file, json): one JSON array of findings for each file."""
    return gathered(findings).select("file", F.to_json("static_findings").alias("json"))


def write_documents(documents: DataFrame, path: str, form: str = "parquet") -> None:
    """Write documents partitioned by CWE folder."""
    documents.write.mode("overwrite").partitionBy("cwe_folder").format(form).save(path)


def diagnostics(findings: DataFrame) -> DataFrame:
    """Editor diagnostics: 0-based range, severity, source and code of each finding."""
    severity = F.when(F.col("severity") == "high", "Error").when(F.col("severity") == "medium", "Warning").otherwise("Information")
    start = F.greatest(F.lit(0), F.col("column") - 1)
    return findings.select(
        "file", F.greatest(F.lit(0), F.col("line") - 1).alias("line"), start.alias("start"), (start + F.greatest(F.lit(1), F.char_length("evidence"))).alias("end"),
        "message", severity.alias("severity"), F.lit("vulnlake").alias("source"), F.col("ruleId").alias("code"),
    )


def log_lines(findings: DataFrame) -> DataFrame:
    return findings.select("file", F.format_string("[%s] %s %s at %s:%d:%d - %s", F.upper("severity"), "cweId", "ruleId", "file", "line", "column", "message").alias("entry"))
