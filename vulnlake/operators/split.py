"""Stratified splits into train, val and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folders with a split of their own, and the shares of train, val and test.
SPECIAL_FOLDERS = ["MULTI-CWE", "SAFE-NONCWE"]
SPECIAL_RATIO, RATIO = (0.6, 0.2, 0.2), (0.8, 0.1, 0.1)


def by_ratio(place: Column, total: Column, ratio: tuple[Column, Column, Column]) -> Column:
    """Split of the ``place``-th (from 0) of ``total`` rows: shares are floored; what is left goes to test, val, test, ..."""
    train, val, test = (F.floor(total * r + F.lit(1e-9)) for r in ratio)
    rest = total - train - val - test
    return F.when(place < train, "train").when(place < train + val + F.floor(rest / 2), "val").otherwise("test")


def stratified(documents: DataFrame, id_col: str = "id", folder: str = "cwe_folder", stratum: Column | None = None, seed: int = 42, keep: bool = True) -> DataFrame:
    """``documents`` with ``split`` assigned within (folder, stratum) in the order of a hash of id and seed.

    ``stratum`` is the label by default (whether vulnerabilities is empty); special folders are one stratum.
    With ``keep``, documents that already have a split keep it. Equal ids are told apart by their other columns' hash.
    """
    special = F.col(folder).isin(*SPECIAL_FOLDERS)
    label = stratum if stratum is not None else F.size("vulnerabilities") > 0
    old = F.col("split") if keep and "split" in documents.columns else F.lit(None).cast("string")
    rows = documents.withColumn("__s", F.when(special, F.lit(None)).otherwise(label)).withColumn("__old", old)
    others = [c for c in documents.columns if c not in (id_col, "split")]
    part = Window.partitionBy(folder, "__s", F.isnull("__old"))
    rows = rows.withColumn("__n", F.row_number().over(part.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col, F.xxhash64(*others))) - 1).withColumn("__t", F.count(F.lit(1)).over(part))
    ratio = tuple(F.when(special, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(SPECIAL_RATIO, RATIO, strict=True))
    return rows.select(*[c for c in documents.columns if c != "split"], F.coalesce("__old", by_ratio(F.col("__n"), F.col("__t"), ratio)).alias("split"))


def positional_label(file: str = "file", folder: str = "cwe_folder", share: float = 0.6) -> Column:
    """Whether a file is among the first ``share`` of its folder by name; for corpora that say so by position."""
    w = Window.partitionBy(folder)
    return F.row_number().over(w.orderBy(file)) <= F.floor(F.count(F.lit(1)).over(w) * share)


def routed(documents: DataFrame) -> dict[str, DataFrame]:
    """Documents by split; any other value is an error when the rows are read."""
    known = F.col("split").isin("train", "val", "test")
    checked = documents.withColumn("split", F.when(known, F.col("split")).otherwise(F.raise_error(F.format_string("unknown split %s", "split"))))
    return {s: checked.where(F.col("split") == s) for s in ("train", "val", "test")}


def write_version(documents: DataFrame, path: str, version: str) -> str:
    """Write documents with their new split as a version of its own, by split; what is there already is never rewritten."""
    out = f"{path}/version={version}"
    documents.write.mode("errorifexists").partitionBy("split").parquet(out)
    return out
