"""Whole jobs over corpora."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import metrics, predictions
from ..operators.rules import analyze
from ..operators.structure_rules import analyze_structure
from ..sources.corpus import gathered, relative, with_code
from ..schemas import FINDING_STRUCT

#: Folders whose files go to the structure rules; all others go to the text rules.
STRUCTURE_FOLDERS = ["CWE-22", "CWE-78", "CWE-89", "CWE-190", "CWE-259", "CWE-321", "CWE-327", "CWE-328", "CWE-416", "CWE-787", "MULTI-CWE"]


def _by_structure(folder: Column) -> Column:
    return F.coalesce(folder.isin(*STRUCTURE_FOLDERS), F.lit(False))


def route(corpus: DataFrame) -> DataFrame:
    """Findings of each file by the analyzer of its cwe_folder. ``corpus``: file, code, cwe_folder."""
    strong = _by_structure(F.col("cwe_folder"))
    return analyze_structure(corpus.where(strong)).unionByName(analyze(corpus.where(~strong)))


def enrich(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Parsed metadata documents with static_findings and enriched_at; documents without code are left out.

    Each document gets the findings of the analyzer of its own folder. Paths that several documents share are
    analyzed once by each analyzer that they need.
    """
    rows = with_code(documents, sources).drop("static_findings", "enriched_at").withColumn("__strong", _by_structure(F.col("cwe_folder")))
    files = rows.select(F.col("path").alias("file"), "code", "__strong").dropDuplicates(["file", "__strong"])
    sides = [gathered(run(files.where(F.col("__strong") == strong).select("file", "code"))).withColumn("__by", F.lit(strong)) for run, strong in ((analyze_structure, True), (analyze, False))]
    found = sides[0].unionByName(sides[1])
    joined = rows.join(found, (rows["path"] == found["file"]) & (rows["__strong"] == found["__by"]), "left").drop("file", "code", "__strong", "__by")
    return joined.withColumn("static_findings", F.coalesce("static_findings", F.array().cast(f"array<{FINDING_STRUCT}>"))).withColumn("enriched_at", F.current_timestamp())


def run_counters(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """One row (processed, skipped, errors) for metadata as it is read: with code, without code, not parsed."""
    known = sources.select(F.col("file").alias("__f")).distinct()
    rows = documents.join(known, relative(F.col("path")) == F.col("__f"), "left")
    bad, has = F.col("_corrupt_record").isNotNull(), F.col("__f").isNotNull()
    return rows.agg(F.count_if(~bad & has).alias("processed"), F.count_if(~bad & ~has).alias("skipped"), F.count_if(bad).alias("errors"))


def enrich_observed(documents: DataFrame, sources: DataFrame, path: str) -> dict[str, int]:
    """Enrich metadata as it is read and write it below ``path`` by folder; returns processed, skipped and errors, counted by the write itself.

    Documents without code and those that can't be parsed go along up to an observation in front of the files, and no further.
    """
    seen = Observation()
    known = sources.select(F.col("file").alias("__f"))
    bad = F.col("_corrupt_record").isNotNull()
    lost = documents.where(~bad).join(known, relative(F.col("path")) == F.col("__f"), "left_anti").withColumn("__kind", F.lit("skipped"))
    rest = documents.where(bad).withColumn("__kind", F.lit("errors")).unionByName(lost).drop("_corrupt_record", "static_findings", "enriched_at")
    done = enrich(documents.where(~bad).drop("_corrupt_record"), sources).withColumn("__kind", F.lit("processed"))
    counts = [F.count_if(F.col("__kind") == k).alias(k) for k in ("processed", "skipped", "errors")]
    rows = done.unionByName(rest, allowMissingColumns=True).observe(seen, *counts)
    rows.where("__kind = 'processed'").drop("__kind").write.mode("overwrite").partitionBy("cwe_folder").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def sample_report(corpus: DataFrame) -> DataFrame:
    """(file, cwe, hit, tags) for samples whose folder names the CWE that is to be found. ``corpus``: file, code, cwe_folder."""
    found = gathered(analyze(corpus))
    rows = corpus.select("file", F.col("cwe_folder").alias("cwe")).join(found, "file", "left")
    hit = F.coalesce(F.exists("static_findings", lambda f: f["cweId"] == F.col("cwe")), F.lit(False))
    return rows.select("file", "cwe", hit.alias("hit"), metrics.tags(F.col("static_findings")).alias("tags"))


def write_results(results: DataFrame, config: dict[str, object], path: str) -> None:
    """Results of a test and the configuration that led to them, as JSON below ``path``."""
    results.write.mode("overwrite").json(f"{path}/test_results")
    text = json.dumps(config, indent=4, sort_keys=True)
    results.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/training_config")


def compare(corpus: DataFrame, truth: str = "vulnerable", folder: str = "cwe_folder") -> DataFrame:
    """Confusion counts of the text rules and of the structure rules by folder. ``corpus``: file, code, folder, truth."""
    sides = []
    for run in (analyze, analyze_structure):
        hit = run(corpus.select("file", "code")).select("file").distinct().withColumn("found", F.lit(True))
        rows = corpus.select("file", F.col(folder).alias("cwe"), truth).join(hit, "file", "left")
        sides.append(metrics.confusion(rows, "cwe", F.col(truth), F.coalesce("found", F.lit(False))))
    return metrics.compared(*sides)


def evaluate(samples: DataFrame, answers: DataFrame, analyzer: Callable[[DataFrame], DataFrame] = analyze_structure, after: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scores of model answers. ``samples``: id, file, code, language, cwes; ``answers``: id, raw.

    Both sides of the reduction come from the same analyzer unless ``after`` names another. Result: id,
    language, cwes, predicted, patched, cwe_score, reduction, introduced, compiles, fix_score, final_score.
    Where compiling can't be tried (C), its term counts 0.
    """
    rows = samples.join(answers, "id", "left").withColumn("__v", predictions.parse(F.coalesce("raw", F.lit(""))))
    rows = rows.withColumn("predicted", predictions.predicted_cwes(F.col("__v"))).withColumn("patched", predictions.apply_fixes(F.col("code"), predictions.fixes_for(F.col("__v"), F.col("cwes"))))
    none = F.array().cast(f"array<{FINDING_STRUCT}>")

    def found(run, code: str, name: str) -> DataFrame:
        return gathered(run(rows.select(F.concat_ws("/", F.col("id"), F.col("file")).alias("file"), F.col(code).alias("code")))).select(F.col("file").alias("__key"), F.col("static_findings").alias(name))

    rows = rows.withColumn("__key", F.concat_ws("/", "id", "file"))
    rows = rows.join(found(analyzer, "code", "__old"), "__key", "left").join(found(after or analyzer, "patched", "__new"), "__key", "left")
    old, new = F.coalesce("__old", none), F.coalesce("__new", none)
    rows = rows.withColumn("cwe_score", metrics.f1(F.col("cwes"), F.col("predicted"))).withColumn("reduction", metrics.reduction(old, new, F.col("cwes"))["score"]).withColumn("introduced", metrics.introduced(old, new))
    rows = rows.withColumn("compiles", predictions.compiles(F.col("patched"), F.col("language")))
    rows = rows.withColumn("fix_score", metrics.fix_score(F.col("language"), F.col("reduction"), F.coalesce("compiles", F.lit(0.0)), F.col("introduced")))
    rows = rows.withColumn("final_score", metrics.final_score(F.col("cwes"), F.col("predicted"), F.col("cwe_score"), F.col("fix_score")))
    return rows.select("id", "language", "cwes", "predicted", "patched", "cwe_score", "reduction", "introduced", "compiles", "fix_score", "final_score")
