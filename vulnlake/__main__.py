"""Command line: python -m vulnlake scan|enrich|compare ..., on the session that spark-submit or the environment sets up."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.rules import analyze
from .operators.structure_rules import analyze_structure
from .plans import jobs
from .sources import corpus as C


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vulnlake")
    parser.add_argument("job", choices=["scan", "enrich", "compare"])
    parser.add_argument("sources", help="folder of source files")
    parser.add_argument("out", help="folder to write to")
    parser.add_argument("--metadata", help="folder of metadata documents, for enrich and compare")
    parser.add_argument("--folders", nargs="*", help="CWE folders to take; all without it")
    parser.add_argument("--structure", action="store_true", help="scan with the structure rules")
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("vulnlake").getOrCreate()
    sources = C.all_sources(spark, options.sources)
    if options.job == "scan":
        C.findings_json((analyze_structure if options.structure else analyze)(sources)).write.mode("overwrite").json(options.out)
        return
    if not options.metadata:
        parser.error(f"{options.job} needs --metadata")
    metadata = C.in_folders(C.read_metadata(spark, options.metadata), options.folders)
    documents = C.parsed(metadata)
    if options.job == "enrich":
        C.write_documents(jobs.enrich(documents, sources), options.out, "json")
        print(*(f"{name}: {n}" for name, n in jobs.run_counters(metadata, sources).first().asDict().items()), sep=", ")
    else:
        rows = C.with_code(documents, sources)
        corpus = rows.select(F.col("path").alias("file"), "code", "cwe_folder", (F.size("vulnerabilities") > 0).alias("vulnerable"))
        jobs.compare(corpus).write.mode("overwrite").json(options.out)


if __name__ == "__main__":
    main()
