"""Registered queries of the detection and evaluation operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import metrics, predictions, rules, split, structure_rules
from .operators.taint import closure
from .plans import jobs
from .query_sql import ORACLE_SQL  # noqa: F401  listed beside QUERIES
from .samples import SNIPPETS, TRUE_CWE, code_corpus
from .sources import corpus as C


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_corpus(spark, sf_dir).select("file", "code", T.detect_language(F.col("file")).alias("language"))


def _shown(findings: DataFrame) -> DataFrame:
    return findings.select("file", "ruleId", "cweId", "severity", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "evidence")


def weak_crypto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.match_patterns(_files(spark, sf_dir), [p for p in rules.PATTERNS if p.cwe == "CWE-327"]))


def command_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.match_patterns(_files(spark, sf_dir), [p for p in rules.PATTERNS if p.cwe == "CWE-78"]))


def out_of_bounds_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.match_patterns(_files(spark, sf_dir), rules.BOUNDS))


def sql_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.sql_injection(_files(spark, sf_dir), 0))


def path_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.path_traversal(_files(spark, sf_dir), 0))


def use_after_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.use_after_free(_files(spark, sf_dir), 0))


def integer_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.integer_overflow(_files(spark, sf_dir), 0))


def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ordered(rules.analyze(code_corpus(spark, sf_dir)))


def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ordered(structure_rules.analyze_structure(code_corpus(spark, sf_dir)))


def tainted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.text_taint(_files(spark, sf_dir).where("language in ('python', 'java')"))
    return rows.select("file", F.array_join("tainted", ",").alias("tainted"), F.array_join(F.array_sort("constants"), ",").alias("constants"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_corpus(spark, sf_dir)
    return rows.groupBy(T.detect_language(F.col("file")).alias("language"), T.display_language(F.col("file")).alias("shown")).agg(F.count(F.lit(1)).alias("files"))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.code_lines(_files(spark, sf_dir))
    return rows.where((F.col("line") != "") & ~F.col("line").rlike("^(//|#)")).select("file", F.col("i").cast("long").alias("i"), F.col("offset").cast("long").alias("offset"), "line")


def taint_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assignments: one file for each order date's day, names from keys; seeds are the urgent orders."""
    orders = _table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("v"), (F.col(c) % 40).cast("string"))
    rows = orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("file"), name("o_custkey").alias("src"), name("o_orderkey").alias("dst"), F.col("o_orderpriority").startswith("1").alias("seed"))
    files = rows.groupBy("file").agg(F.collect_set(F.when(F.col("seed"), F.col("src"))).alias("seeds"), F.collect_list(F.struct(F.array("src").alias("reads"), F.col("dst").alias("writes"))).alias("edges"))
    return files.select("file", F.explode(closure(F.col("seeds"), F.col("edges"))).alias("name"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic as truth, a rule hit on the text as prediction, the source as group."""
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.col("source").alias("cwe"), (F.col("toxic") == 1).alias("truth"), (F.char_length("text") > 1500).alias("found"), (F.col("quality") == 1).alias("other"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_truth(spark, sf_dir), "cwe", F.col("truth"), F.col("found"), total=True)


def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(metrics.confusion(_truth(spark, sf_dir), "cwe", F.col("truth"), F.col("found"))).select("cwe", "detection", "false_positive")


def compared_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _truth(spark, sf_dir)
    return metrics.compared(metrics.confusion(rows.where("found"), "cwe", F.col("truth"), F.col("found")), metrics.confusion(rows.where("other"), "cwe", F.col("truth"), F.col("other")))


def passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.passed(_truth(spark, sf_dir), "cwe", F.col("found"))


def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship modes as sets: the return flags and line statuses of an order against those of the next line number."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.concat("l_returnflag", "l_linestatus")))).alias("a"), F.sort_array(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", "l_linestatus")))).alias("b"))
    return items.select(F.col("l_orderkey").alias("id"), F.round(metrics.f1(F.col("a"), F.col("b")), 9).alias("f1"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.when(F.col("l_returnflag") == "R", "java").when(F.col("l_returnflag") == "A", "python").otherwise("c").alias("language"), (F.col("l_quantity") / 50).alias("reduced"), (F.col("l_linenumber") % 2).cast("double").alias("compiles"), (F.col("l_partkey") % 20).alias("added"))
    return rows.withColumn("fix", metrics.fix_score(F.col("language"), F.col("reduced"), F.col("compiles"), F.col("added")))


def fix_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("fix", 9).alias("fix"))


def score_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.means(_scores(spark, sf_dir), ["fix", "reduced"], "language")
    return rows.select("language", F.round("fix", 6).alias("fix"), F.round("reduced", 6).alias("reduced"), "samples")


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-crypto findings by rule over the corpus."""
    return weak_crypto(spark, sf_dir).groupBy("ruleId", "cweId").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("file").alias("files"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("kind") % 7 == 0, "MULTI-CWE").when(F.col("kind") % 7 == 1, "SAFE-NONCWE").otherwise(F.concat(F.lit("CWE-"), F.col("kind").cast("string")))
    return code_corpus(spark, sf_dir).select(F.col("file").alias("id"), folder.alias("cwe_folder"), F.when(F.floor(F.col("part_key") / len(SNIPPETS)) % 3 == 0, F.array(F.lit("v"))).otherwise(F.array().cast("array<string>")).alias("vulnerabilities"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified(_documents(spark, sf_dir)).groupBy("cwe_folder", "split").agg(F.count(F.lit(1)).alias("documents"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified(_documents(spark, sf_dir)).select("id", "cwe_folder", "split")


def missing_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents whose path names a part's file: those that name none."""
    docs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/src/part-"), (F.col("s_suppkey") * 7).cast("string"), F.lit(".py")).alias("path"))
    return C.without_code(docs, code_corpus(spark, sf_dir)).select("id", "path")


_FIXES = '[{"origin":"hashlib.md5","replacement":"hashlib.sha256"},{"origin":"hashlib.sha1(x)","replacement":"b\'\'"},{"origin":"os.system(name)","replacement":"hashlib.md5(name)"}]'


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its true CWEs and a model's answer: none, no JSON, an empty one, or three fixes and a malformed item."""
    rows = code_corpus(spark, sf_dir)
    truth = F.element_at(F.create_map(*[F.lit(x) for kv in TRUE_CWE.items() for x in kv]), F.col("kind"))
    fixed = F.concat(F.lit('Answer: {"vulnerabilities":[{"cwe":"'), F.coalesce(truth, F.lit("CWE-22")), F.lit(f'","fixes":{_FIXES}}},{{"cwe":7}}]}}'))
    turn = F.col("part_key") % 5
    answer = F.when(turn == 0, "no json here").when(turn == 1, '{"vulnerabilities":[]}').when(turn > 2, fixed)
    cwes = F.when(truth.isNull(), F.array().cast("array<string>")).otherwise(F.array(truth))
    language = F.when(F.col("file").endswith(".c"), "c").otherwise(T.detect_language(F.col("file")))
    return rows.select(F.col("file").alias("id"), "file", "code", language.alias("language"), cwes.alias("cwes"), answer.alias("raw"))


def patched_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("v", predictions.parse(F.coalesce("raw", F.lit(""))))
    return rows.select("id", F.array_join(predictions.predicted_cwes(F.col("v")), ",").alias("predicted"), predictions.apply_fixes(F.col("code"), predictions.fixes_for(F.col("v"), F.col("cwes"))).alias("patched"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    out = jobs.evaluate(rows.drop("raw"), rows.where("raw is not null").select("id", "raw"))
    scores = [F.round(c, 9).alias(c) for c in ("cwe_score", "reduction", "compiles", "fix_score", "final_score")]
    return out.select("id", "language", F.array_join("cwes", ",").alias("cwes"), F.array_join("predicted", ",").alias("predicted"), *scores, F.col("introduced").cast("long").alias("introduced"))


def analyzer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_corpus(spark, sf_dir)
    return jobs.compare(rows.select("file", "code", F.concat(F.lit("kind-"), F.col("kind").cast("string")).alias("cwe_folder"), (F.col("kind") < len(SNIPPETS) - 1).alias("vulnerable")))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents for every file, one in a folder of each analyzer."""
    rows = code_corpus(spark, sf_dir)
    docs = rows.select(F.lit("1.0").alias("schema_version"), F.col("file").alias("id"), F.concat(F.lit("/"), F.col("file")).alias("path"), F.explode(F.array(F.lit("CWE-22"), F.lit("SAFE-NONCWE"))).alias("cwe_folder"))
    return jobs.enrich(docs, rows.select("file", "code")).select("id", "cwe_folder", F.size("static_findings").cast("long").alias("findings"))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diagnostics(rules.match_patterns(_files(spark, sf_dir), rules.PATTERNS + rules.BOUNDS))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_corpus(spark, sf_dir)
    return rows.select("file", predictions.fill("Review {file}:\n{code}\n", file=F.col("file"), code=F.col("code")).alias("prompt"))


def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as epochs with the mean order price as score; marks those above all before."""
    rows = _table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("epoch")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"))
    return metrics.new_best(rows, "score", "epoch")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, as the latest text of each path."""
    from .streaming.watch import latest

    return latest(_table(spark, sf_dir, "events"), "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(rules.match_patterns(_files(spark, sf_dir), rules.CREDENTIALS))


def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_corpus(spark, sf_dir)
    truth = F.element_at(F.create_map(*[F.lit(x) for kv in TRUE_CWE.items() for x in kv]), F.col("kind"))
    return jobs.sample_report(rows.select("file", "code", F.coalesce(truth, F.lit("SAFE-NONCWE")).alias("cwe_folder")))


def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of the first half of each year by month, and of all; an item of an array counts each."""
    items = _scores(spark, sf_dir)
    month = F.date_format("l_shipdate", "yyyy-MM")
    return metrics.report(items.select(F.array(F.lit("all"), F.when(F.month("l_shipdate") <= 6, month)).alias("months"), "fix", "reduced"), ["fix", "reduced"], "months", 6)


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents whose path names a part's file; every tenth can't be parsed."""
    path = F.concat(F.lit("/src/part-"), (F.col("s_suppkey") * 3).cast("string"), F.lit(".py"))
    docs = _table(spark, sf_dir, "supplier").select(path.alias("path"), F.when(F.col("s_suppkey") % 10 == 0, "{").alias("_corrupt_record"))
    return jobs.run_counters(docs, code_corpus(spark, sf_dir))


QUERIES = {f"ref_{f.__name__}": f for f in (
    weak_crypto, command_injection, out_of_bounds_write, sql_injection, path_traversal, use_after_free, integer_overflow, text_findings, structure_findings, tainted_names, languages, code_lines, taint_closure,
    confusion, detection_rates, compared_analyzers, passed, set_f1, fix_scores, score_means, finding_counts, split_counts, split_documents, missing_code, patched_code, evaluation, analyzer_comparison, enriched, diagnostics, prompts, best_epochs, latest_events, credentials, sample_report, group_report, run_counters,
)}
