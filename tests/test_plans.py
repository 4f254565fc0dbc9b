"""Plans that hold at size: what may be broadcast, how rows are dealt, how often expressions run."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from vulnlake import samples
from vulnlake.functions import text as T
from vulnlake.operators import facts, rules, structure_rules
from vulnlake.operators.joins import containing


def test_containing_broadcasts_no_points(spark, tmp_path):
    # In a file the points are small, repeated for each width they aren't; the driver would have to hold them all.
    spark.range(2000).selectExpr("id % 7 AS k", "id AS t").write.parquet(f"{tmp_path}/points")
    spark.range(2000).selectExpr("id % 7 AS k", "id AS lo", "id + pow(2, id % 12) AS hi", "id AS s").write.parquet(f"{tmp_path}/spans")
    points, spans = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/spans")
    for options in ({}, {"how": "left", "innermost": True}, {"how": "semi"}):
        out = containing(points, spans, ["k"], "t", "lo", "hi", **options)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Broadcast\w+ \[\w+#\d+L?, width#", plan) and "SortMergeJoin [k#" in plan, options
    assert out.count() == 2000


def test_files_are_dealt_by_their_number(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    corpus = samples.code_corpus(spark, str(tmp_path))
    sizes = [n for n, in corpus.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 5000 and len(sizes) >= 3 and max(sizes) < 2 * samples.FILES_A_TASK
    assert corpus.select("file").distinct().count() == 5000


def test_sorting_runs_the_rules_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def line(i):
        seen.add(1)
        return i

    rows = spark.range(3000, numPartitions=3).select(*[F.lit("high" if c == "severity" else "a").alias(c) for c in ("cweId", "ruleId", "vulnerability", "severity", "message", "file", "evidence")], line(F.col("id").cast("int")).alias("line"), F.lit(1).alias("column"))
    out = rules.ordered(rows).select("line").collect()
    assert [r[0] for r in out] == list(range(3000)) and seen.value == 3000


def test_facts_of_a_batch():
    kind = to_arrow_type(StructType.fromDDL(facts.SCHEMA))
    texts = [t.replace("{k}", str(i)) for i, (_, t) in enumerate(samples.SNIPPETS)] + ["", None]
    languages = [{".py": "python", ".java": "java", ".c": "c"}.get(s, "none") for s, _ in samples.SNIPPETS] + ["c", "c"]
    found = facts._facts(pa.array(texts), pa.array(languages), kind, at_once=5)
    assert found.type == kind and len(found) == len(texts) and facts._facts(pa.array([], pa.string()), pa.array([], pa.string()), kind).type == kind
    for text, language, row in zip(texts, languages, found.to_pylist(), strict=True):
        want = facts._placed(facts.extract(text, language), text) if text and language != "none" else [[]] * 9
        assert [row[c] for c in facts._FIELDS] == want


def test_rules_run_behind_the_deal(spark):
    corpus = spark.createDataFrame([("a.py", "cur.execute('select ' + x)\n"), ("b.py", "x = 1\n")], "file string, code string").repartition(3, "file")
    plan = rules.analyze(corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_extract_all(code" in x]
    assert [(r.ruleId, r.file, r.line) for r in rules.analyze(corpus).collect()] == [("python-sqli-inline", "a.py", 1)]


def test_texts_without_a_match_are_looked_at_once(spark):
    rows = spark.createDataFrame([("a system(x)",), ("nothing",), (None,)], "t string")
    found = rows.select(T.matches(F.col("t"), r"\bsystem\s*\(").alias("m"))
    assert [r.m and [x.at for x in r.m] for r in found.collect()] == [[2], [], None]
    assert "CASE WHEN RLIKE(t" in found._jdf.queryExecution().optimizedPlan().toString()


def test_cheap_borders_mean_the_same():
    words, rng = "os system foo é _x 7 . ( ) = ; \n \r + ab a b c select".split(" "), random.Random(5)
    texts = ["".join(rng.choice(words) for _ in range(60)) for _ in range(80)]
    patterns = [p.regex for p in rules.PATTERNS + rules.BOUNDS + rules.CREDENTIALS] + [*rules.USER_INPUT.values(), *structure_rules.SOURCES.values(), rules.RISKY_LINE, rules.SQL_VERBS]
    patterns += [r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*=", r"\b[a-zA-Z_]\w*\.", r"\b(a|b)?c", r"\ba?\.", r"\b(a|)\.", r"\b([a-zA-Z_])?\.", r"\b([a-zA-Z_]|\.)", r"\b(?:ab|b(a)|c)", r"b\b", r"\b(os|foo)\.", r"(?i)\bSYSTEM\("]
    for p in patterns:
        old, new = re.compile(p.replace(r"\b", T._BORDER), re.ASCII), re.compile(T.ascii_borders(p), re.ASCII)
        for t in texts:
            assert [(m.span(), m.groups()) for m in old.finditer(t)] == [(m.span(), m.groups()) for m in new.finditer(t)], p
    assert T._BORDER not in T.ascii_borders(r"\bsystem\(") + T.ascii_borders(r"\b(md5|sha1)\(") and T._BORDER in T.ascii_borders(r"\ba?\.")
