"""Whole jobs, long files, the command line, and what a user can add."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from vulnlake.__main__ import main
from vulnlake.functions import text as T
from vulnlake.operators import metrics, rules, split, structure_rules
from vulnlake.operators.taint import closure
from vulnlake.plans import jobs
from vulnlake.sources import corpus as C


def hits(rows):
    return sorted((r.file, r.ruleId, r.line, r.column) for r in rows.collect())


def test_shared_path_keeps_its_analyzers_apart(spark):
    code = "import hashlib\nhashlib.md5(x)\n"
    docs = spark.createDataFrame([("a", "/a.py", "CWE-327"), ("b", "/a.py", "SAFE-NONCWE"), ("c", "/a.py", "CWE-22"), ("d", "/none.py", "CWE-22"), ("e", "/a.py", None)], "id string, path string, cwe_folder string")
    got = {r.id: [f.ruleId for f in r.static_findings] for r in jobs.enrich(docs, spark.createDataFrame([("a.py", code)], "file string, code string")).collect()}
    assert got == {"a": ["ast-weak-hash"] * 2, "c": ["ast-weak-hash"] * 2, "b": ["python-md5"], "e": ["python-md5"]}


def test_long_file(spark):
    """30,000 lines: places are right, and the time stays in proportion."""
    n = 30_000
    lines = ["  x = 1;"] * n
    lines[5], lines[n - 10], lines[n - 5], lines[n - 3], lines[n - 2] = "  free(p);", "  strcpy(a, b);", "  g(p);", "  if (k < 9 && m < 9) {", "  int t = k + m;"
    lines[n - 1] = "  int u = z + 1 + w;"
    files = spark.createDataFrame([("a.c", "\n".join(lines))], "file string, code string").cache()
    files.count()
    began = time.time()
    assert hits(rules.analyze(files)) == [("a.c", "integer-overflow", n, 3), ("a.c", "out-of-bounds-write", n - 9, 3), ("a.c", "use-after-free", n - 4, 5)]
    assert time.time() - began < 120
    python = ["y = 1"] * n
    python[3], python[n - 1] = "name = input()", "  open(name)"
    assert hits(rules.path_traversal(spark.createDataFrame([("b.py", "\n".join(python), "python")], "file string, code string, language string"), 0)) == [("b.py", "path-traversal", n, 3)]


def test_lines_have_their_places(spark):
    rng = random.Random(1)
    codes = ["", "\n", "é\n😀x\r\n\n", "\n".join("x" * rng.randint(0, 9) for _ in range(1500)), None]
    rows = rules.code_lines(spark.createDataFrame([(i, c, "x") for i, c in enumerate(codes)], "file int, code string, language string")).collect()
    for n, code in enumerate(codes):
        own = sorted((r for r in rows if r.file == n), key=lambda r: r.i)
        parts = [] if code is None else code.split("\n")
        assert [(r.raw, r.line) for r in own] == [(p, p.strip(T.WHITE)) for p in parts]
        assert [r.offset for r in own] == [sum(len(p) + 1 for p in parts[:k]) for k in range(len(parts))]


def test_closure_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        names = "abcdefgh"
        rows.append((rng.sample(names, rng.randint(0, 2)), [(rng.choices(names, k=rng.randint(0, 3)), rng.choice(names)) for _ in range(rng.randint(0, 12))]))
    chain = (["n0"], [([f"n{i}"], f"n{i + 1}") for i in reversed(range(60))])
    got = spark.createDataFrame([(i, *r) for i, r in enumerate([*rows, chain])], "i int, s array<string>, e array<struct<reads:array<string>,writes:string>>").select("i", closure(F.col("s"), F.col("e")).alias("t")).collect()
    for r in got:
        seeds, edges = [*rows, chain][r.i]
        known = set(seeds)
        while new := {w for reads, w in edges if known & set(reads)} - known:
            known |= new
        assert set(r.t) == known and len(r.t) == len(known)


def test_deep_guards_types_and_chains(spark):
    nested = "int f(int n) {\n" + "if (n < INT_MAX) {\n" + "if (a) {\n" * 12 + "n = n * 2;\n" + "}\n" * 13 + "}"
    types = "class A { void f(String s) { new java.io.File(s); new ArrayList<Map<String, List<Map<String, Integer>>>>(s); x = a > (b); } }"
    chain = "a0 = 'select ' + x\n" + "".join(f"a{i + 1} = a{i}\n" for i in range(9)) + "cur.execute(a9)\n"
    files = spark.createDataFrame([("a.c", nested), ("b.java", types), ("c.py", chain)], "file string, code string")
    got = hits(structure_rules.analyze_structure(files))
    assert [g for g in got if g[0] == "a.c"] == [] and [g[:3] for g in got if g[0] == "c.py"] == [("c.py", "ast-sqli", 11)]
    from vulnlake.operators.facts import extract

    assert {c["name"] for c in extract(types, "java")[0]} == {"java.io.File", "ArrayList"}


def test_credentials_and_own_rules(spark):
    files = [("a.py", "db_password = 'hunter22'\nPWD = 'abc'\napi_key = \"abcdef\"\nx = 'password'"), ("b.java", 'String authToken = "abcdef";'), ("c.c", '#define DB_PASS 1\n# define ROOT_PASSWD L"abcdef"'), ("d.txt", "password = 'hunter22'")]
    table = spark.createDataFrame(files, "file string, code string")
    got = hits(rules.analyze(table, credentials=True))
    assert got == [("a.py", "python-hardcoded-key", 3, 1), ("a.py", "python-hardcoded-password", 1, 1), ("b.java", "java-hardcoded-key", 1, 8), ("c.c", "cpp-hardcoded-password", 2, 1)]
    assert hits(rules.analyze(table)) == []

    @rules.rule("todo")
    def todo(corpus, order):
        return rules.match_patterns(corpus, [rules.Pattern("todo", "CWE-78", "low", "python", r"\bx\b", "An x.")], order)

    try:
        table.createOrReplaceTempView("own_code")
        rules.findings_view(spark, "own_code", "own_findings")
        assert [tuple(r) for r in spark.sql("select file, ruleId, line from own_findings where severity = 'low'").collect()] == [("a.py", "todo", 4)]
    finally:
        rules._more.clear()


def test_counters_reports_and_versions(spark, tmp_path):
    docs = spark.createDataFrame([("/a.py", None), ("/none.py", None), (None, "{")], "path string, _corrupt_record string")
    assert tuple(jobs.run_counters(docs, spark.createDataFrame([("a.py", "x")], "file string, code string")).first()) == (1, 1, 1)
    found = spark.createDataFrame([([("CWE-22",), ("CWE-78",), ("CWE-22",)],), ([],), (None,)], "f array<struct<cweId:string>>").select(metrics.tags(F.col("f")).alias("t")).collect()
    assert [r.t for r in found] == ["CWE-22, CWE-78", "(none)", "(none)"]
    rows = spark.createDataFrame([("b", 0.5), ("a", 1.0), ("b", 0.25), (None, 1.0), ("c", None)], "g string, s double")
    assert [tuple(r) for r in metrics.report(rows, ["s"], "g").collect()] == [("a", 1.0, 1), ("b", 0.375, 2)]
    jobs.write_results(rows, {"epochs": 3}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/test_results")).count() == 5
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "out/training_config"), wholetext=True).collect())) == {"epochs": 3}
    labelled = split.stratified(spark.createDataFrame([(f"d{i}", "CWE-22", []) for i in range(20)], "id string, cwe_folder string, vulnerabilities array<string>"))
    out = split.write_version(labelled, str(tmp_path / "set"), "2")
    assert spark.read.parquet(out).groupBy("split").count().count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        split.write_version(labelled, str(tmp_path / "set"), "2")
    place = spark.createDataFrame([(f"f{i}", "CWE-22") for i in range(10)], "file string, cwe_folder string").withColumn("v", split.positional_label())
    assert {r.file for r in place.where("v").collect()} == {f"f{i}" for i in range(6)}


def test_findings_json_and_log_lines(spark):
    found = rules.analyze(spark.createDataFrame([("a.py", "os.system(x)\nhashlib.md5(x)\n")], "file string, code string"))
    row = C.findings_json(found).first()
    assert [(f["ruleId"], f["line"], f["column"], f["severity"]) for f in json.loads(row.json)] == [("python-os-system", 1, 1, "high"), ("python-md5", 2, 1, "medium")]
    assert sorted(r.entry for r in C.log_lines(found).collect())[0].startswith("[HIGH] CWE-78 python-os-system at a.py:1:1 - os.system()")


def test_command_line(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code/a.py").write_text("import hashlib\nhashlib.md5(x)\n")
    for folder in ("CWE-327", "CWE-22"):
        (tmp_path / "meta" / folder).mkdir(parents=True)
        (tmp_path / f"meta/{folder}/a.json").write_text(json.dumps({"id": folder, "path": "/a.py", "vulnerabilities": [{"id": "1", "cwe": folder, "fixes": []}]}))
    run = lambda job, *more: main([job, str(tmp_path / "code"), str(tmp_path / job), *more])
    run("scan")
    assert [json.loads(r.json)[0]["ruleId"] for r in spark.read.json(str(tmp_path / "scan")).collect()] == ["python-md5"]
    run("enrich", "--metadata", str(tmp_path / "meta"), "--folders", "CWE-327")
    assert [(r.id, len(r.static_findings)) for r in spark.read.json(str(tmp_path / "enrich")).collect()] == [("CWE-327", 2)]
    run("compare", "--metadata", str(tmp_path / "meta"))
    assert {(r.cwe, r.left_tp, r.right_tp) for r in spark.read.json(str(tmp_path / "compare")).collect()} == {("CWE-327", 1, 1), ("CWE-22", 1, 1)}
    with pytest.raises(SystemExit):
        run("enrich")
