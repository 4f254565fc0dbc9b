"""Splits, metrics, predictions, sources, streaming, and the registered queries against DuckDB."""

import json
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vulnlake import queries as Q
from vulnlake.functions import text as T
from vulnlake.operators import metrics, predictions, split
from vulnlake.operators.taint import closure
from vulnlake.plans import jobs
from vulnlake.sources import corpus as C
from vulnlake.streaming import watch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_matches_round_trip(spark):
    code = "émd5 md5(x)\r\n😀 md5(y) md5"
    rows = spark.createDataFrame([(code,)], "c string").select(F.explode(T.matches(F.col("c"), r"\bmd5"))).select("col.*").collect()
    assert [(r.at, r.hit) for r in rows] == [(i, "md5") for i in (1, 5, 15, 22)] and all(code[r.at :].startswith(r.hit) for r in rows)


def test_top_level_args(spark):
    rows = spark.createDataFrame([("a, f(b, c), 'd,e', ",), ("",), ("x",)], "t string").select(T.top_level_args(F.col("t")).alias("a")).collect()
    assert [r.a for r in rows] == [["a", "f(b, c)", "'d,e'"], [], ["x"]]


def test_closure(spark):
    rows = [(["a"], [(["b"], "c"), (["a"], "b"), (["c"], "a"), (["x"], "y")]), ([], [(["a"], "b")]), (["a"], [])]
    out = spark.createDataFrame(rows, "s array<string>, e array<struct<reads:array<string>,writes:string>>").select(closure(F.col("s"), F.col("e")).alias("t")).collect()
    assert [sorted(r.t) for r in out] == [["a", "b", "c"], [], ["a"]]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=4), st.lists(st.sampled_from("abcd"), max_size=4))
def test_f1_is_symmetric(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(metrics.f1(F.col("a"), F.col("b")).alias("x"), metrics.f1(F.col("b"), F.col("a")).alias("y")).first()
    assert row.x == row.y and 0 <= row.x <= 1
    assert (row.x == 1) == (set(a) == set(b))


def test_split(spark):
    docs = spark.createDataFrame([(f"d{i}", "CWE-22" if i < 100 else "MULTI-CWE", ["v"] if i % 2 else [], "test" if i == 3 else None) for i in range(150)], "id string, cwe_folder string, vulnerabilities array<string>, split string")
    rows = split.stratified(docs).collect()
    assert len(rows) == 150 and {r.id for r in rows} == {f"d{i}" for i in range(150)} and next(r.split for r in rows if r.id == "d3") == "test"
    counts = {}
    for r in rows:
        counts[r.cwe_folder, r.split] = counts.get((r.cwe_folder, r.split), 0) + 1
    assert counts["MULTI-CWE", "train"] == 30 and counts["CWE-22", "train"] == 79
    assert sorted(split.stratified(docs).collect()) == sorted(rows)
    with pytest.raises(Exception, match="unknown split"):
        split.routed(docs.withColumn("split", F.lit("other")))["train"].collect()


def test_predictions(spark):
    raws = ['text {"vulnerabilities":[{"cwe":"CWE-22","fixes":[{"origin":"a","replacement":"b"}]},{"cwe":7}]} end', "none", '{"vulnerabilities":3}', None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("v", predictions.parse(F.coalesce("raw", F.lit("")))).orderBy("i").collect()
    assert [[v.cwe for v in r.v] for r in rows] == [["CWE-22"], [], [], []]
    fixes = [("aa", "b"), ("b", "c"), ("", "x"), ("zz", "y")]
    row = spark.createDataFrame([("aa aa", fixes)], "c string, f array<struct<origin:string,replacement:string>>").select(predictions.apply_fixes(F.col("c"), F.col("f")).alias("o")).first()
    assert row.o == "c aa"
    rows = spark.createDataFrame([("x = 1", "python"), ("x = (", "python"), ("x", "java"), ("x", "c")], "c string, l string").select(predictions.compiles(F.col("c"), F.col("l")).alias("s")).collect()
    assert [r.s for r in rows] == [1.0, 0.0, 0.0, None]


def test_evaluation(spark):
    samples = spark.createDataFrame([("1", "a.py", "import hashlib\nhashlib.md5(x)\n", "python", ["CWE-327"]), ("2", "b.py", "x = 1\n", "python", []), ("3", "c.py", "x = 1\n", "python", [])], "id string, file string, code string, language string, cwes array<string>")
    answers = spark.createDataFrame([("1", '{"vulnerabilities":[{"cwe":"CWE-327","fixes":[{"origin":"md5","replacement":"sha256"}]}]}'), ("2", '{"vulnerabilities":[]}'), ("3", '{"vulnerabilities":[{"cwe":"CWE-22","fixes":[]}]}')], "id string, raw string")
    got = {r.id: r for r in jobs.evaluate(samples, answers).collect()}
    assert got["1"].final_score == 1.0 and got["2"].final_score == 1.0 and got["3"].final_score == 0.0


def test_corpus_and_enrichment(spark, tmp_path):
    for name, doc in {"CWE-22/python/a.json": {"schema_version": "1.0", "id": "a", "path": "/src/a.py", "source": {"type": "synthetic", "name": None}, "vulnerabilities": []}, "CWE-22/python/b.json": {"id": "b", "path": "/src/none.py"}, "CWE-22/c.json": None}.items():
        (tmp_path / "meta" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "meta" / name).write_text(json.dumps(doc) if doc else "{broken")
    (tmp_path / "code/src").mkdir(parents=True)
    (tmp_path / "code/src/a.py").write_text("import sys\nopen(sys.argv[1])\n")
    (tmp_path / "code/src/big.py").write_text("x" * 2_000_000)
    meta, sources = C.read_metadata(spark, str(tmp_path / "meta")).cache(), C.read_sources(spark, str(tmp_path / "code"))
    assert meta.where("_corrupt_record is not null").count() == 1 and sources.count() == 1
    docs = C.parsed(meta)
    assert [r.id for r in C.without_code(docs, sources).collect()] == ["b"]
    out = jobs.enrich(C.in_folders(docs, ["CWE-22"]), sources)
    C.write_documents(out, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1 and [f.ruleId for f in rows[0].static_findings] == ["ast-path-traversal"]


def test_long_files_are_enriched(spark, tmp_path):
    (tmp_path / "meta/CWE-22").mkdir(parents=True)
    (tmp_path / "meta/CWE-22/big.json").write_text(json.dumps({"id": "big", "path": "/big.py", "vulnerabilities": []}))
    (tmp_path / "code").mkdir()
    (tmp_path / "code/big.py").write_text("import sys\nopen(sys.argv[1])\n" + "# filler\n" * 120_000)
    docs, sources = C.parsed(C.read_metadata(spark, str(tmp_path / "meta"))), C.all_sources(spark, str(tmp_path / "code"))
    assert C.without_code(docs, sources).count() == 0
    rows = jobs.enrich(docs, sources).collect()
    assert [r.id for r in rows] == ["big"] and [f.ruleId for f in rows[0].static_findings] == ["ast-path-traversal"]


def test_stream_keeps_latest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("hashlib.md5(x)\n")
    run = lambda: watch.watch(watch.saved_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (tmp_path / "in/b.py").write_text("x = 1\n")
    run()
    rows = {r.file: r.static_findings for r in watch.current(spark, str(tmp_path / "out")).collect()}
    assert set(rows) == {"a.py", "b.py"} and rows["a.py"][0].ruleId == "python-md5" and not rows["b.py"]


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    rows = Q.QUERIES[name](spark, SF)
    got = rows.collect()
    assert got
    if name not in Q.ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    found = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(rows.columns)
    show = lambda x: tuple("" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in x)
    assert sorted(show(r[c] for c in sorted(names)) for r in got) == sorted(show(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())
