"""Places of matches, arguments and facts in one look at a text."""

import random
import re
import time

from pyspark.sql import functions as F

from vulnlake.functions import text as T
from vulnlake.operators import rules
from vulnlake.operators.structure_rules import analyze_structure


def place(code, at):
    before = code[:at]
    return before.count("\n") + 1, at - before.rfind("\n")


def test_matches_have_their_places(spark):
    rng = random.Random(1)
    codes = ["", "x", "\n", "aa(", "a(\n", "😀a(é)\r\na(\n\na(b a(", None] + ["".join(rng.choices(["a(", "b", "\n", "\r\n", "é", "😀", " ", "a\n("], k=rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, code string").repartition(3)
    for pattern, group in ((r"a\s*\(", 0), (r"(a)\s*(\()", 2), (r"[\s\S]a", 0), (r"\bb\b", 0)):
        rx = re.compile(T.ascii_borders(pattern), re.ASCII)
        for r in df.select("i", T.matches(F.col("code"), pattern, group).alias("m")).collect():
            code = codes[r.i]
            if code is None:
                continue
            found = list(rx.finditer(code))
            ends = [m.start() for m in found[1:]] + [len(code)] * bool(found)
            want = [(m.start(), *place(code, m.start()), m[0], m[group], code[m.end() : e]) for m, e in zip(found, ends, strict=True)]
            assert [tuple(x) for x in r.m or []] == want


def test_arguments(spark):
    rows = ["", "a", "a, b", " a ,b(c, d), [e, f] ,{g:h,i}", "'x, y', \"z, 'w'\"", "'it\\'s, one', two", "a,", ",", "é, 😀(1, 2)", "a)b, c", "  "]
    got = [list(r.a) for r in spark.createDataFrame([(x,) for x in rows], "t string").select(T.top_level_args(F.col("t")).alias("a")).collect()]
    assert got == [[], ["a"], ["a", "b"], ["a", "b(c, d)", "[e, f]", "{g:h,i}"], ["'x, y'", "\"z, 'w'\""], ["'it\\'s, one'", "two"], ["a"], [""], ["é", "😀(1, 2)"], ["a)b, c"], []]


def test_quoted_prefix_behind_the_next_match(spark):
    """A quotation that another match lies in still suppresses; one that never closes doesn't."""
    code = "os.system('a os.system(b')\nos.system('never closed\nos.system([1])\nos.system(  \"x\" + y)\nos.system(y)"
    got = rules.match_patterns(spark.createDataFrame([("a.py", code, "python")], "file string, code string, language string"), rules.PATTERNS)
    want = []
    for m in re.finditer(r"\bos\.system\s*\(", code):
        if not re.match(r"""\s*(\[|["'][^"']*["'])""", code[m.end() :]):
            want.append(place(code, m.start()))
    assert sorted((r.line, r.column) for r in got.collect()) == want and len(want) < 5


def test_long_files_take_time_in_proportion(spark):
    """16,000 matching lines in one file: the places are right, and the time is far from that of looking at the text once a match."""
    n = 16_000
    code = "\n".join(f"  hashlib.md5(x)  # {i}" if i % 2 else f" os.system('a' + name{i})" for i in range(n))
    files = spark.createDataFrame([("a.py", code)], "file string, code string").cache()
    files.count()
    began = time.time()
    got = rules.match_patterns(files.withColumn("language", F.lit("python")), rules.PATTERNS).select("line", "column").collect()
    assert sorted(map(tuple, got)) == [(i + 1, 3) for i in range(1, n, 2)]
    assert time.time() - began < 60
    began = time.time()
    got = analyze_structure(files).where("ruleId = 'ast-weak-hash' AND cweId = 'CWE-327'").select("line", "column").collect()
    assert sorted(map(tuple, got)) == [(i + 1, 3) for i in range(1, n, 2)]
    assert time.time() - began < 90
