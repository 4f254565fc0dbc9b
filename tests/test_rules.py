"""Text rules, structure rules and taint on small files: positive, suppressed, other language, CRLF, non-ASCII."""

import pytest

from vulnlake.operators import rules, structure_rules
from vulnlake.operators.facts import extract
from vulnlake.samples import SNIPPETS


def found(run, spark, files):
    rows = run(spark.createDataFrame(files, "file string, code string")).collect()
    return sorted((r.file, r.ruleId, r.line, r.column, r.evidence) for r in rows)


@pytest.fixture(scope="module")
def text(spark):
    files = [
        ("a.py", "x = 1\r\né = hashlib.md5 (b)\r\nos.system('ls')\nos.system(cmd)"),
        ("b.java", "hashlib.md5(x)"),
        ("c.c", "int f() {\n  strcpy(a, \"lit\");\n  strcpy(a, b);\n}"),
        ("d.py", "q = 'select * from t where a = ' + x\ncur.execute(q)\ncur.execute('select 1 where a = %s', (q,))"),
        ("e.py", "p = sys.argv[1]\nq = 'd/' + p\nopen(q)\nopen('fixed')\nopen(os.path.join('a', 'b'))"),
        ("f.c", "free(p);\nuse(p);\np = 0;\nuse(p);\n// use(p)\nfree(q);\nq->x = 1;"),
        ("g.c", "if (n < 9 && m < 9) {\nchar *a = malloc(n * m);\n}\nint t = n + k;\nint c = 3 * 4;"),
        ("émd5.py", "émd5 = 1"),
        ("h.java", "String n = request.getParameter(\"n\");\nFile a = new File(n);\nFile b = new File(\"x\");"),
        ("n.py", ""),
        ("o.py", None),
        ("z.txt", "hashlib.md5(x) free(p);"),
    ]
    return found(rules.analyze, spark, files)


def of(rows, file):
    return [r[1:] for r in rows if r[0] == file]


def test_places_and_suppression(text):
    assert of(text, "a.py") == [("python-md5", 2, 5, "hashlib.md5 ("), ("python-os-system", 4, 1, "os.system(")]
    assert of(text, "b.java") == [] and of(text, "z.txt") == [] and of(text, "n.py") == [] and of(text, "o.py") == []
    assert of(text, "c.c") == [("out-of-bounds-write", 3, 3, "strcpy(a, b)")]


def test_assignment_before_call(text):
    assert of(text, "d.py") == [("python-sqli-variable", 1, 1, "q = 'select * from t where a = ' + x")]


def test_paths(text):
    assert of(text, "e.py") == [("path-traversal", 3, 1, "open(q)")]
    assert [r[:3] for r in of(text, "h.java")] == [("path-traversal", 2, 10)]


def test_freed_until_assigned(text):
    assert [r[:3] for r in of(text, "f.c")] == [("use-after-free", 2, 5), ("use-after-free", 7, 1)]


def test_bounds_guard(text):
    assert of(text, "g.c") == [("integer-overflow", 4, 1, "int t = n + k;")]


def test_order(spark):
    files = [("a.py", "hashlib.md5(x)\nos.system(y)\nos.system(z)")]
    rows = rules.ordered(rules.analyze(spark.createDataFrame(files, "file string, code string"))).collect()
    assert [(r.severity, r.line) for r in rows] == [("high", 2), ("high", 3), ("medium", 1)]


STRUCTURE = [
    ("a.py", "from flask import request\nitems = []\nfor k in request.form:\n    items.append(k)\nsend_file('/s/' + items[0])\n", {("ast-path-traversal", 5)}),
    ("b.py", "password = 'hunter22'\nx = 'hunter22'\npwd = 'a'\n", {("ast-hardcoded-cred", 1)}),
    ("c.py", "q = 'select ' + x\ncur.execute(q)\ncur.execute('select 1')\n", {("ast-sqli", 2)}),
    ("d.py", "algo = 'md5'\nhashlib.new(algo)\n", {("ast-weak-hash", 2)}),
    ("e.py", "import sys\nos.system(sys.argv[1])\nsubprocess.run([sys.argv[1]])\nbase / sys.argv[2]\n", {("ast-cmd-injection", 2), ("ast-path-traversal", 4)}),
    ("f.java", 'class A { void f(String s) { new File(s); st.executeQuery("SELECT a" + s); new ProcessBuilder("ls", s); } }', {("ast-path-traversal", 1), ("ast-sqli", 1)}),
    ("g.java", 'class A { String password = "hunter22"; void f() { c.put("apiKey", "abcdefg"); new SecretKeySpec("abcdefg".getBytes(), "AES"); } }', {("ast-hardcoded-cred", 1)}),
    ("h.c", "void f(char *p) {\n  free(p);\n  g(p);\n  free(q);\n  q = 0;\n  g(q);\n}", {("ast-use-after-free", 3)}),
    ("i.c", "int f(int n) {\n  if (n < INT_MAX) { n++; }\n  int m = n * 2;\n  buf[n] = 1;\n  *(p + n) = 1;\n  for (int i = 0; i < n; i++) { b[i] = 0; }\n}", {("ast-integer-overflow", 3), ("ast-oob-write", 4), ("ast-oob-write", 5), ("ast-oob-write", 6)}),
    ("j.c", '#define API_KEY "abcdef"\nvoid f() { system(cmd); system("ls"); execl(PATH, "x", NULL); CryptCreateHash(h, CALG_MD5, 0); }', {("ast-hardcoded-cred", 1), ("ast-cmd-injection", 2), ("ast-weak-wincrypt-hash", 2)}),
    ("k.cc", "int x = INT_MAX;\nint y = x + 1;", {("ast-integer-overflow", 2)}),
    ("l.py", "def broken(:\n  '''never closed\n", set()),
    ("m.txt", "password = 'hunter22'", set()),
]


def test_structure(spark):
    rows = structure_rules.analyze_structure(spark.createDataFrame([s[:2] for s in STRUCTURE], "file string, code string")).collect()
    for file, _, want in STRUCTURE:
        assert {(r.ruleId, r.line) for r in rows if r.file == file} == want, file
    assert {r.cweId for r in rows if r.file == "d.py"} == {"CWE-327", "CWE-328"}


def test_structure_compat(spark):
    files = [("h.c", "void f(char *p) {\n  free(p);\n}"), ("k.cc", "int x = INT_MAX;\nint y = x + 1;")]
    rows = structure_rules.analyze_structure(spark.createDataFrame(files, "file string, code string"), compat=True).collect()
    assert [(r.file, r.ruleId) for r in rows] == [("h.c", "ast-use-after-free")]


def test_facts_of_every_sample():
    for suffix, code in SNIPPETS:
        if suffix != ".txt":
            assert len(extract(code, {".py": "python", ".java": "java", ".c": "c"}[suffix])) == 9
    for cut in range(0, 200, 7):  # incomplete code
        for suffix, code in SNIPPETS:
            if suffix != ".txt":
                extract(code[:cut], {".py": "python", ".java": "java", ".c": "c"}[suffix])
