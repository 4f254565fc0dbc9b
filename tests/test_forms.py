"""Forms of code that the structure rules know, each with the findings that a reader expects, by file."""

from collections import defaultdict

from vulnlake.operators.structure_rules import analyze_structure

FORMS = {
    # file: (code, findings as (rule, line))
    "div.py": ("from pathlib import Path\nname = input()\np = Path('/srv') / name\nq = Path('/srv') / 'fixed'\n", [("ast-path-traversal", 3)]),
    "resolve.java": ("class A {\n  void f(String name) {\n    base.resolve(name);\n    base.resolve(\"fixed\");\n    Files.readAllBytes(name);\n    Files.readString(fixed);\n    new RandomAccessFile(name, \"r\");\n  }\n}\n", [("ast-path-traversal", 3), ("ast-path-traversal", 5), ("ast-path-traversal", 7)]),
    "prepare.java": ("class A {\n  void f(String id) {\n    con.prepareStatement(\"select a from t where i = \" + id);\n    con.prepareCall(\"{call p(?)}\");\n    con.prepareStatement(\"select a from t where i = ?\");\n    st.addBatch(\"delete from t where i = \" + id);\n  }\n}\n", [("ast-sqli", 3), ("ast-sqli", 6)]),
    "put.java": ("class A {\n  void f() {\n    props.put(\"password\", \"hunter22\");\n    props.put(\"color\", \"hunter22\");\n    new SecretKeySpec(\"0123456789abcdef\".getBytes(), \"AES\");\n    new SecretKeySpec(key, \"AES\");\n  }\n}\n", [("ast-hardcoded-cred", 3), ("ast-hardcoded-cred", 5)]),
    "list.java": ("class A {\n  void f(HttpServletRequest r) {\n    List names = new ArrayList();\n    names.add(r.getParameter(\"n\"));\n    new File(names.get(0));\n    List other = new ArrayList();\n    other.add(\"fixed\");\n    new File(other.get(0));\n  }\n}\n", [("ast-path-traversal", 5)]),
    "chain.java": ("class A {\n  void f(HttpServletRequest r) {\n    Map m = new HashMap();\n    String v = r.getHeader(\"n\");\n    m.put(\"k\", v);\n    String w = (String) m.get(\"k\");\n    Runtime.getRuntime().exec(w);\n  }\n}\n", [("ast-cmd-injection", 7)]),
    "scan.c": ("void f() {\n  char b[8];\n  scanf(\"%s\", b);\n  scanf(\"%d\", &n);\n  strncpy(a, b, strlen(b));\n  strncpy(a, b, 8);\n}\n", [("ast-oob-write", 3), ("ast-oob-write", 5)]),
    "pointer.c": ("void f(int n) {\n  *(p + n) = 1;\n  *(p + 1) = 1;\n  for (i = 0; i < n; i++) {\n    a[i] = 0;\n  }\n  for (i = 0; i < 9; i++) {\n    a[i] = 0;\n  }\n}\n", [("ast-oob-write", 2), ("ast-oob-write", 4)]),
    "read.c": ("void f() {\n  int n = atoi(s);\n  n++;\n  --n;\n  n += 4;\n  char *p = malloc(n * 4);\n  memcpy(a, b, n + 1);\n}\n", [("ast-integer-overflow", 3), ("ast-integer-overflow", 4), ("ast-integer-overflow", 5), ("ast-integer-overflow", 6), ("ast-integer-overflow", 6), ("ast-integer-overflow", 7)]),
    "limit.c": ("void f() {\n  int m = INT_MAX;\n  int k = m + 1;\n  int j = 3 + 1;\n}\n", [("ast-integer-overflow", 3)]),
    "scanned.c": ("void f() {\n  int n;\n  scanf(\"%d\", &n);\n  buf[n] = 1;\n  if (n < INT_MAX) {\n    buf[n] = 1;\n  }\n  buf[3] = 1;\n}\n", [("ast-oob-write", 4)]),
    "wincrypt.c": ("void f() {\n  CryptCreateHash(h, CALG_MD5, 0, 0, &x);\n  CryptDeriveKey(h, CALG_RC4, x, 0, &k);\n  CryptCreateHash(h, CALG_SHA_256, 0, 0, &x);\n}\n", [("ast-weak-wincrypt-hash", 2), ("ast-weak-wincrypt-hash", 2), ("ast-weak-wincrypt-cipher", 3)]),
    "text.c": ("void f() {\n  char b[64];\n  fgets(b, 64, stdin);\n  execl(b, \"x\", NULL);\n  char *h = getenv(\"HOME\");\n  execv(h, NULL);\n  execl(\"/bin/ls\", \"x\", NULL);\n  char r[9];\n  recv(s, r, 9, 0);\n  execlp(r, \"x\", NULL);\n}\n", [("ast-cmd-injection", 4), ("ast-cmd-injection", 6), ("ast-cmd-injection", 10)]),
    "collect.py": (
        "import sys, os\nname = sys.argv[1]\nnames = []\nnames.append(name)\nd = {}\nd['k'] = name\nt = {1}\nt.update(d)\nfor x in names:\n    open(x)\nopen(d['k'])\nos.system(t)\nz = []\nz.insert(0, name)\nz.insert(name, 0)\nopen(z[0])\nopen('fixed')\n",
        [("ast-path-traversal", 10), ("ast-path-traversal", 11), ("ast-cmd-injection", 12), ("ast-path-traversal", 16)],
    ),
    # what goes into a container must be a name that is tainted already: an input named right there doesn't count
    "direct.py": ("import sys\nnames = []\nnames.append(sys.argv[1])\nopen(names[0])\nother = []\nother.insert(name, 0)\nopen(other[0])\n", []),
    "names.java": ("class A {\n  void f(HttpServletRequest r) {\n    Deque q = new ArrayDeque();\n    q.push(r.getHeader(\"n\"));\n    List l = new ArrayList();\n    l.addAll(q);\n    new ZipFile(l.get(0));\n    Paths.get(\"a\", l);\n    new FileWriter(\"a\");\n  }\n}\n", [("ast-path-traversal", 7), ("ast-path-traversal", 8)]),
    "crypto.java": ("class A {\n  void f() throws Exception {\n    MessageDigest.getInstance(\"MD5\");\n    Cipher.getInstance(\"DES/ECB/PKCS5Padding\");\n    MessageDigest.getInstance(\"SHA-256\");\n    login(user, \"hunter22\");\n    new PBEKeySpec(\"hunter22\".toCharArray());\n  }\n}\n",
        [("ast-weak-hash", 3), ("ast-weak-hash", 3), ("ast-weak-cipher", 4), ("ast-hardcoded-cred", 6), ("ast-hardcoded-cred", 7)]),
}


def test_every_form(spark):
    files = spark.createDataFrame([(f, c) for f, (c, _) in FORMS.items()], "file string, code string")
    for ends in ("\n", "\r\n"):
        own = spark.createDataFrame([(r.file, r.code.replace("\n", ends)) for r in files.collect()], "file string, code string")
        got = defaultdict(list)
        for r in analyze_structure(own).collect():
            got[r.file].append((r.ruleId, r.line))
        assert {f: sorted(got[f]) for f in FORMS} == {f: sorted(want) for f, (_, want) in FORMS.items()}
