"""A code corpus made from the ``part`` table: the same files in Spark and in SQL, with and without weaknesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix and text of each kind of file; {k} stands for the part key. Every other key has CRLF line ends.
SNIPPETS = [
    (".py", "import hashlib\ndef digest(x):\n    return hashlib.md5(x) + hashlib.sha1(x)\n"),
    (".py", "from Crypto.Cipher import DES\ncipher = DES.new(key{k})\nother = Crypto.Cipher.DES\n"),
    (".py", "import os\nname = input()\nos.system('ping ' + name)\nos.system(name)\n"),
    (".py", "import subprocess\nsubprocess.run(['ls', path])\nsubprocess.Popen(command{k}, shell=True)\n"),
    (".py", "def find(cur, name):\n    cur.execute(\"SELECT * FROM t{k} WHERE n = '\" + name + \"'\")\n"),
    (".py", "def find(cur, name):\n    query = f\"select * from t where n = '{name}'\"\n    cur.execute(query)\n    cur.execute('select 1 where a = %s', (name,))\n"),
    (".py", "import sys\nname = sys.argv[1]\nfull = '/data/' + name\nwith open(full) as f:\n    print(f.read())\n"),
    (".py", "base = 'fixed.txt'\nwith open(base) as f:\n    x{k} = f.read()\nopen('../etc/' + base)\n"),
    (".py", "password = 'hunter{k}22'\napi_key = 'abcdef{k}'\npwd = 'x'\n"),
    (".py", "from flask import request\nitems = []\nfor k in request.form:\n    items.append(k)\npath = '/srv/' + items[0]\nsend_file(path)\n"),
    (".java", "class A{k} {\n  void f() throws Exception {\n    MessageDigest.getInstance(\"MD5\");\n    MessageDigest.getInstance(\"SHA-1\");\n    Cipher.getInstance(\"DES\");\n  }\n}\n"),
    (".java", "class B{k} {\n  void f(String cmd) throws Exception {\n    Runtime.getRuntime().exec(cmd);\n    new ProcessBuilder(cmd);\n    rt.exec(\"ls\");\n  }\n}\n"),
    (".java", "class C{k} {\n  void f(Statement st, String id) throws Exception {\n    st.executeQuery(\"SELECT a FROM t WHERE id = \" + id);\n    String q = \"DELETE FROM t WHERE id = \" + id;\n    st.executeUpdate(q);\n  }\n}\n"),
    (".java", "class D{k} {\n  void f(HttpServletRequest request) throws Exception {\n    String name = request.getParameter(\"n\");\n    File x = new File(name);\n    File y = new File(\"fixed\");\n  }\n}\n"),
    (".java", "class E{k} {\n  String password = \"secret{k}\";\n  void f() { DriverManager.getConnection(url, user, \"hunter22\"); }\n}\n"),
    (".c", "#include <stdio.h>\nint main() {\n  char b[8];\n  gets(b);\n  strcpy(b, \"ok\");\n  strcpy(b, src{k});\n  sprintf(b, \"%d\", 1);\n}\n"),
    (".c", "void f(char *cmd) {\n  system(cmd);\n  system(\"ls\");\n  execl(path, \"x\", NULL);\n  MD5(d, n, m);\n  DES_ecb_encrypt(a, b);\n}\n"),
    (".c", "void f(char *p) {\n  free(p);\n  printf(\"%s\", p);\n  p = malloc(4);\n  use{k}(p);\n}\n"),
    (".c", "void f(int n, int m) {\n  if (n < 10 && m < 10) {\n  }\n  char *a = malloc(n * m);\n  int total = n + k{k};\n  int fixed = 3 * 4;\n}\n"),
    (".c", "#define DB_PASSWORD \"hunter{k}22\"\n#define LIMIT 5\nvoid f() {\n  int n = atoi(s);\n  buf[n] = 1;\n}\n"),
    (".c", "int add(int a) {\n  if (a < INT_MAX - 1) {\n    a = a + 1;\n  }\n  int b = a * 2;\n  return b;\n}\n"),
    (".py", "import os\nimport sys\nbase = 'data'\nname = sys.argv[1]\nwith open(os.path.join(base, 'fixed.txt')) as f:\n    a{k} = f.read()\nwith open(os.path.join(base, name)) as f:\n    b{k} = f.read()\n"),
    (".c", "int f(int n) {\n  if (n < INT_MAX) {\n" + "  if (c{k}) {\n" * 8 + "  n = n * 2;\n" + "  }\n" * 9 + "  int m = n * 3;\n  return m;\n}\n"),
    (".py", "def find(cur, x):\n    a = \"select \" + x\n    b = a\n    c = b\n    d = c\n    e = d\n    cur.execute(e)\n"),
    (".c", "void f() {\n" + "  x = 1;\n" * 300 + "  strcpy(a, b{k});\n}\n"),
    (".txt", "md5 SHA1( system( free(p); open(x)\n"),
]

#: Truth by kind of sample; the last kind is safe.
TRUE_CWE = {0: "CWE-327", 1: "CWE-327", 2: "CWE-78", 3: "CWE-78", 4: "CWE-89", 5: "CWE-89", 6: "CWE-22", 7: "CWE-22", 8: "CWE-259", 9: "CWE-22", 10: "CWE-327", 11: "CWE-78", 12: "CWE-89", 13: "CWE-22", 14: "CWE-259",
             15: "CWE-787", 16: "CWE-78", 17: "CWE-416", 18: "CWE-190", 19: "CWE-787", 20: "CWE-190", 21: "CWE-22", 22: "CWE-190", 23: "CWE-89", 24: "CWE-787"}


#: Files a task. Keys are small, what is made of them is not: by its bytes, a table of a million keys would be one or two tasks.
FILES_A_TASK = 2000


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, code, part_key, kind) for every part, dealt to tasks by the number of files."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("part_key"))
    tasks = -(-part.count() // FILES_A_TASK)
    if tasks > 1:
        part = part.repartition(tasks, "part_key")
    kind = F.pmod("part_key", F.lit(len(SNIPPETS))).cast("int")
    suffix, code = (F.get(F.array(*[F.lit(s[i]) for s in SNIPPETS]), kind) for i in (0, 1))
    code = F.replace(code, F.lit("{k}"), F.col("part_key").cast("string"))
    code = F.when(F.col("part_key") % 2 == 0, code).otherwise(F.replace(code, F.lit("\n"), F.lit("\r\n")))
    return part.select(F.concat(F.lit("src/part-"), F.col("part_key").cast("string"), suffix).alias("file"), code.alias("code"), "part_key", kind.alias("kind"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def corpus_sql() -> str:
    """The same corpus as common table expressions: snippets, corpus(file, code, part_key, kind)."""
    values = ", ".join(f"({i}, '{s}', {_quoted(c)})" for i, (s, c) in enumerate(SNIPPETS))
    return f"""snippets(kind, suffix, body) AS (VALUES {values}),
corpus AS (
  SELECT 'src/part-' || p_partkey || suffix AS file, p_partkey AS part_key, kind,
         CASE WHEN p_partkey % 2 = 0 THEN replace(body, '{{k}}', CAST(p_partkey AS VARCHAR))
              ELSE replace(replace(body, '{{k}}', CAST(p_partkey AS VARCHAR)), chr(10), chr(13) || chr(10)) END AS code
  FROM part JOIN snippets ON p_partkey % {len(SNIPPETS)} = kind
)"""
