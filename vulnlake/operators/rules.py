"""Rules on the text of a file: a rule table matched in one scan, and rules that look around a match."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import FINDING_NAMES
from .taint import closure, taints

SEVERITY_ORDER = {"high": 0, "medium": 1, "low": 2}


@dataclass(frozen=True)
class Pattern:
    """A rule that reports every match of a regular expression in files of one language."""

    rule: str
    cwe: str
    severity: str
    language: str
    regex: str
    message: str
    unless: Callable[[Column, Column, Column], Column] | None = None  # (code, match, its end) -> suppressed


def _plain_argument(code: Column, match: Column, end: Column) -> Column:
    """The call goes on with a list or with a quoted prefix.

    What follows up to the next match tells that nearly always; only a quotation that is still open there needs the rest of the text.
    """
    near, rest = match["after"], F.substring(code, end + 1, F.lit(2**30))
    open_quote = F.regexp_like(near, F.lit(r"""^\s*["'][^"']*$"""))
    plain = r"""^\s*(\[|["'][^"']*["'])"""
    return F.regexp_like(near, F.lit(plain)) | (open_quote & F.regexp_like(F.when(open_quote, rest), F.lit(plain)))


def _literal_source(code: Column, match: Column, end: Column) -> Column:
    """strcpy or strcat from a string literal."""
    second = T.trim(F.get(F.split(F.regexp_extract(match["hit"], r"\(([^)]*)\)", 1), ","), F.lit(1)))
    return F.coalesce(second.rlike('^L?"[^"]*"$'), F.lit(False))


def _names_a_key(code: Column, match: Column, end: Column) -> Column:
    """What is assigned to is a key, secret or token, which has a rule of its own."""
    return F.lower(F.regexp_extract(match["hit"], r"^[^=\"]*", 0)).rlike("key|secret|token")


#: Fixed values from here to RISKY_LINE: titles, rule names, patterns, messages, sources and sinks.
TITLES = {
    "CWE-22": "Path Traversal", "CWE-78": "OS Command Injection", "CWE-89": "SQL Injection", "CWE-190": "Integer Overflow", "CWE-416": "Use After Free",
    "CWE-787": "Out-of-bounds Write", "CWE-327": "Use of a Broken or Risky Cryptographic Algorithm",
}
PATTERNS = [
    Pattern("python-md5", "CWE-327", "medium", "python", r"\bhashlib\.md5\s*\(", "hashlib.md5() uses MD5, which is considered cryptographically weak."),
    Pattern("python-sha1", "CWE-327", "medium", "python", r"\bhashlib\.sha1\s*\(", "hashlib.sha1() uses SHA-1, which is considered cryptographically weak."),
    Pattern("python-des", "CWE-327", "medium", "python", r"\b(Crypto\.Cipher\.DES|DES\.new)\b", "DES is an outdated and insecure encryption algorithm."),
    Pattern("java-md5", "CWE-327", "medium", "java", r'MessageDigest\s*\.\s*getInstance\s*\(\s*"MD5"\s*\)', 'MessageDigest.getInstance("MD5") uses MD5, which is considered cryptographically weak.'),
    Pattern("java-sha1", "CWE-327", "medium", "java", r'MessageDigest\s*\.\s*getInstance\s*\(\s*"SHA-?1"\s*\)', 'MessageDigest.getInstance("SHA-1") uses SHA-1, which is considered cryptographically weak.'),
    Pattern("java-des", "CWE-327", "medium", "java", r'Cipher\s*\.\s*getInstance\s*\(\s*"DES([/"][^"]*)?"\s*\)', 'Cipher.getInstance("DES") uses DES, which is an outdated and insecure encryption algorithm.'),
    Pattern("cpp-md5", "CWE-327", "medium", "cpp", r"\b(MD5\s*\(|EVP_md5\s*\()", "MD5 usage detected. MD5 is considered cryptographically weak."),
    Pattern("cpp-sha1", "CWE-327", "medium", "cpp", r"\b(SHA1\s*\(|EVP_sha1\s*\()", "SHA-1 usage detected. SHA-1 is considered cryptographically weak."),
    Pattern("cpp-des", "CWE-327", "medium", "cpp", r"\bDES_[A-Za-z0-9_]*\b", "DES usage detected. DES is an outdated and insecure encryption algorithm."),
    Pattern("cpp-system", "CWE-78", "high", "cpp", r"(?i)\bsystem\s*\(", "Use of system() may allow OS command injection if input is not controlled.", _plain_argument),
    Pattern("cpp-popen", "CWE-78", "high", "cpp", r"(?i)\bpopen\s*\(", "Use of popen() may allow OS command injection if input is not controlled.", _plain_argument),
    Pattern("cpp-exec", "CWE-78", "high", "cpp", r"(?i)\b(execl|execlp|execle|execv|execvp|execve|execvpe)\s*\(", "Use of exec*() may allow OS command injection if arguments are user-controlled.", _plain_argument),
    Pattern("cpp-spawn", "CWE-78", "high", "cpp", r"(?i)\b(_spawnl|_spawnlp|_spawnle|_spawnlpe|_spawnv|_spawnvp|_spawnve|_spawnvpe|posix_spawn|posix_spawnp)\s*\(", "Use of spawn*() may allow OS command injection if arguments are user-controlled.", _plain_argument),
    Pattern("java-runtime-exec", "CWE-78", "high", "java", r"\b[a-zA-Z_][a-zA-Z0-9_]*\s*\.\s*exec\s*\(", "Runtime.exec() may allow OS command injection if input is not controlled.", _plain_argument),
    Pattern("java-processbuilder", "CWE-78", "high", "java", r"\bProcessBuilder\s*\(", "ProcessBuilder may allow OS command injection if arguments include unsafe input.", _plain_argument),
    Pattern("python-os-system", "CWE-78", "high", "python", r"\bos\.system\s*\(", "os.system() may allow OS command injection if input is not controlled.", _plain_argument),
    Pattern("python-subprocess", "CWE-78", "high", "python", r"\bsubprocess\.(run|Popen|call|check_call|check_output)\s*\(", "subprocess execution may allow OS command injection if input is not controlled.", _plain_argument),
]
BOUNDS_MESSAGE = "This code uses a function that can write past the bounds of a buffer. Consider safer bounded alternatives such as fgets, snprintf, or explicit length checks."
BOUNDS = [
    Pattern("out-of-bounds-write", "CWE-787", "high", "cpp", rx, BOUNDS_MESSAGE, _literal_source if name in ("strcpy", "strcat") else None)
    for name, rx in (
        ("gets", r"\bgets\s*\(([^)]*)\)"), ("strcpy", r"\bstrcpy\s*\(([^)]*)\)"), ("strcat", r"\bstrcat\s*\(([^)]*)\)"), ("sprintf", r"\bsprintf\s*\(([^)]*)\)"), ("vsprintf", r"\bvsprintf\s*\(([^)]*)\)"),
        ("scanf", r'\bscanf\s*\(\s*"%s"\s*,\s*([^)]+)\)'), ("fscanf", r'\bfscanf\s*\([^,]+,\s*"%s"\s*,\s*([^)]+)\)'), ("sscanf", r'\bsscanf\s*\([^,]+,\s*"%s"\s*,\s*([^)]+)\)'),
    )
]
USER_INPUT = {
    "python": r"\binput\s*\(|\bsys\.argv\b|\brequest\.",
    "java": r"\brequest\.|\breq\.|\bgetParameter\s*\(|\bgetHeaders?\s*\(|\bgetQueryString\s*\(|\bgetPathInfo\s*\(|\bgetParts?\s*\(|(?i:\bscanner\.next(Line)?\s*\()|\breadLine\s*\(|\bargs\s*\[|\.getValue\s*\(|\.nextElement\s*\(",
}
JAVA_SEEDS = [
    r"\bString\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*.*(?:getParameter|getHeaders?|getQueryString|getPathInfo|nextLine|readLine)\s*\(",
    r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*[^;]*\.(?:getValue|nextElement)\s*\(",
]
PYTHON_PATH_SINKS = ["open", "os.open", "send_file", "send_from_directory", "shutil.copy", "shutil.copyfile", "shutil.move", "zipfile.ZipFile", "tarfile.open"]
JAVA_PATH_SINKS = [rf"\bnew\s+{t}\s*\(([\s\S]*?)\)" for t in ("File", "FileInputStream", "FileOutputStream", "FileReader", "FileWriter", "RandomAccessFile")] + [
    r"\bPaths\.get\s*\(([\s\S]*?)\)", r"\bPath\.of\s*\(([\s\S]*?)\)",
    r"\bFiles\.(?:readAllBytes|readString|lines|newInputStream|newBufferedReader|newBufferedWriter|writeString|newOutputStream|copy|move|delete|exists|isDirectory|isRegularFile)\s*\(([\s\S]*?)\)",
    r"\bnew\s+ZipFile\s*\(([\s\S]*?)\)",
]
PATH_MESSAGE = "This file operation appears to use a user-controlled path without proper validation, which may allow directory traversal or access to unintended files."
JAVA_PATH_MESSAGE = "This file or path operation appears to use a user-controlled path without proper validation, which may allow directory traversal or access to unintended files."
OVERFLOW_MESSAGE = "This arithmetic operation may overflow before being used for allocation, copying, or size calculation."
FREED_MESSAGE = "This code appears to use a pointer after it was freed. Accessing freed memory can cause crashes or security vulnerabilities."
VARIABLE_SQL_MESSAGE = 'Possible SQL injection: SQL query variable "%s" appears to be built unsafely before execution.'
INLINE_SQL_MESSAGE = "Possible SQL injection: query appears to be built inline using unsafe string construction."
IGNORED_NAMES = ["malloc", "calloc", "realloc", "memcpy", "sizeof", "int", "short", "long", "size_t", "unsigned", "char", "void"]
RISKY_LINE = r"\bmalloc\s*\([^)]*[+*][^)]*\)|\brealloc\s*\([^,]+,\s*[^)]*[+*][^)]*\)|\bmemcpy\s*\([^,]+,\s*[^,]+,\s*[^)]*[+*][^)]*\)|\b(?:int|short|long|size_t|unsigned|unsigned\s+int|unsigned\s+long)\s+[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[^;]*[+*][^;]*;"

#: Hard-coded credentials in the text, by the names and lengths of the structure rules. An addition: ``analyze`` takes it as an option.
CREDENTIALS = [
    Pattern(f"{language}-hardcoded-{kind}", cwe, "high", language, regex.format(names=names), message, unless)
    for language, regex in (
        ("python", r"""(?i)\b\w*(?:{names})\w*\s*=\s*(?:"[^"\r\n]{{4,}}"|'[^'\r\n]{{4,}}')"""), ("java", r"""(?i)\b\w*(?:{names})\w*\s*=\s*"[^"\r\n]{{4,}}\""""),
        ("cpp", r"""(?i)#[ \t]*define[ \t]+\w*(?:{names})\w*[ \t]+L?"[^"\r\n]{{4,}}\""""),
    )
    for kind, cwe, names, message, unless in (
        ("password", "CWE-259", "password|passwd|pwd|passphrase|credential|passcode", "A password appears to be written in the code.", _names_a_key),
        ("key", "CWE-321", "key|secret|token", "A key or token appears to be written in the code.", None),
    )
]
TITLES |= {"CWE-259": "Use of Hard-coded Password", "CWE-321": "Use of Hard-coded Cryptographic Key"}

_RAW = "rule int, ruleId string, cweId string, severity string, message string, line int, column int, evidence string, n int"


def findings(rows: DataFrame) -> DataFrame:
    """Rows (file, rule, ruleId, cweId, severity, message, line, column, evidence, n) as findings plus the two tie-breakers."""
    title = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[F.col("cweId")]
    return rows.select("cweId", "ruleId", title.alias("vulnerability"), "severity", "message", "file", "line", "column", "evidence", F.col("rule").alias("rule_order"), F.col("n").alias("match_order"))


def _raw(order: int, rule: Column | str, cwe: str, severity: str, message: Column | str, line: Column, column: Column, evidence: Column, n: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(order).alias("rule"), text(rule).alias("ruleId"), F.lit(cwe).alias("cweId"), F.lit(severity).alias("severity"), text(message).alias("message"),
        line.cast("int").alias("line"), column.cast("int").alias("column"), evidence.alias("evidence"), n.cast("int").alias("n"),
    )


def _exploded(corpus: DataFrame, found: Column) -> DataFrame:
    """Findings from an array of them for each file; the code itself goes no further."""
    return findings(corpus.select("file", F.explode(found).alias("m")).select("file", "m.*"))


def _kept(code: Column, p: Pattern, order: int) -> Column:
    """The matches of one pattern that nothing suppresses."""

    def row(m: Column, i: Column) -> Column:
        safe = p.unless(code, m, m["at"] + F.char_length(m["hit"])) if p.unless else F.lit(False)
        return F.struct(safe.alias("safe"), _raw(order, p.rule, p.cwe, p.severity, p.message, m["line"], m["column"], m["hit"], i).alias("raw"))

    return F.transform(F.filter(F.transform(T.matches(code, p.regex), row), lambda x: ~x["safe"]), lambda x: x["raw"])


def match_patterns(corpus: DataFrame, patterns: list[Pattern], first_order: int = 0) -> DataFrame:
    """All matches of all patterns: one scan of the corpus, one explode, no shuffle. ``corpus``: file, code, language."""
    code = F.col("code")
    by_language: dict[str, Column] = {}
    for language in dict.fromkeys(p.language for p in patterns):
        found = []
        for k, p in enumerate(patterns):
            if p.language != language:
                continue
            found.append(_kept(code, p, first_order + k))
        by_language[language] = F.flatten(F.array(*found))
    chosen = reduce(lambda acc, kv: acc.when(F.col("language") == kv[0], kv[1]), list(by_language.items())[1:], F.when(F.col("language") == next(iter(by_language)), next(iter(by_language.values()))))
    return _exploded(corpus.where(F.col("language").isin(*by_language)), chosen)


def code_lines(corpus: DataFrame) -> DataFrame:
    """(file, language, i, raw, offset, line): lines with their place and trimmed text. Each file is one row of ``corpus``."""
    rows = corpus.select("file", "language", F.posexplode(F.split("code", "\n", -1)).alias("i", "raw"))
    before = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length("raw") + 1).over(before), F.lit(0))
    return rows.select("file", "language", "i", "raw", offset.alias("offset"), T.trim(F.col("raw")).alias("line"))


#: Statements, and the signs that one is put together from parts.
SQL_VERBS = r"\b(select|insert|update|delete)\b"
_PLUS = r"\+\s*[a-zA-Z_][a-zA-Z0-9_]*"
BUILT_SQL = {
    "python": rf"""\bf["'`]|\.format\s*\(|["'][^"']*%[sd][^"']*["']\s*%|["'][^"']*["']\s*\+|{_PLUS}""",
    "java": rf'\bString\s*\.\s*format\s*\(|"[^"]*"\s*\+|{_PLUS}',
}


def _dangerous_sql(text: Column, python: bool) -> Column:
    """A statement that is put together from parts."""
    sql = T.has(F.lower(text), SQL_VERBS)
    return F.coalesce(sql & T.has(text, BUILT_SQL["python" if python else "java"]), F.lit(False))


def _sql_calls(order: int, python: bool) -> Column:
    """Findings of one language from ``calls`` and ``assigns`` of a file, as arrays of the row."""

    def last(m: Column, args: Column) -> Column:
        """Backward as-of: of the assignments to ``args`` before the call the last, cut where the call begins."""
        own = F.filter("assigns", lambda a: (a["name"] == args) & (a["at"] < m["at"]))
        cut = F.transform(own, lambda a: F.struct(a["at"].alias("at"), a["line"].alias("line"), a["column"].alias("column"), F.substring(a["hit"], F.lit(1), m["at"] - a["at"]).alias("hit")))
        return F.try_element_at(F.filter(cut, lambda a: a["hit"].rlike(r"=\s*" + ("[^\n]" if python else "[^;\n]"))), F.lit(-1))

    def paired(m: Column, i: Column) -> Column:
        args = T.trim(m["arg"])
        parts = T.top_level_args(args) if python else F.array().cast("array<string>")
        return F.struct(m["line"].alias("line"), m["column"].alias("column"), m["hit"].alias("hit"), i.alias("i"), args.alias("args"), parts.alias("parts"), F.when(T.is_name(args), last(m, args)).alias("last"))

    def verdict(x: Column) -> Column:
        args, before, value = x["args"], x["last"], F.regexp_extract(x["last"]["hit"], r"=\s*([\s\S]*)$", 1)
        if python:
            safe = (F.size(x["parts"]) > 1) & F.get(x["parts"], F.lit(0)).rlike(r"%s|\?")
        else:
            safe = F.contains(args, F.lit("?")) | F.coalesce(F.contains(value, F.lit("?")), F.lit(False))
        inline = _dangerous_sql(args, python)
        variable = before.isNotNull() & _dangerous_sql(value, python)
        message = F.when(inline, F.lit(INLINE_SQL_MESSAGE)).otherwise(F.format_string(VARIABLE_SQL_MESSAGE, args))
        line, column = (F.when(inline, x[c]).otherwise(before[c]) for c in ("line", "column"))
        rule = F.when(inline, F.lit("python-sqli-inline" if python else "java-sqli-inline")).otherwise(F.lit("python-sqli-variable" if python else "java-sqli-variable"))
        found = _raw(order, rule, "CWE-89", "high", message, line, column, F.when(inline, x["hit"]).otherwise(before["hit"]), x["i"])
        return F.when(~F.coalesce(safe, F.lit(False)) & (inline | variable), found)

    return F.transform(F.transform("calls", paired), verdict)


def sql_injection(corpus: DataFrame, first_order: int) -> DataFrame:
    """Queries built in the call, or in the last assignment before it of the variable that is its argument."""
    code, python = F.col("code"), F.col("language") == "python"
    calls = F.when(python, T.matches(code, r"\b[a-zA-Z_][a-zA-Z0-9_]*\.execute\s*\(([\s\S]*?)\)", 1)).otherwise(T.matches(code, r"\b[a-zA-Z_][a-zA-Z0-9_]*\.(?:executeQuery|executeUpdate|execute)\s*\(([\s\S]*?)\)", 1))
    assigns = F.when(python, T.matches(code, r"\b[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[^\n]+")).otherwise(T.matches(code, r"(?:String\s+)?\b[a-zA-Z_][a-zA-Z0-9_]*\b\s*=\s*[^;\n]+"))
    named = F.transform(assigns, lambda a: F.struct(a["at"].alias("at"), a["line"].alias("line"), a["column"].alias("column"), a["hit"].alias("hit"), F.regexp_extract(a["hit"], r"^(?:String\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*=", 1).alias("name")))
    rows = corpus.where(F.col("language").isin("python", "java")).select("file", "code", "language", calls.alias("calls"))
    # Not a filter: that would go below whatever deals the files to tasks, and look for the calls twice.
    rows = rows.select("*", F.when(F.size("calls") > 0, named).alias("assigns"))
    found = F.when(python, _sql_calls(first_order, True)).otherwise(_sql_calls(first_order, False))
    return _exploded(rows, F.filter(found, lambda x: x.isNotNull()))


def text_taint(corpus: DataFrame) -> DataFrame:
    """``corpus`` plus tainted and constants: names of a Python or Java file that carry input or one literal."""
    code, python = F.col("code"), F.col("language") == "python"
    found = lambda rx: F.regexp_extract_all(code, F.lit(rx), F.lit(0))
    assign = F.when(python, found(r"(?m)^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[^\r\n]+")).otherwise(found(r"(?m)^\s*(?:(?:String|Path|File)\s+)?[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[^\r\n]+;"))
    value = lambda a: F.regexp_extract(a, r"=\s*([\s\S]*)$", 1)
    edges = F.transform(assign, lambda a: F.struct(
        F.regexp_extract(a, r"^\s*(?:(?:String|Path|File)\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*=", 1).alias("writes"), T.names_in(value(a)).alias("reads"),
        F.when(python, T.has(value(a), USER_INPUT["python"])).otherwise(T.has(value(a), USER_INPUT["java"])).alias("source"),
    ))
    java = F.concat(*[F.regexp_extract_all(code, F.lit(T.ascii_borders(p)), F.lit(1)) for p in JAVA_SEEDS])
    out = corpus.withColumn("__e", F.when(F.col("language").isin("python", "java"), edges))
    seeds = F.concat(F.transform(F.filter("__e", lambda e: e["source"]), lambda e: e["writes"]), F.when(python, F.array().cast("array<string>")).otherwise(java))
    constants = F.when(python, F.regexp_extract_all(code, F.lit(r"""(?m)^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*["'][^"'\r\n]*["'][ \t\r]*$"""), F.lit(1))).otherwise(F.regexp_extract_all(code, F.lit(T.ascii_borders(r"""\bString\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*["'][^"']*["']\s*;""")), F.lit(1)))
    return out.select(*corpus.columns, F.array_sort(closure(seeds, F.col("__e"))).alias("tainted"), F.array_distinct(constants).alias("constants"))


def _path_verdict(expr: Column, python: bool) -> tuple[Column, Column]:
    """Whether the arguments of a path sink are clearly safe, and whether they are dangerous, beside ``tainted`` and ``constants``."""
    climbs = F.contains(expr, F.lit("../")) | F.contains(expr, F.lit("..\\"))
    constant = T.is_name(expr) & F.array_contains("constants", expr)
    wrap = r"^os\.path\.join\s*\((.*)\)$" if python else r"^(?:Paths\.get|Path\.of)\s*\((.*)\)$"
    parts = F.when(expr.rlike(wrap), T.top_level_args(F.regexp_extract(expr, wrap, 1)))
    joins = expr.rlike(r"os\.path\.join\s*\(" if python else r"Paths\.get\s*\(|Path\.of\s*\(")
    dirty = T.has(expr, USER_INPUT["python" if python else "java"])
    fixed = lambda names: F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda a: T.is_literal(a) | (F.lit(names) & T.is_name(a) & F.array_contains("constants", a))), F.lit(False))
    safe = ~climbs & (T.is_literal(expr) | constant | fixed(False))
    bad = climbs | dirty | (~constant & (taints(T.names_in(expr), F.col("tainted")) | (joins & ~fixed(True))))
    return safe, bad


def _python_paths(order: int) -> Column:
    """By line: the first sink whose arguments aren't clearly safe decides."""
    sinks = [s.replace(".", r"\.") for s in PYTHON_PATH_SINKS]
    first = lambda raw, sink: F.get(T.matches(raw, rf"\b{sink}\s*\(([^\r]*)\)", 1), F.lit(0))
    lines = F.transform(F.split("code", "\n", -1), lambda raw, i: F.struct(i.alias("i"), raw.alias("raw")))
    some = F.filter(lines, lambda x: T.has(x["raw"], rf"\b(?:{'|'.join(sinks)})\s*\(") & ~T.trim(x["raw"]).startswith("#"))
    tried = F.transform(some, lambda x: F.struct(x["i"].alias("i"), x["raw"].alias("raw"), F.array(*[first(x["raw"], s) for s in sinks]).alias("firsts")))
    usable = lambda m: m.isNotNull() & (T.trim(m["arg"]) != "") & ~_path_verdict(T.trim(m["arg"]), True)[0]
    chosen = F.transform(tried, lambda x: F.struct(x["i"].alias("i"), x["raw"].alias("raw"), F.get(F.filter(x["firsts"], usable), F.lit(0)).alias("m")))
    found = lambda x: _raw(order, "path-traversal", "CWE-22", "high", PATH_MESSAGE, x["i"] + 1, x["m"]["at"] + 1, T.trim(x["raw"]), x["i"])
    return F.transform(chosen, lambda x: F.when(x["m"].isNotNull() & _path_verdict(T.trim(x["m"]["arg"]), True)[1], found(x)))


def _java_paths(order: int) -> Column:
    calls = F.transform(F.flatten(F.array(*[T.matches(F.col("code"), p, 1) for p in JAVA_PATH_SINKS])), lambda m, i: F.struct(m["line"].alias("line"), m["column"].alias("column"), m["hit"].alias("hit"), T.trim(m["arg"]).alias("arg"), i.alias("i")))

    def judged(m: Column) -> Column:
        safe, bad = _path_verdict(m["arg"], False)
        found = _raw(order, "path-traversal", "CWE-22", "high", JAVA_PATH_MESSAGE, m["line"], m["column"], m["hit"], m["i"])
        return F.when((m["arg"] != "") & ~safe & bad, found)

    return F.transform(calls, judged)


def path_traversal(corpus: DataFrame, first_order: int) -> DataFrame:
    """File operations on outside input: by line in Python, where the first usable sink decides, by call in Java."""
    rows = text_taint(corpus.where(F.col("language").isin("python", "java")))
    found = F.when(F.col("language") == "python", _python_paths(first_order)).otherwise(_java_paths(first_order))
    return _exploded(rows, F.filter(found, lambda x: x.isNotNull()))


def use_after_free(corpus: DataFrame, first_order: int) -> DataFrame:
    """Uses of a name after free(name); by line, until the name is assigned.

    Each line that mentions a freed name is an event of (file, name): free, assign or use. A use counts
    if the last event before it that isn't a use is a free. Only events leave the row of a file.
    """
    frees = T.ascii_borders(r"\bfree\s*\(\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\)\s*;")
    assigns = T.ascii_borders(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*=")
    parted = F.transform(F.split("code", "\n", -1), lambda raw, i: F.struct(
        i.alias("i"), raw.alias("raw"), T.trim(raw).alias("line"), F.regexp_extract(T.trim(raw), frees, 1).alias("freed"), F.regexp_extract_all(T.trim(raw), F.lit(assigns), F.lit(1)).alias("written")))
    rows = corpus.where((F.col("language") == "cpp") & F.contains("code", F.lit("free"))).select("file", F.filter(parted, lambda x: (x["line"] != "") & ~x["line"].startswith("//")).alias("lines"))
    rows = rows.select("file", "lines", F.filter(F.array_distinct(F.transform("lines", lambda x: x["freed"])), lambda n: n != "").alias("names"))
    event = lambda x, name, kind: F.struct(x["i"].alias("i"), x["line"].alias("line"), F.call_function("instr", x["raw"], name).alias("column"), name.alias("name"), kind.alias("kind"))
    used = lambda x: F.transform(F.array_intersect("names", T.names_in(x["line"])), lambda n: event(x, n, F.when(F.array_contains(x["written"], n), F.lit("assign")).otherwise(F.lit("use"))))
    # A line that frees is an event of what it frees alone.
    events = F.transform("lines", lambda x: F.when(x["freed"] != "", F.array(event(x, x["freed"], F.lit("free")))).otherwise(used(x)))
    rows = rows.select("file", F.explode(F.flatten(events)).alias("e")).select("file", "e.*")
    own = Window.partitionBy("file", "name")
    state = F.last(F.when(F.col("kind") != "use", F.col("kind")), ignorenulls=True).over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(F.when(F.col("kind") == "free", F.col("i"))).over(own)
    hits = rows.withColumn("state", state).withColumn("since", first).where("kind = 'use' and state = 'free'")
    found = _raw(first_order, "use-after-free", "CWE-416", "high", FREED_MESSAGE, F.col("i") + 1, F.col("column"), F.col("line"), F.col("since"))
    return findings(hits.select("file", found.alias("m")).select("file", "m.*"))


def integer_overflow(corpus: DataFrame, first_order: int, look_back: int = 10) -> DataFrame:
    """Sizes computed with + or *, unless an if in the ``look_back`` lines before bounds every name of the arithmetic.

    Risky lines leave the row of a file with the conditions above them, and nothing else.
    """
    guard = lambda line: F.when(line.startswith("if"), F.nullif(F.regexp_extract(line, T.ascii_borders(r"\bif\s*\((.*)\)\s*\{?"), 1), F.lit("")))
    rows = corpus.where("language = 'cpp'").select("file", F.split("code", "\n", -1).alias("lines"))
    rows = rows.select("file", "lines", F.transform("lines", lambda raw: guard(T.trim(raw))).alias("guards"))
    numbered = F.transform("lines", lambda raw, i: F.struct(i.alias("i"), raw.alias("raw"), T.trim(raw).alias("line")))
    risky = F.filter(numbered, lambda x: (x["line"] != "") & ~x["line"].startswith("//") & T.has(x["line"], RISKY_LINE))
    above = lambda i: F.filter(F.slice("guards", F.greatest(i - look_back + 1, F.lit(1)), F.least(i, F.lit(look_back))), lambda g: g.isNotNull())
    seen = F.transform(risky, lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), F.call_function("instr", x["raw"], x["line"]).alias("column"), above(x["i"]).alias("guards")))
    rows = rows.select("file", F.explode(seen).alias("l")).select("file", "l.*")
    value = F.regexp_extract("line", r"=\s*([^;]+);", 1)
    rows = rows.where(~((value != "") & T.trim(value).rlike(r"^[\d\s+\-*/()]+$")))
    sizes = [r"\bmalloc\s*\(([^)]*)\)", r"\brealloc\s*\([^,]+,\s*([^)]*)\)", r"\bmemcpy\s*\([^,]+,\s*[^,]+,\s*([^)]*)\)"]
    size_of = lambda acc, p: acc.when(T.has(F.col("line"), p), F.regexp_extract("line", T.ascii_borders(p), 1))
    expr = reduce(size_of, sizes, F.when(F.lit(False), F.lit(""))).otherwise(value)
    word = r"[a-zA-Z_][a-zA-Z0-9_]*"
    pairs = F.regexp_extract_all(expr, F.lit(T.ascii_borders(rf"\b{word}\b\s*[+*]\s*\b{word}\b")), F.lit(0))
    names = F.filter(F.array_distinct(F.flatten(F.transform(pairs, T.names_in))), lambda v: ~v.isin(*IGNORED_NAMES))

    def bounded(g: Column, v: Column) -> Column:
        near = rf"(?<![A-Za-z0-9_])({word})\s*(?:<=|<|>=|>)\s*[\w\s/*+\-]+"
        left = F.array_contains(F.regexp_extract_all(g, F.lit(near), F.lit(1)), v)
        right = F.array_contains(F.regexp_extract_all(g, F.lit(rf"[\w\s/*+\-]+\s*(?:<=|<|>=|>)\s*({word})"), F.lit(1)), v)
        return left | right

    rows = rows.withColumn("names", names)
    kept = rows.where(~((F.size("names") > 0) & F.exists("guards", lambda g: F.forall("names", lambda v: bounded(g, v)))))
    found = _raw(first_order, "integer-overflow", "CWE-190", "medium", OVERFLOW_MESSAGE, F.col("i") + 1, F.col("column"), F.col("line"), F.col("i"))
    return findings(kept.select("file", found.alias("m")).select("file", "m.*"))


Rule = Callable[[DataFrame, int], DataFrame]
_more: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    """Register a rule of your own: from (file, code, language) and its order to findings, see ``findings``."""

    def register(run: Rule) -> Rule:
        _more[name] = run
        return run

    return register


def analyze(corpus: DataFrame, credentials: bool = False) -> DataFrame:
    """Findings of all text rules for (file, code), without duplicates removed, plus rule_order and match_order.

    ``credentials`` adds the rule on hard-coded credentials; rules registered by ``rule`` come last.
    """
    rows = corpus.select("file", "code", T.detect_language(F.col("file")).alias("language"))
    first = len(PATTERNS)
    parts = [match_patterns(rows, PATTERNS + BOUNDS), sql_injection(rows, first + 20), path_traversal(rows, first + 21), use_after_free(rows, first + 22), integer_overflow(rows, first + 23)]
    if credentials:
        parts.append(match_patterns(rows, CREDENTIALS, first + 30))
    parts += [run(rows, first + 50 + k) for k, run in enumerate(_more.values())]
    return reduce(DataFrame.unionByName, parts)


def findings_view(spark: SparkSession, table: str, name: str = "findings", **options) -> None:
    """For SQL users: a view ``name`` of the findings of ``table`` (file, code), computed when it is read."""
    analyze(spark.table(table), **options).createOrReplaceTempView(name)


def ordered(findings: DataFrame) -> DataFrame:
    """High severity first, then by line and column; equal places keep the order of rules and matches.

    A sort first reads its input for the borders of its ranges, then sorts it: the shuffle before it keeps the rules from running twice.
    """
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_ORDER.items() for x in kv])[F.col("severity")]
    ties = [c for c in ("rule_order", "match_order") if c in findings.columns]
    return findings.repartition("file", "line").orderBy("file", rank, "line", "column", *ties).select(*FINDING_NAMES)
