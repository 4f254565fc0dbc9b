"""Rules on the facts of a file: sinks that receive outside input, weak algorithms, credentials, sizes, freed memory.

Every rule is an expression over the fact arrays of one row, so all rules run in one pass without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .facts import facts
from .taint import closure, taints

#: Sinks, sources, types and algorithm names.
PATH_SINKS = {
    "python": "open os.open codecs.open io.open send_file send_from_directory os.path.join os.path.abspath os.path.realpath shutil.copy shutil.copyfile shutil.move zipfile.ZipFile tarfile.open pathlib.Path Path".split(),
    "java types": "File FileInputStream FileOutputStream FileReader FileWriter RandomAccessFile ZipFile".split(),
    "java": "Paths.get Path.of Files.newBufferedReader Files.newBufferedWriter Files.newInputStream Files.newOutputStream Files.readAllBytes Files.readAllLines Files.readString Files.write Files.writeString".split(),
}
PATH_SINKS_ANY = ["os.path.join", "os.path.abspath", "os.path.realpath"]
COMMAND_SINKS = "os.system os.popen subprocess.run subprocess.Popen subprocess.call subprocess.check_call subprocess.check_output".split()
C_COMMANDS = (
    "system popen execl execlp execle execv execvp execve execvpe SYSTEM POPEN EXECL EXECLP EXECLE EXECV EXECVP EXECVE "
    "_spawnl _spawnlp _spawnle _spawnlpe _spawnv _spawnvp _spawnve _spawnvpe posix_spawn posix_spawnp SPAWNL SPAWNV SPAWNVP"
).split()
SQL_CALLS = ["execute", "executeQuery", "executeUpdate", "executeBatch", "addBatch"]
SQL_PREPARED = ["prepareStatement", "prepareCall"]
C_UNSAFE_WRITES = ["gets", "strcpy", "strcat", "sprintf", "vsprintf"]
C_INT_TYPES = r"^(int|size_t|ssize_t|long|unsigned|uint32_t|uint64_t|int32_t|int64_t|ptrdiff_t)$"
JAVA_INPUT_TYPES = r"^(String|Object|CharSequence|StringBuilder|StringBuffer)$"
SOURCES = {
    "python": r"\binput\s*\(|\bsys\.argv\b|\brequest\.(args|form|files|values|json|data|get_json|cookies)\b|\brequest\[|\burllib\.parse\.unquote|\bos\.environ\b|\bos\.getenv\s*\(",
    "java": r"\b(getParameter|getHeaders?|getHeaderNames|getQueryString|getPathInfo|getParts?|getCookies|getParameterMap|getParameterValues|getParameterNames)\s*\(|\.(getValue|nextElement|nextLine|readLine)\s*\(|\bargs\s*\[|\bURLDecoder\.decode\s*\(|\bSystem\.(getenv|getProperty)\s*\(",
    "c int": r"\b(atoi|atol|strtol|strtoul|strtoll|strtoull|getenv|rand|rand_r|recv|read|fread|fgets|getchar|getc)\s*\(",
    "c text": r"\b(getenv|getlogin|cuserid|getcwd)\s*\(",
}
WEB_FRAMEWORKS = r"^from\s+(flask|quart|fastapi)$|^import\b.*(?<!\w)(flask|quart|fastapi|django)(?!\w)"
CONTAINER_METHODS = ["add", "addAll", "offer", "push", "put", "putAll", "set", "insert"]
WEAK_HASH = r"\b(md2|md4|md5|MD2|MD4|MD5|ripemd|RIPEMD|sha[-_]?1|SHA[-_]?1)"
WEAK_CIPHER = r"\b(DES|TripleDES|3DES|RC2|RC4|ARC4|Blowfish)"
JAVA_HASH_NAMES = r'(?i)^"(MD2|MD4|MD5|RIPEMD-?160|SHA|SHA-?1|SHA-224)"$'
JAVA_CIPHER_NAMES = r'(?i)^"(DES|RC2|RC4|Blowfish|TripleDES|3DES)(/[^"]*)?"$'
C_HASH_CALLS = r"(?i)^(MD[245]|EVP_md[245]|SHA1?|EVP_sha1?)(_Init|_Update|_Final)?$"
CALG_CIPHERS = ["CALG_3DES", "CALG_3DES_112", "CALG_DES", "CALG_RC2", "CALG_RC4", "CALG_RC5"]
CALG_HASHES = ["CALG_MD5", "CALG_MD4", "CALG_MD2", "CALG_SHA", "CALG_SHA1"]
LIMITS = r"\b((CHAR|SCHAR|UCHAR|SHRT|USHRT|INT|UINT|LONG|ULONG|LLONG|ULLONG|INT8|INT16|INT32|INT64|UINT8|UINT16|UINT32|UINT64|SIZE)_MAX)\b"
CREDENTIAL_NAMES = {
    "python": r"(?i)(password|passwd|pwd|secret|api_key|apikey|token|passphrase|phrase|credential|cred|passcode|_pass\b|key)",
    "java": r"(?i)(password|passwd|pwd|secret|apiKey|api_key|token|passphrase|phrase|credential|cred|passcode|_pass\b|material|fallback|keyBytes|keyData|keyValue|crypto|cipher)",
    "c": r"(?i)(PASSWORD|PASSWD|PWD|SECRET|TOKEN|FALLBACK|KEY|PHRASE|MATERIAL)",
}
CREDENTIAL_CALLS = ["getConnection", "connect", "login", "authenticate"]
KEY_TYPES = ["SecretKeySpec", "PBEKeySpec", "SecretKey", "KerberosKey", "PasswordAuthentication"]

#: Titles; and, in the three lists of rules below, the names, severities and messages of findings.
TITLES = {
    "CWE-22": "Path Traversal", "CWE-78": "OS Command Injection", "CWE-89": "SQL Injection", "CWE-190": "Integer Overflow", "CWE-416": "Use After Free", "CWE-787": "Out-of-bounds Write",
    "CWE-327": "Use of Broken Cryptographic Algorithm", "CWE-328": "Use of Weak Hash", "CWE-259": "Use of Hard-coded Password", "CWE-321": "Use of Hard-coded Cryptographic Key",
}
_HIT = "array<struct<rule:int,cwe:string,ruleId:string,severity:string,message:string,at:bigint,evidence:string>>"


def _sorted_names(*arrays: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(*arrays), lambda n: n.isNotNull() & (n != "")))


def _sources(grammar: str, text: Column) -> Column:
    return T.has(text, SOURCES[grammar])


def _edges(extra: Column | None = None) -> Column:
    own = F.transform(F.filter("assigns", lambda a: a["form"] == "name"), lambda a: F.struct(a["names"].alias("reads"), a["lhs"].alias("writes")))
    return own if extra is None else F.concat(own, extra)


def _scanned(calls: Column) -> Column:
    hit = F.filter(calls, lambda c: c["name"].isin("scanf", "fscanf", "sscanf"))
    return F.flatten(F.transform(hit, lambda c: F.regexp_extract_all(c["text"], F.lit("&([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))))


def _buffers(names: list[str], arg: int) -> Column:
    hit = F.filter("calls", lambda c: c["name"].isin(*names) & (F.get(c["args"], F.lit(arg))["kind"] == "name"))
    return F.transform(hit, lambda c: F.get(c["args"], F.lit(arg))["text"])


def tainted(rows: DataFrame, compat: bool = False) -> DataFrame:
    """``rows`` plus tainted (outside input; integers in C) and tainted_text (C strings): one closure over all edges.

    ``compat`` closes assignments, then containers, then assignments again, so that a name reached last
    doesn't reach a container any more.
    """
    assigned = lambda g: F.transform(F.filter("assigns", lambda a: (a["form"] == "name") & _sources(g, a["text"])), lambda a: a["lhs"])
    web = F.when(F.exists("imports", lambda i: i.rlike(WEB_FRAMEWORKS)), F.array(F.lit("request"))).otherwise(F.array().cast("array<string>"))
    each = F.transform(F.filter("loops", lambda x: (x["form"] == "each") & _sources("python", x["text"])), lambda x: x["name"])
    by_call = lambda c, args: F.struct(F.flatten(F.transform(args, lambda a: a["names"])).alias("reads"), c["recv"].alias("writes"))
    mutators = {"append": -1, "add": -1, "extend": -1, "insert": 1}
    arg = lambda c: F.when(c["method"].isin("update", "setdefault"), c["args"]).when(c["method"] == "insert", F.slice(c["args"], 2, 1)).otherwise(F.slice(c["args"], F.greatest(F.size(c["args"]), F.lit(1)), F.lit(1)))
    py = F.concat(
        F.transform(F.filter("assigns", lambda a: (a["form"] == "item") & (a["base"] != "")), lambda a: F.struct(a["names"].alias("reads"), a["base"].alias("writes"))),
        F.transform(F.filter("calls", lambda c: c["method"].isin(*mutators, "update", "setdefault") & T.is_name(c["recv"]) & (F.size(c["args"]) > F.when(c["method"] == "insert", 1).otherwise(0))), lambda c: by_call(c, arg(c))),
        F.transform(F.filter("loops", lambda x: x["form"] == "each"), lambda x: F.struct(x["names"].alias("reads"), x["name"].alias("writes"))),
    )
    fed = F.filter("calls", lambda c: c["method"].isin(*CONTAINER_METHODS) & T.is_name(c["recv"]))
    java = F.transform(fed, lambda c: by_call(c, c["args"]))
    java_fed = F.transform(F.filter(fed, lambda c: F.exists(c["args"], lambda a: _sources("java", a["text"]))), lambda c: c["recv"])
    typed = lambda rx: F.transform(F.filter("params", lambda p: p["type"].rlike(rx)), lambda p: p["name"])
    seeds = {"python": F.concat(web, assigned("python"), each), "java": F.concat(assigned("java"), typed(JAVA_INPUT_TYPES), *([] if compat else [java_fed])), "c": F.concat(_scanned(F.col("calls")), typed(C_INT_TYPES), assigned("c int"))}
    pick = lambda table: F.when(F.col("grammar") == "python", table["python"]).when(F.col("grammar") == "java", table["java"]).otherwise(table["c"])
    none = F.array().cast("array<struct<reads:array<string>,writes:string>>")
    more = {"python": py, "java": java, "c": none}
    if compat:
        once = closure(_sorted_names(pick(seeds)), _edges())
        known = closure(_sorted_names(once, pick({**seeds, "python": F.array().cast("array<string>"), "java": java_fed, "c": F.array().cast("array<string>")})), pick(more))
        whole = closure(known, _edges())
    else:
        whole = closure(_sorted_names(pick(seeds)), _edges(pick(more)))
    text = closure(_sorted_names(_scanned(F.col("calls")), _buffers(["fgets", "gets"], 0), _buffers(["recv", "read"], 1), assigned("c text")), _edges())
    return rows.withColumn("tainted", whole).withColumn("tainted_text", F.when(F.col("grammar") == "c", text).otherwise(F.array().cast("array<string>")))


def _value_of(name: Column) -> Column:
    """The last assignment to a name in the file."""
    return F.get(F.filter("assigns", lambda a: a["last"] & (a["lhs"] == name)), F.lit(0))


def _built_sql(text: Column, kind: Column, names: Column, language: str) -> Column:
    """A query that is put together from parts, or has outside input in it."""
    sql = F.regexp_like(F.lower(text), F.lit(T.ascii_borders(r"\b(select|insert|update|delete)\b")))
    bad = taints(names, F.col("tainted"))
    if language == "python":
        built = F.when(kind == "text", text.rlike("(?i)^f[\"']")).otherwise(bad | kind.isin("binary", "joined") | text.rlike(r"\.format\s*\(|%"))
    else:
        built = F.when(kind == "text", F.lit(False)).otherwise(bad | ((kind == "binary") & F.contains(text, F.lit("+"))) | text.rlike(r"String\.format\s*\("))
    return sql & built


def unsafe_queries(rows: DataFrame) -> DataFrame:
    """``rows`` plus unsafe_sql: names whose last value is an unsafe query, or a name of which that is true, and so on."""
    value = F.filter("assigns", lambda a: a["last"])
    built = lambda a: F.when(F.col("grammar") == "python", _built_sql(a["text"], a["kind"], a["names"], "python")).otherwise(_built_sql(a["text"], a["kind"], a["names"], "java"))
    bad = lambda a: F.when(a["kind"] == "name", taints(a["names"], F.col("tainted"))).otherwise(F.coalesce(built(a), F.lit(False)))
    seeds = F.transform(F.filter(value, bad), lambda a: a["lhs"])
    edges = F.transform(F.filter(value, lambda a: a["kind"] == "name"), lambda a: F.struct(F.array(a["text"]).alias("reads"), a["lhs"].alias("writes")))
    return rows.withColumn("unsafe_sql", F.when(F.col("grammar") == "c", F.array().cast("array<string>")).otherwise(closure(seeds, edges)))


def _unsafe_sql(arg: Column, language: str) -> Column:
    """An argument that is a query built from parts; a name stands for its last value, through any number of names."""
    by_name = taints(arg["names"], F.col("tainted")) | F.array_contains("unsafe_sql", arg["text"])
    return F.when(arg["kind"] == "name", by_name).otherwise(_built_sql(arg["text"], arg["kind"], arg["names"], language))


def _hits(order: int, items: Column | str, keep, cwe, rule: str, severity: str, message, at, evidence) -> Column:
    """Findings of the items that ``keep``; cwe, message, at and evidence are functions of an item or constants."""
    of = lambda f, x: f(x) if callable(f) else F.lit(f)
    made = F.transform(F.filter(items, lambda x: F.coalesce(keep(x), F.lit(False))), lambda x: F.struct(
        F.lit(order).alias("rule"), of(cwe, x).alias("cwe"), F.lit(rule).alias("ruleId"), F.lit(severity).alias("severity"), of(message, x).alias("message"), of(at, x).alias("at"), F.substring(of(evidence, x), 1, 120).alias("evidence")))
    return made.cast(_HIT)


def _twice(hits: Column) -> Column:
    """Weak hashes count as both CWE-327 and CWE-328."""
    return F.flatten(F.transform(hits, lambda h: F.array(h, h.withField("cwe", F.lit("CWE-328")))))


def _say(fmt: str, field: str = "name"):
    return lambda c: F.format_string(fmt, c[field])


def _python() -> list[Column]:
    dirty = lambda a: taints(a["names"], F.col("tainted")) | _sources("python", a["text"])
    checked = lambda c: F.when(c["name"].isin(*PATH_SINKS_ANY), c["args"]).otherwise(F.slice(c["args"], 1, 1))
    first = lambda c: F.get(F.filter(checked(c), dirty), F.lit(0))
    arg0 = lambda c: F.get(c["args"], F.lit(0))
    wrapped = r"(?s)^(text|literal|sql)\s*\((.*)\)$"
    inner = lambda a: F.when(a["text"].rlike(wrapped), a.withField("text", T.trim(F.regexp_extract(a["text"], wrapped, 2))).withField("kind", F.when(F.regexp_extract(a["text"], wrapped, 2).rlike("""^\\s*[fF]?["'][^"']*["']\\s*$"""), F.lit("text")).when(T.is_name(F.regexp_extract(a["text"], wrapped, 2)), F.lit("name")).otherwise(F.lit("binary")))).otherwise(a)
    resolved = lambda a: F.when(a["kind"] == "name", F.coalesce(_value_of(a["text"])["text"], a["text"])).otherwise(a["text"])
    weak = lambda rx: lambda c: T.has(c["name"], rx) | F.exists(c["args"], lambda a: T.has(resolved(a), rx))
    secret = lambda a: F.when(F.lower(a["lhs"]).rlike("key|secret|token"), F.lit("CWE-321")).otherwise(F.lit("CWE-259"))
    return [
        _hits(0, "divisions", dirty, "CWE-22", "ast-path-traversal", "high", "pathlib path join with user-controlled input may allow path traversal.", lambda d: d["at"], lambda d: d["text"]),
        _hits(1, "calls", lambda c: c["name"].isin(*PATH_SINKS["python"]) & first(c).isNotNull(), "CWE-22", "ast-path-traversal", "high", _say("%s() receives user-controlled path without validation."), lambda c: first(c)["at"], lambda c: first(c)["text"]),
        _hits(2, "calls", lambda c: c["name"].isin(*COMMAND_SINKS) & (arg0(c)["kind"] != "list") & dirty(arg0(c)), "CWE-78", "ast-cmd-injection", "high", _say("%s() receives user-controlled input."), lambda c: arg0(c)["at"], lambda c: arg0(c)["text"]),
        _hits(3, "calls", lambda c: c["name"].endswith(".execute") & _unsafe_sql(inner(arg0(c)), "python"), "CWE-89", "ast-sqli", "high", "SQL query is constructed with user-controlled input.", lambda c: arg0(c)["at"], lambda c: inner(arg0(c))["text"]),
        _twice(_hits(4, "calls", weak(WEAK_HASH), "CWE-327", "ast-weak-hash", "medium", _say("%s() uses a weak hashing algorithm."), lambda c: c["at"], lambda c: c["text"])),
        _hits(5, "calls", weak(WEAK_CIPHER), "CWE-327", "ast-weak-cipher", "medium", _say("%s() uses a broken or weak cipher."), lambda c: c["at"], lambda c: c["text"]),
        _hits(6, "assigns", lambda a: T.has(a["lhs"], CREDENTIAL_NAMES["python"]) & ~a["grown"] & (a["kind"] == "text") & (F.char_length(a["text"]) > 5), secret, "ast-hardcoded-cred", "high", _say("Hard-coded credential assigned to '%s'.", "lhs"), lambda a: a["at"], lambda a: a["text"]),
    ]


def _java() -> list[Column]:
    dirty = lambda a: taints(a["names"], F.col("tainted")) | _sources("java", a["text"])
    first = lambda c: F.get(F.filter(c["args"], dirty), F.lit(0))
    arg0 = lambda c: F.get(c["args"], F.lit(0))
    last = lambda c: F.try_element_at(c["args"], F.lit(-1))
    any_dirty = lambda c: F.exists(c["args"], dirty)
    at, text = (lambda c: c["at"]), (lambda c: c["text"])
    called = lambda c: ~c["made"]
    literal = F.array_distinct(F.transform(F.filter("assigns", lambda a: (a["form"] == "name") & (((a["kind"] == "text") & (F.char_length(a["text"]) > 5)) | (a["kind"] == "bytes of text"))), lambda a: a["lhs"]))
    fixed = lambda a: ((a["kind"] == "text") & (F.char_length(a["text"]) > 5)) | ((a["kind"] == "name") & F.array_contains(literal, a["text"]))
    of_bytes = r"^(\"[^\"]{4,}\"|[A-Za-z_]\w*)\s*\.\s*(getBytes|toCharArray)\s*\("
    material = lambda a: fixed(a) | (a["text"].rlike(of_bytes) & (a["text"].startswith('"') | F.array_contains(literal, F.regexp_extract(a["text"], of_bytes, 1))))
    secret = lambda a: F.when(a["lhs"].rlike("(?i)key|secret|token"), F.lit("CWE-321")).otherwise(F.lit("CWE-259"))
    stored = lambda c: F.when(arg0(c)["text"].rlike("(?i)key|secret|token|material|cipher|crypto"), F.lit("CWE-321")).otherwise(F.lit("CWE-259"))
    got = lambda c: called(c) & (c["method"] == "getInstance")
    named = lambda rx: lambda c: called(c) & (c["method"] != "getInstance") & T.has(c["name"], rx)
    return [
        _hits(0, "calls", lambda c: c["made"] & c["name"].isin(*PATH_SINKS["java types"]) & first(c).isNotNull(), "CWE-22", "ast-path-traversal", "high", _say("new %s() receives user-controlled path."), lambda c: first(c)["at"], lambda c: first(c)["text"]),
        _twice(_hits(1, "calls", lambda c: c["made"] & T.has(c["name"], WEAK_HASH), "CWE-327", "ast-weak-hash", "medium", _say("new %s() uses a weak hashing algorithm (MD5/SHA1)."), at, text)),
        _hits(2, "calls", lambda c: c["made"] & T.has(c["name"], WEAK_CIPHER), "CWE-327", "ast-weak-cipher", "medium", _say("new %s() uses a broken or weak cipher."), at, text),
        _hits(3, "calls", lambda c: c["made"] & (c["name"] == "ProcessBuilder") & dirty(arg0(c)), "CWE-78", "ast-cmd-injection", "high", _say("new %s() receives user-controlled command."), at, text),
        _hits(4, "calls", lambda c: called(c) & c["name"].isin(*PATH_SINKS["java"]) & any_dirty(c), "CWE-22", "ast-path-traversal", "high", _say("%s() receives user-controlled path."), at, text),
        _hits(5, "calls", lambda c: called(c) & (c["method"] == "resolve") & any_dirty(c), "CWE-22", "ast-path-traversal", "high", "Path.resolve() receives user-controlled input.", at, text),
        _hits(6, "calls", lambda c: called(c) & c["method"].isin(*SQL_CALLS) & _unsafe_sql(arg0(c), "java"), "CWE-89", "ast-sqli", "high", "SQL query constructed with user-controlled input.", lambda c: arg0(c)["at"], lambda c: arg0(c)["text"]),
        _hits(7, "calls", lambda c: called(c) & c["method"].isin(*SQL_PREPARED) & _unsafe_sql(arg0(c), "java"), "CWE-89", "ast-sqli", "high", _say("%s() called with user-controlled SQL query.", "method"), lambda c: arg0(c)["at"], lambda c: arg0(c)["text"]),
        _twice(_hits(8, "calls", lambda c: got(c) & arg0(c)["text"].rlike(JAVA_HASH_NAMES), "CWE-327", "ast-weak-hash", "medium", lambda c: F.format_string("getInstance(%s) uses a weak hash algorithm (MD5/SHA-1).", arg0(c)["text"]), at, text)),
        _hits(9, "calls", lambda c: got(c) & arg0(c)["text"].rlike(JAVA_CIPHER_NAMES), "CWE-327", "ast-weak-cipher", "medium", lambda c: F.format_string("getInstance(%s) uses a broken or weak cipher.", arg0(c)["text"]), at, text),
        _twice(_hits(10, "calls", named(WEAK_HASH), "CWE-327", "ast-weak-hash", "medium", _say("%s() uses a weak hashing algorithm (MD5/SHA1)."), at, text)),
        _hits(11, "calls", named(WEAK_CIPHER), "CWE-327", "ast-weak-cipher", "medium", _say("%s() uses a broken or weak cipher."), at, text),
        _hits(12, "calls", lambda c: called(c) & (c["method"] == "exec") & any_dirty(c), "CWE-78", "ast-cmd-injection", "high", "Runtime.exec() receives user-controlled input.", at, text),
        _hits(13, "assigns", lambda a: a["made"] & T.has(a["lhs"], CREDENTIAL_NAMES["java"]) & (((a["kind"] == "text") & (F.char_length(a["text"]) > 5)) | (a["kind"] == "bytes of text")), secret, "ast-hardcoded-cred", "high", _say("Hard-coded credential assigned to '%s'.", "lhs"), lambda a: a["at"], lambda a: a["text"]),
        _hits(14, "calls", lambda c: called(c) & c["method"].isin(*CREDENTIAL_CALLS) & fixed(last(c)), "CWE-259", "ast-hardcoded-cred", "high", _say("Hard-coded password passed to %s().", "method"), lambda c: last(c)["at"], lambda c: last(c)["text"]),
        _hits(15, "calls", lambda c: called(c) & (c["method"] == "put") & (arg0(c)["kind"] == "text") & T.has(arg0(c)["text"], CREDENTIAL_NAMES["java"]) & fixed(F.get(c["args"], F.lit(1))), stored, "ast-hardcoded-cred", "high", lambda c: F.format_string("Hard-coded credential value stored under key %s.", arg0(c)["text"]), lambda c: F.get(c["args"], F.lit(1))["at"], lambda c: F.get(c["args"], F.lit(1))["text"]),
        _hits(16, "calls", lambda c: c["made"] & c["name"].isin(*KEY_TYPES) & F.exists(c["args"], material), "CWE-321", "ast-hardcoded-cred", "high", _say("Hard-coded key material passed to %s."), lambda c: arg0(c)["at"], lambda c: arg0(c)["text"]),
    ]


def _c(compat: bool) -> list[Column]:
    ints, strings = F.col("tainted"), F.col("tainted_text")
    arg = lambda c, i: F.get(c["args"], F.lit(i))
    at, text = (lambda x: x["at"]), (lambda x: x["text"])
    guarded = lambda x, names: F.exists(x["guards"], lambda g: g.rlike("INT_MAX|UINT_MAX|INT_MIN|SIZE_MAX") & F.arrays_overlap(T.names_in(g), names))
    free = lambda x, names: ~F.coalesce(guarded(x, names), F.lit(False))
    literal = lambda a: a["kind"].isin("text", "joined") & a["text"].rlike('^(L|u8|u|U)?"')
    constant = lambda a: (a["kind"] == "number") | ((a["kind"] == "name") & a["text"].rlike("^[A-Z_][A-Z0-9_]*$"))
    open_arg = lambda a: a.isNotNull() & ~literal(a) & ~constant(a)
    shell = lambda c: F.lower(c["name"]).isin("system", "popen")
    command = lambda c: open_arg(arg(c, 0)) & (~F.array_contains(strings, arg(c, 0)["text"]) if compat else F.lit(True))
    program = lambda c: F.when(c["name"].startswith("_spawn"), arg(c, 1)).otherwise(arg(c, 0))
    ran = lambda c: F.exists(c["args"], lambda a: taints(a["names"], strings) | taints(a["names"], ints)) | open_arg(program(c))
    sized = lambda c: F.when(c["name"].isin("malloc", "calloc"), arg(c, 0)).when(c["name"] == "realloc", arg(c, 1)).when(c["name"].isin("memcpy", "memmove", "memset"), arg(c, 2))
    limit = F.transform(F.filter("assigns", lambda a: (a["form"] == "name") & T.has(a["text"], LIMITS)), lambda a: a["lhs"])
    met = lambda a: F.get(F.array_intersect(a["names"], limit), F.lit(0))
    secret = lambda m: F.when(m["name"].rlike("(?i)KEY|SECRET|TOKEN"), F.lit("CWE-321")).otherwise(F.lit("CWE-259"))
    # What comes next of the same name after a free: a use or another free is reported, an assignment ends it.
    freed = F.transform(F.filter("events", lambda e: e["kind"] == "free"), lambda e: e if compat else F.array_min(F.transform(F.filter("events", lambda n: (n["name"] == e["name"]) & (n["at"] > e["at"])), lambda n: F.struct(n["at"].alias("at"), n["name"].alias("name"), n["kind"].alias("kind")))))
    write, medium, high = "ast-oob-write", "medium", "high"
    over = "ast-integer-overflow"
    return [
        _hits(0, "assigns", lambda a: ~a["grown"] & (a["form"].isin("name", "item", "pointer", "other")) & a["arith"] & taints(a["names"], ints) & free(a, a["names"]), "CWE-190", over, medium, "Arithmetic on user-controlled integer may overflow.", at, text),
        _hits(1, "steps", lambda s: F.array_contains(ints, s["name"]) & free(s, F.array(s["name"])), "CWE-190", over, medium, _say("Increment/decrement of user-controlled integer '%s' may overflow."), at, text),
        _hits(2, "assigns", lambda a: a["grown"] & (a["form"] == "name") & F.array_contains(ints, a["lhs"]) & free(a, F.array(a["lhs"])), "CWE-190", over, medium, _say("Augmented arithmetic on user-controlled integer '%s' may overflow.", "lhs"), lambda a: a["place"], lambda a: F.concat_ws(" ", a["lhs"], a["text"])),
        _hits(3, "calls", lambda c: c["name"].isin(*C_UNSAFE_WRITES), "CWE-787", write, high, _say("%s() does not perform bounds checking and may write past a buffer."), at, text),
        _hits(4, "calls", lambda c: c["name"].isin("scanf", "fscanf", "sscanf") & F.exists(c["args"], lambda a: F.contains(a["text"], F.lit("%s"))), "CWE-787", write, high, _say("%s() with %%s format specifier may write past buffer bounds."), at, text),
        _hits(5, "calls", lambda c: (c["name"] == "strncpy") & arg(c, 2)["text"].rlike(r"^strlen\s*\("), "CWE-787", write, high, "strncpy() with strlen() as size copies based on source length, not destination size.", at, text),
        _hits(6, "calls", lambda c: c["name"].isin(*C_COMMANDS) & shell(c) & command(c), "CWE-78", "ast-cmd-injection", high, _say("%s() receives a non-literal command argument."), at, text),
        _hits(7, "calls", lambda c: c["name"].isin(*C_COMMANDS) & ~shell(c) & (F.size(c["args"]) > 0) & ran(c), "CWE-78", "ast-cmd-injection", high, _say("%s() receives user-controlled argument."), at, text),
        _hits(8, "calls", lambda c: sized(c)["arith"] & free(c, sized(c)["names"]), "CWE-190", over, medium, _say("%s() size argument contains arithmetic that may overflow."), lambda c: sized(c)["at"], lambda c: sized(c)["text"]),
        _twice(_hits(9, "calls", lambda c: c["name"].rlike(C_HASH_CALLS), "CWE-327", "ast-weak-hash", medium, _say("%s() uses a weak hashing algorithm (MD5/SHA1)."), at, text)),
        _hits(10, "calls", lambda c: c["name"].isin("CryptDeriveKey", "CryptEncrypt", "CryptDecrypt") & arg(c, 1)["text"].isin(*CALG_CIPHERS), "CWE-327", "ast-weak-wincrypt-cipher", medium, lambda c: F.format_string("%s() uses %s, a weak or broken cipher.", c["name"], arg(c, 1)["text"]), lambda c: arg(c, 1)["at"], lambda c: arg(c, 1)["text"]),
        _twice(_hits(11, "calls", lambda c: (c["name"] == "CryptCreateHash") & arg(c, 1)["text"].isin(*CALG_HASHES), "CWE-327", "ast-weak-wincrypt-hash", medium, lambda c: F.format_string("CryptCreateHash() uses %s, a weak hashing algorithm.", arg(c, 1)["text"]), lambda c: arg(c, 1)["at"], lambda c: arg(c, 1)["text"])),
        _hits(12, "assigns", lambda a: (a["form"] == "item") & taints(a["index"], ints) & free(a, a["index"]), "CWE-787", write, high, "Array write uses user-controlled index without bounds check.", lambda a: a["place"], lambda a: a["lhs"]),
        _hits(13, "assigns", lambda a: (a["form"] == "pointer") & taints(a["index"], ints) & free(a, a["index"]), "CWE-787", write, high, "Pointer write uses user-controlled offset without bounds check.", lambda a: a["place"], lambda a: a["lhs"]),
        _hits(14, "loops", lambda x: x["writes"] & taints(x["names"], ints), "CWE-787", write, high, "Loop with user-controlled bound writes to array without bounds check.", at, text),
        _hits(15, freed, lambda e: e.isNotNull() & (F.lit(compat) | (e["kind"] != "assign")), "CWE-416", "ast-use-after-free", high, _say("Pointer '%s' is used after being freed."), at, lambda e: e["name"]),
        _hits(16, "macros", lambda m: T.has(m["name"], CREDENTIAL_NAMES["c"]) & m["text"].rlike('^(L|u|U)?"') & (F.char_length(m["text"]) > 5), secret, "ast-hardcoded-cred", high, _say("Hard-coded credential in macro '%s'."), at, text),
        _hits(17, "assigns", lambda a: a["arith"] & met(a).isNotNull(), "CWE-190", over, medium, lambda a: F.format_string("Arithmetic on '%s' (assigned a boundary constant) may overflow.", met(a)), at, text),
    ]


def analyze_structure(corpus: DataFrame, compat: bool = False) -> DataFrame:
    """Findings of all structure rules for (file, code), plus rule_order and match_order. One pass, no shuffle.

    Defaults fix known faults of such analyzers: a freeing call isn't a use of its own argument, a
    tainted string does reach a shell, C++ suffixes count. ``compat`` brings the faults back.
    """
    rows = unsafe_queries(tainted(facts(corpus, compat), compat))
    hits = F.when(F.col("grammar") == "python", F.flatten(F.array(*_python()))).when(F.col("grammar") == "java", F.flatten(F.array(*_java()))).otherwise(F.flatten(F.array(*_c(compat))))
    found = rows.select("file", F.posexplode(hits).alias("n", "h"))
    title = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[F.col("h.cwe")]
    return found.select(
        F.col("h.cwe").alias("cweId"), F.col("h.ruleId").alias("ruleId"), title.alias("vulnerability"), F.col("h.severity").alias("severity"), F.col("h.message").alias("message"), "file",
        F.shiftright("h.at", 32).cast("int").alias("line"), F.col("h.at").bitwiseAND(2**32 - 1).cast("int").alias("column"), F.col("h.evidence").alias("evidence"), F.col("h.rule").alias("rule_order"), F.col("n").alias("match_order"),
    )
