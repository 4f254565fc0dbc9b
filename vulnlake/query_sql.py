"""The registered queries of the detection and evaluation operators in SQL, for DuckDB."""

from __future__ import annotations

from .operators import rules
from .samples import SNIPPETS, TRUE_CWE, corpus_sql


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LANGUAGE_SQL = r"CASE WHEN regexp_matches(lower(file), '\.(c|cpp|cc|cxx|h|hpp)$') THEN 'cpp' WHEN lower(file) LIKE '%.java' THEN 'java' WHEN lower(file) LIKE '%.py' THEN 'python' ELSE 'unknown' END"


def _matches(regex: str, where: str, group: int = 0) -> str:
    """Rows (file, code, n, hit, arg, pos) of all matches in files of the corpus; n and pos from 0."""
    rx = _lit(regex)
    return f"""SELECT file, code, k - 1 AS n, hits[k] AS hit, args[k] AS arg,
    CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS pos
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (
    SELECT file, code, regexp_extract_all(code, {rx}) AS hits, regexp_extract_all(code, {rx}, {group}) AS args, regexp_split_to_array(code, {rx}) AS gaps FROM corpus WHERE {where}))"""


#: Line and column of pos in code.
_PLACE = """length(substr(code, 1, pos)) - length(replace(substr(code, 1, pos), chr(10), '')) + 1 AS line, length(list_last(string_split(substr(code, 1, pos), chr(10)))) + 1 AS "column\""""


def _found(patterns: list[rules.Pattern]) -> str:
    """Rows (file, ruleId, cweId, severity, line, column, evidence, message) of the rule table."""
    parts = []
    for p in patterns:
        unless = "true"
        if p.unless is rules._plain_argument:
            unless = "NOT regexp_matches(substr(code, pos + length(hit) + 1), " + _lit(r"""^\s*(\[|["'][^"']*["'])""") + ")"
        elif p.unless is rules._literal_source:
            unless = "NOT coalesce(regexp_matches(trim(string_split(regexp_extract(hit, " + _lit(r"\(([^)]*)\)") + ", 1), ',')[2], chr(32) || chr(9) || chr(13) || chr(10)), " + _lit('^L?"[^"]*"$') + "), false)"
        elif p.unless is rules._names_a_key:
            unless = "NOT regexp_matches(lower(regexp_extract(hit, '^[^=\"]*')), 'key|secret|token')"
        parts.append(f"""SELECT file, {_lit(p.rule)} AS "ruleId", {_lit(p.cwe)} AS "cweId", {_lit(p.severity)} AS severity, {_PLACE}, hit AS evidence, {_lit(p.message)} AS message
FROM ({_matches(p.regex, f"{_LANGUAGE_SQL} = {_lit(p.language)}")}) WHERE {unless}""")
    return "\nUNION ALL\n".join(parts)


_SHOWN = 'file, "ruleId", "cweId", severity, line, "column", evidence'


def _patterns_sql(patterns: list[rules.Pattern]) -> str:
    return f"WITH {corpus_sql()}, found AS (\n{_found(patterns)}\n)\nSELECT {_SHOWN} FROM found"


_SPACES = "chr(32) || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)"
_LINES = f"""lines AS (
  SELECT file, k - 1 AS i, ls[k] AS raw, trim(ls[k], {_SPACES}) AS line,
         CAST(coalesce(list_sum(list_transform(ls[1:k - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS "offset"
  FROM (SELECT file, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT file, string_split(code, chr(10)) AS ls FROM corpus))
)"""

# --- SQL injection, path traversal, use after free, integer overflow ------------------------------

_NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
_PY, _JAVA = f"{_LANGUAGE_SQL} = 'python'", f"{_LANGUAGE_SQL} = 'java'"


def _trim(text: str) -> str:
    return f"trim({text}, {_SPACES})"


def _unsafe_text(text: str) -> str:
    """A statement put together from parts, by the language ``py``."""
    py = _lit(r"""\bf["'`]|\.format\s*\(|["'][^"']*%[sd][^"']*["']\s*%|["'][^"']*["']\s*\+|\+\s*[a-zA-Z_][a-zA-Z0-9_]*""")
    java = _lit(r'\bString\s*\.\s*format\s*\(|"[^"]*"\s*\+|\+\s*[a-zA-Z_][a-zA-Z0-9_]*')
    return rf"coalesce(regexp_matches(lower({text}), '\b(select|insert|update|delete)\b') AND CASE WHEN py THEN regexp_matches({text}, {py}) ELSE regexp_matches({text}, {java}) END, false)"


#: The first of several arguments that no bracket precedes.
_FIRST_ARG = _lit(r"""^((?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^,'"()\[\]{}])*),\s*\S""")
_SQLI = rf"""sql_calls AS (
  SELECT true AS py, file, code, n, hit, {_trim("arg")} AS args, pos FROM ({_matches(rf"\b{_NAME}\.execute\s*\(([\s\S]*?)\)", _PY, 1)})
  UNION ALL
  SELECT false, file, code, n, hit, {_trim("arg")}, pos FROM ({_matches(rf"\b{_NAME}\.(?:executeQuery|executeUpdate|execute)\s*\(([\s\S]*?)\)", _JAVA, 1)})
), sql_assigns AS (
  SELECT file, pos, hit, regexp_extract(hit, '^(?:String\s+)?({_NAME})\s*=', 1) AS name FROM (
    {_matches(rf"\b{_NAME}\s*=\s*[^\n]+", _PY)}
    UNION ALL
    {_matches(rf"(?:String\s+)?\b{_NAME}\b\s*=\s*[^;\n]+", _JAVA)})
), sql_last AS (
  SELECT c.file, c.n, max(a.pos) AS spot, arg_max(substr(a.hit, 1, c.pos - a.pos), a.pos) AS assigned
  FROM sql_calls c JOIN sql_assigns a ON c.file = a.file AND c.args = a.name AND a.pos < c.pos
  WHERE regexp_matches(substr(a.hit, 1, c.pos - a.pos), CASE WHEN c.py THEN '=\s*[^\n]' ELSE '=\s*[^;\n]' END) GROUP BY c.file, c.n
), sql_judged AS (
  SELECT c.*, l.spot, l.assigned, regexp_extract(l.assigned, '=\s*([\s\S]*)$', 1) AS value FROM sql_calls c LEFT JOIN sql_last l ON c.file = l.file AND c.n = l.n
), sql_unsafe AS (
  SELECT *, {_unsafe_text("args")} AS inlined, assigned IS NOT NULL AND {_unsafe_text("value")} AS varied FROM sql_judged
  WHERE NOT CASE WHEN py THEN regexp_matches(args, {_FIRST_ARG}) AND regexp_matches(regexp_extract(args, {_FIRST_ARG}, 1), '%s|\?') ELSE contains(args, '?') OR coalesce(contains(value, '?'), false) END
), sqli AS (
  SELECT file, CASE WHEN py THEN 'python' ELSE 'java' END || CASE WHEN inlined THEN '-sqli-inline' ELSE '-sqli-variable' END AS "ruleId", 'CWE-89' AS "cweId", 'high' AS severity, {_PLACE}, evidence, message
  FROM (SELECT file, code, py, inlined, CASE WHEN inlined THEN pos ELSE spot END AS pos, CASE WHEN inlined THEN hit ELSE assigned END AS evidence,
               CASE WHEN inlined THEN {_lit(rules.INLINE_SQL_MESSAGE)} ELSE replace({_lit(rules.VARIABLE_SQL_MESSAGE)}, '%s', args) END AS message FROM sql_unsafe WHERE inlined OR varied)
)"""

_CONSTANT = r"""(?m)^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*["'][^"'\r\n]*["'][ \t\r]*$"""
_JAVA_CONSTANT = r"""\bString\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*["'][^"']*["']\s*;"""
_TAINT = rf"""assigned AS (
  SELECT file, py, regexp_extract(hit, '^\s*(?:(?:String|Path|File)\s+)?({_NAME})\s*=', 1) AS writes, regexp_extract(hit, '=\s*([\s\S]*)$', 1) AS value FROM (
    SELECT true AS py, file, hit FROM ({_matches(rf"(?m)^\s*{_NAME}\s*=\s*[^\r\n]+", _PY)})
    UNION ALL
    SELECT false, file, hit FROM ({_matches(rf"(?m)^\s*(?:(?:String|Path|File)\s+)?{_NAME}\s*=\s*[^\r\n]+;", _JAVA)}))
), reads AS (SELECT DISTINCT file, writes, unnest(regexp_extract_all(value, '{_NAME}')) AS name FROM assigned),
seeds AS (
  SELECT file, writes AS name FROM assigned WHERE CASE WHEN py THEN regexp_matches(value, {_lit(rules.USER_INPUT["python"])}) ELSE regexp_matches(value, {_lit(rules.USER_INPUT["java"])}) END
  {" ".join(f"UNION ALL SELECT file, unnest(regexp_extract_all(code, {_lit(p)}, 1)) FROM corpus WHERE {_JAVA}" for p in rules.JAVA_SEEDS)}
), dirty AS (SELECT file, name FROM seeds UNION SELECT r.file, r.writes FROM dirty d JOIN reads r ON d.file = r.file AND d.name = r.name),
known AS (
  SELECT c.file, coalesce(list_sort(list(DISTINCT d.name) FILTER (d.name IS NOT NULL)), []) AS tainted, any_value(c.constants) AS constants
  FROM (
    SELECT file, list_sort(list_distinct(CASE WHEN {_PY} THEN regexp_extract_all(code, {_lit(_CONSTANT)}, 1) ELSE regexp_extract_all(code, {_lit(_JAVA_CONSTANT)}, 1) END)) AS constants
    FROM corpus WHERE {_PY} OR {_JAVA}
  ) c LEFT JOIN dirty d ON c.file = d.file GROUP BY c.file
)"""


def _verdict(python: bool) -> tuple[str, str]:
    """(clearly safe, dangerous) of the arguments ``arg`` of a path sink, beside ``tainted`` and ``constants``."""
    inner = r"^os\.path\.join\s*\((.*)\)$" if python else r"^(?:Paths\.get|Path\.of)\s*\((.*)\)$"
    joins = r"os\.path\.join\s*\(" if python else r"Paths\.get\s*\(|Path\.of\s*\("
    literal = lambda x: f"""regexp_matches({x}, '^("[^"]*"|''[^'']*'')$')"""
    constant = lambda x: f"(regexp_matches({x}, '^{_NAME}$') AND list_contains(constants, {x}))"
    parts = f"list_transform(string_split(regexp_extract(arg, {_lit(inner)}, 1), ','), lambda x: {_trim('x')})"
    each = lambda test: f"(regexp_matches(arg, {_lit(inner)}) AND list_bool_and(list_transform({parts}, lambda p: {test})))"
    climbs = r"(contains(arg, '../') OR contains(arg, '..\'))"
    dirty = f"regexp_matches(arg, {_lit(rules.USER_INPUT['python' if python else 'java'])})"
    safe = f"(NOT {climbs} AND ({literal('arg')} OR {constant('arg')} OR {each(literal('p'))}))"
    bad = f"({climbs} OR {dirty} OR (NOT {constant('arg')} AND (list_has_any(regexp_extract_all(arg, '{_NAME}'), tainted) OR (regexp_matches(arg, {_lit(joins)}) AND NOT {each(literal('p') + ' OR ' + constant('p'))}))))"
    return safe, bad


_SINKS = ", ".join(f"({i}, {_lit(chr(92) + 'b' + s.replace('.', chr(92) + '.') + r'\s*\(([^\r]*)\)')})" for i, s in enumerate(rules.PYTHON_PATH_SINKS))
_PATHS = rf"""sinks(number, rx) AS (VALUES {_SINKS}),
tried AS (
  SELECT l.file, i, line AS evidence, number, length(regexp_split_to_array(raw, rx)[1]) + 1 AS "column", {_trim("regexp_extract(raw, rx, 1)")} AS arg, tainted, constants
  FROM lines l JOIN known k ON l.file = k.file JOIN sinks ON regexp_matches(raw, rx) WHERE l.file LIKE '%.py' AND line <> '' AND line NOT LIKE '#%'
), java_sinks AS (
  {" UNION ALL ".join(f"SELECT file, code, pos, hit, {_trim('arg')} AS arg FROM ({_matches(p, _JAVA, 1)})" for p in rules.JAVA_PATH_SINKS)}
), paths AS (
  SELECT file, 'path-traversal' AS "ruleId", 'CWE-22' AS "cweId", 'high' AS severity, i + 1 AS line, "column", evidence, {_lit(rules.PATH_MESSAGE)} AS message
  FROM (SELECT *, {_verdict(True)[1]} AS bad FROM tried WHERE arg <> '' AND NOT {_verdict(True)[0]} QUALIFY row_number() OVER (PARTITION BY file, i ORDER BY number) = 1) WHERE bad
  UNION ALL
  SELECT file, 'path-traversal', 'CWE-22', 'high', {_PLACE}, hit, {_lit(rules.JAVA_PATH_MESSAGE)}
  FROM java_sinks JOIN known USING (file) WHERE arg <> '' AND NOT {_verdict(False)[0]} AND {_verdict(False)[1]}
)"""

_FREED = rf"""c AS (
  SELECT *, regexp_extract(line, '\bfree\s*\(\s*({_NAME})\s*\)\s*;', 1) AS freed FROM lines WHERE file LIKE '%.c' AND line <> '' AND line NOT LIKE '//%'
), n AS (SELECT DISTINCT file, freed AS name FROM c WHERE freed <> ''), e AS (
  SELECT c.*, name, CASE WHEN freed <> '' THEN 'free' WHEN regexp_matches(line, '\b' || name || '\s*=') THEN 'assign' ELSE 'use' END AS kind
  FROM c JOIN n USING (file) WHERE freed = name OR (freed = '' AND regexp_matches(line, '\b' || name || '\b'))
), s AS (SELECT *, last_value(CASE WHEN kind <> 'use' THEN kind END IGNORE NULLS) OVER (PARTITION BY file, name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM e),
freed AS (SELECT file, 'use-after-free' AS "ruleId", 'CWE-416' AS "cweId", 'high' AS severity, i + 1 AS line, CAST(instr(raw, name) AS BIGINT) AS "column", line AS evidence, {_lit(rules.FREED_MESSAGE)} AS message FROM s WHERE kind = 'use' AND state = 'free')"""

_OVERFLOW = rf"""guarded AS (
  SELECT *, list(CASE WHEN line LIKE 'if%' THEN nullif(regexp_extract(line, '\bif\s*\((.*)\)\s*\{{?', 1), '') END) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS guards FROM lines WHERE file LIKE '%.c'
), risky AS (
  SELECT *, regexp_extract(line, '=\s*([^;]+);', 1) AS value FROM guarded WHERE line <> '' AND line NOT LIKE '//%' AND regexp_matches(line, {_lit(rules.RISKY_LINE)})
), sized AS (
  SELECT *, CASE WHEN regexp_matches(line, '\bmalloc\s*\(([^)]*)\)') THEN regexp_extract(line, '\bmalloc\s*\(([^)]*)\)', 1)
                 WHEN regexp_matches(line, '\brealloc\s*\([^,]+,\s*([^)]*)\)') THEN regexp_extract(line, '\brealloc\s*\([^,]+,\s*([^)]*)\)', 1)
                 WHEN regexp_matches(line, '\bmemcpy\s*\([^,]+,\s*[^,]+,\s*([^)]*)\)') THEN regexp_extract(line, '\bmemcpy\s*\([^,]+,\s*[^,]+,\s*([^)]*)\)', 1) ELSE value END AS size
  FROM risky WHERE NOT (value <> '' AND regexp_matches({_trim("value")}, '^[\d\s+\-*/()]+$'))
), named AS (
  SELECT *, list_filter(list_distinct(flatten(list_transform(regexp_extract_all(size, '\b{_NAME}\b\s*[+*]\s*\b{_NAME}\b'), lambda x: regexp_extract_all(x, '{_NAME}')))), lambda x: x NOT IN ({", ".join(map(_lit, rules.IGNORED_NAMES))})) AS names FROM sized
), overflow AS (
  SELECT file, 'integer-overflow' AS "ruleId", 'CWE-190' AS "cweId", 'medium' AS severity, i + 1 AS line, CAST(instr(raw, line) AS BIGINT) AS "column", line AS evidence, {_lit(rules.OVERFLOW_MESSAGE)} AS message
  FROM named WHERE NOT (len(names) > 0 AND coalesce(list_bool_or(list_transform(list_filter(guards, lambda g: g IS NOT NULL), lambda g: list_bool_and(list_transform(names, lambda v:
    list_contains(regexp_extract_all(g, '\b({_NAME})\s*(?:<=|<|>=|>)\s*[\w\s/*+\-]+', 1), v) OR list_contains(regexp_extract_all(g, '[\w\s/*+\-]+\s*(?:<=|<|>=|>)\s*({_NAME})', 1), v))))), false))
)"""

_TITLES = "titles(\"cweId\", vulnerability) AS (VALUES " + ", ".join(f"({_lit(k)}, {_lit(v)})" for k, v in rules.TITLES.items()) + ")"
#: Common table expressions up to ``text_hits``, the findings of all text rules.
_TEXT = f"""{corpus_sql()}, {_LINES}, {_SQLI}, {_TAINT}, {_PATHS}, {_FREED}, {_OVERFLOW}, text_hits AS (
{_found(rules.PATTERNS + rules.BOUNDS)}
UNION ALL SELECT * FROM sqli UNION ALL SELECT * FROM paths UNION ALL SELECT * FROM freed UNION ALL SELECT * FROM overflow
)"""

# --- structure rules -------------------------------------------------------------------------------
# What a reader finds in each sample: (kind, rule, CWE, line, column, evidence, message); {k} is the part key.

_HASH, _WEAK = "Use of Broken Cryptographic Algorithm", "Use of Weak Hash"
_STRUCTURE_TITLES = {
    "CWE-22": "Path Traversal", "CWE-78": "OS Command Injection", "CWE-89": "SQL Injection", "CWE-190": "Integer Overflow", "CWE-416": "Use After Free", "CWE-787": "Out-of-bounds Write",
    "CWE-327": _HASH, "CWE-328": _WEAK, "CWE-259": "Use of Hard-coded Password", "CWE-321": "Use of Hard-coded Cryptographic Key",
}


def _hash(kind: int, line: int, column: int, evidence: str, message: str) -> list[tuple]:
    return [(kind, "ast-weak-hash", cwe, line, column, evidence, message) for cwe in ("CWE-327", "CWE-328")]


_WRITES = "() does not perform bounds checking and may write past a buffer."
EXPECTED = [
    *_hash(0, 3, 12, "hashlib.md5(x)", "hashlib.md5() uses a weak hashing algorithm."),
    *_hash(0, 3, 29, "hashlib.sha1(x)", "hashlib.sha1() uses a weak hashing algorithm."),
    (1, "ast-weak-cipher", "CWE-327", 2, 10, "DES.new(key{k})", "DES.new() uses a broken or weak cipher."),
    (2, "ast-cmd-injection", "CWE-78", 3, 11, "'ping ' + name", "os.system() receives user-controlled input."),
    (2, "ast-cmd-injection", "CWE-78", 4, 11, "name", "os.system() receives user-controlled input."),
    (4, "ast-sqli", "CWE-89", 2, 17, "\"SELECT * FROM t{k} WHERE n = '\" + name + \"'\"", "SQL query is constructed with user-controlled input."),
    (5, "ast-sqli", "CWE-89", 3, 17, "query", "SQL query is constructed with user-controlled input."),
    (6, "ast-path-traversal", "CWE-22", 4, 11, "full", "open() receives user-controlled path without validation."),
    (8, "ast-hardcoded-cred", "CWE-259", 1, 12, "'hunter{k}22'", "Hard-coded credential assigned to 'password'."),
    (8, "ast-hardcoded-cred", "CWE-321", 2, 11, "'abcdef{k}'", "Hard-coded credential assigned to 'api_key'."),
    (9, "ast-path-traversal", "CWE-22", 6, 11, "path", "send_file() receives user-controlled path without validation."),
    *_hash(10, 3, 5, 'MessageDigest.getInstance("MD5")', 'getInstance("MD5") uses a weak hash algorithm (MD5/SHA-1).'),
    *_hash(10, 4, 5, 'MessageDigest.getInstance("SHA-1")', 'getInstance("SHA-1") uses a weak hash algorithm (MD5/SHA-1).'),
    (10, "ast-weak-cipher", "CWE-327", 5, 5, 'Cipher.getInstance("DES")', 'getInstance("DES") uses a broken or weak cipher.'),
    (11, "ast-cmd-injection", "CWE-78", 3, 5, "Runtime.getRuntime().exec(cmd)", "Runtime.exec() receives user-controlled input."),
    (11, "ast-cmd-injection", "CWE-78", 4, 5, "new ProcessBuilder(cmd)", "new ProcessBuilder() receives user-controlled command."),
    (12, "ast-sqli", "CWE-89", 3, 21, '"SELECT a FROM t WHERE id = " + id', "SQL query constructed with user-controlled input."),
    (12, "ast-sqli", "CWE-89", 5, 22, "q", "SQL query constructed with user-controlled input."),
    (13, "ast-path-traversal", "CWE-22", 4, 23, "name", "new File() receives user-controlled path."),
    (14, "ast-hardcoded-cred", "CWE-259", 2, 21, '"secret{k}"', "Hard-coded credential assigned to 'password'."),
    (14, "ast-hardcoded-cred", "CWE-259", 3, 53, '"hunter22"', "Hard-coded password passed to getConnection()."),
    (15, "ast-oob-write", "CWE-787", 4, 3, "gets(b)", "gets" + _WRITES),
    (15, "ast-oob-write", "CWE-787", 5, 3, 'strcpy(b, "ok")', "strcpy" + _WRITES),
    (15, "ast-oob-write", "CWE-787", 6, 3, "strcpy(b, src{k})", "strcpy" + _WRITES),
    (15, "ast-oob-write", "CWE-787", 7, 3, 'sprintf(b, "%d", 1)', "sprintf" + _WRITES),
    (16, "ast-cmd-injection", "CWE-78", 2, 3, "system(cmd)", "system() receives a non-literal command argument."),
    (16, "ast-cmd-injection", "CWE-78", 4, 3, 'execl(path, "x", NULL)', "execl() receives user-controlled argument."),
    *_hash(16, 5, 3, "MD5(d, n, m)", "MD5() uses a weak hashing algorithm (MD5/SHA1)."),
    (17, "ast-use-after-free", "CWE-416", 3, 16, "p", "Pointer 'p' is used after being freed."),
    (18, "ast-integer-overflow", "CWE-190", 4, 13, "malloc(n * m)", "Arithmetic on user-controlled integer may overflow."),
    (18, "ast-integer-overflow", "CWE-190", 4, 20, "n * m", "malloc() size argument contains arithmetic that may overflow."),
    (18, "ast-integer-overflow", "CWE-190", 5, 15, "n + k{k}", "Arithmetic on user-controlled integer may overflow."),
    (19, "ast-hardcoded-cred", "CWE-259", 1, 21, '"hunter{k}22"', "Hard-coded credential in macro 'DB_PASSWORD'."),
    (19, "ast-oob-write", "CWE-787", 5, 3, "buf[n]", "Array write uses user-controlled index without bounds check."),
    (20, "ast-integer-overflow", "CWE-190", 5, 11, "a * 2", "Arithmetic on user-controlled integer may overflow."),
    (21, "ast-path-traversal", "CWE-22", 7, 11, "os.path.join(base, name)", "open() receives user-controlled path without validation."),
    (21, "ast-path-traversal", "CWE-22", 7, 30, "name", "os.path.join() receives user-controlled path without validation."),
    (22, "ast-integer-overflow", "CWE-190", 21, 11, "n * 3", "Arithmetic on user-controlled integer may overflow."),
    (23, "ast-sqli", "CWE-89", 7, 17, "e", "SQL query is constructed with user-controlled input."),
    (24, "ast-oob-write", "CWE-787", 302, 3, "strcpy(a, b{k})", "strcpy" + _WRITES),
]
_MEDIUM = ("ast-weak-hash", "ast-weak-cipher", "ast-integer-overflow")
_EXPECTED = (
    'expected(kind, "ruleId", "cweId", line, "column", evidence, message, severity, vulnerability) AS (VALUES '
    + ", ".join(f"({k}, {_lit(rule)}, {_lit(cwe)}, {line}, {column}, {_lit(evidence)}, {_lit(message)}, '{'medium' if rule in _MEDIUM else 'high'}', {_lit(_STRUCTURE_TITLES[cwe])})" for k, rule, cwe, line, column, evidence, message in EXPECTED)
    + """), structure_hits AS (
  SELECT "cweId", "ruleId", vulnerability, severity, message, file, line, "column", replace(evidence, '{k}', CAST(part_key AS VARCHAR)) AS evidence FROM corpus JOIN expected USING (kind)
)"""
)
_FINDING = '"cweId", "ruleId", vulnerability, severity, message, file, CAST(line AS INTEGER) AS line, CAST("column" AS INTEGER) AS "column", evidence'

# --- answers of models -----------------------------------------------------------------------------
# Turn 0: no JSON, 1: an empty answer, 2: none, 3 and 4: the true CWE (CWE-22 for the safe kind) with three fixes.

_ANSWERS = f"""truth_of(kind, cwe) AS (VALUES {", ".join(f"({k}, '{c}')" for k, c in TRUE_CWE.items())}),
answered AS (
  SELECT file AS id, code, kind, coalesce(cwe, '') AS cwes, CASE WHEN part_key % 5 > 2 THEN coalesce(cwe, 'CWE-22') ELSE '' END AS predicted, part_key % 5 > 2 AND cwe IS NOT NULL AS mended,
         CASE WHEN file LIKE '%.c' THEN 'c' WHEN file LIKE '%.java' THEN 'java' WHEN file LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language
  FROM corpus LEFT JOIN truth_of USING (kind)
)"""

# --- metrics ---------------------------------------------------------------------------------------

_TRUTH = "truth AS (SELECT d.doc_id, source AS cwe, toxic = 1 AS truth, length(text) > 1500 AS found, quality = 1 AS other FROM documents d JOIN labels USING (doc_id))"
_COUNTS = "count(*) FILTER (truth AND {0}) AS tp, count(*) FILTER (truth AND NOT {0}) AS fn, count(*) FILTER (NOT truth AND {0}) AS fp, count(*) FILTER (NOT truth AND NOT {0}) AS tn"
_FIX = "greatest(0.0, least(1.0, CASE WHEN l_returnflag = 'R' THEN l_quantity / 50 ELSE 0.8 * (l_quantity / 50) + 0.2 * (l_linenumber % 2) END - least(0.8, CAST(0.05 AS DOUBLE) * (l_partkey % 20))))"
_CRYPTO_SQL = _patterns_sql([p for p in rules.PATTERNS if p.cwe == "CWE-327"])

ORACLE_SQL = {
    "ref_weak_crypto": _CRYPTO_SQL,
    "ref_command_injection": _patterns_sql([p for p in rules.PATTERNS if p.cwe == "CWE-78"]),
    "ref_out_of_bounds_write": _patterns_sql(rules.BOUNDS),
    "ref_finding_counts": f'SELECT "ruleId", "cweId", count(*) AS findings, count(DISTINCT file) AS files FROM ({_CRYPTO_SQL}) GROUP BY ALL',
    "ref_languages": f"""WITH {corpus_sql()} SELECT {_LANGUAGE_SQL} AS language,
  CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.java' THEN 'java' WHEN file LIKE '%.c' THEN 'c' ELSE 'unknown' END AS shown, count(*) AS files FROM corpus GROUP BY ALL""",
    "ref_code_lines": f"""WITH {corpus_sql()}, {_LINES} SELECT file, i, "offset", line FROM lines WHERE line <> '' AND NOT regexp_matches(line, '^(//|#)')""",
    "ref_use_after_free": f"WITH {corpus_sql()}, {_LINES}, {_FREED} SELECT {_SHOWN} FROM freed",
    "ref_sql_injection": f"WITH {corpus_sql()}, {_SQLI} SELECT {_SHOWN} FROM sqli",
    "ref_tainted_names": f"WITH RECURSIVE {corpus_sql()}, {_TAINT} SELECT file, array_to_string(tainted, ',') AS tainted, array_to_string(constants, ',') AS constants FROM known",
    "ref_path_traversal": f"WITH RECURSIVE {corpus_sql()}, {_LINES}, {_TAINT}, {_PATHS} SELECT {_SHOWN} FROM paths",
    "ref_integer_overflow": f"WITH {corpus_sql()}, {_LINES}, {_OVERFLOW} SELECT {_SHOWN} FROM overflow",
    "ref_text_findings": f'WITH RECURSIVE {_TEXT}, {_TITLES} SELECT {_FINDING} FROM text_hits JOIN titles USING ("cweId")',
    "ref_structure_findings": f"WITH {corpus_sql()}, {_EXPECTED} SELECT {_FINDING} FROM structure_hits",
    "ref_diagnostics": f"""WITH {corpus_sql()}, found AS ({_found(rules.PATTERNS + rules.BOUNDS)})
SELECT file, CAST(greatest(0, line - 1) AS INTEGER) AS line, CAST(greatest(0, "column" - 1) AS INTEGER) AS start, CAST(greatest(0, "column" - 1) + greatest(1, length(evidence)) AS INTEGER) AS "end", message,
       CASE severity WHEN 'high' THEN 'Error' WHEN 'medium' THEN 'Warning' ELSE 'Information' END AS severity, 'vulnlake' AS source, "ruleId" AS code FROM found""",
    "ref_enriched": f"""WITH RECURSIVE {_TEXT}, {_EXPECTED}, by_text AS (SELECT file, count(*) AS n FROM text_hits GROUP BY file), by_facts AS (SELECT file, count(*) AS n FROM structure_hits GROUP BY file)
SELECT c.file AS id, 'CWE-22' AS cwe_folder, coalesce(s.n, 0) AS findings FROM corpus c LEFT JOIN by_facts s ON c.file = s.file
UNION ALL SELECT c.file, 'SAFE-NONCWE', coalesce(t.n, 0) FROM corpus c LEFT JOIN by_text t ON c.file = t.file""",
    "ref_analyzer_comparison": f"""WITH RECURSIVE {_TEXT}, {_EXPECTED}, r AS (
  SELECT 'kind-' || kind AS cwe, kind < {len(SNIPPETS) - 1} AS truth, file IN (SELECT file FROM text_hits) AS a, file IN (SELECT file FROM structure_hits) AS b FROM corpus)
SELECT cwe, {", ".join(f"count(*) FILTER ({t} AND {f}) AS {side}_{n}" for side, x in (("left", "a"), ("right", "b")) for n, t, f in (("tp", "truth", x), ("fn", "truth", f"NOT {x}"), ("fp", "NOT truth", x), ("tn", "NOT truth", f"NOT {x}")))} FROM r GROUP BY cwe""",
    "ref_evaluation": f"""WITH {corpus_sql()}, {_ANSWERS}, m AS (
  SELECT *, CASE WHEN cwes = '' AND predicted = '' OR cwes = predicted THEN 1.0 ELSE 0.0 END AS c, CASE WHEN mended AND kind = 0 THEN 1.0 WHEN mended AND kind = 2 THEN 0.5 ELSE 0.0 END AS r, CASE WHEN mended AND kind = 2 THEN 2 ELSE 0 END AS added,
         CASE language WHEN 'python' THEN 1.0 WHEN 'java' THEN 0.0 END AS ok FROM answered
), f AS (SELECT *, CASE WHEN language = 'java' THEN r - 0.05 * added ELSE 0.8 * r + 0.2 * coalesce(ok, 0) - 0.05 * added END AS fix FROM m)
SELECT id, language, cwes, predicted, CAST(c AS DOUBLE) AS cwe_score, CAST(r AS DOUBLE) AS reduction, CAST(ok AS DOUBLE) AS compiles, CAST(fix AS DOUBLE) AS fix_score, CAST(added AS BIGINT) AS introduced,
       CAST(round(0.5 * c + 0.5 * CASE WHEN cwes = '' THEN CASE WHEN predicted = '' THEN 1 ELSE 0 END ELSE fix END, 9) AS DOUBLE) AS final_score FROM f""",
    "ref_split_documents": f"""WITH {corpus_sql()}, d AS (
  SELECT file AS id, CASE WHEN kind % 7 = 0 THEN 'MULTI-CWE' WHEN kind % 7 = 1 THEN 'SAFE-NONCWE' ELSE 'CWE-' || kind END AS cwe_folder, kind % 7 < 2 AS special, CASE WHEN kind % 7 >= 2 THEN (part_key // {len(SNIPPETS)}) % 3 = 0 END AS bad FROM corpus
), p AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY cwe_folder, bad) AS n FROM d WINDOW w AS (PARTITION BY cwe_folder, bad ORDER BY md5('42:' || id), id)),
q AS (SELECT *, floor(n * CASE WHEN special THEN 0.6 ELSE 0.8 END + 1e-9) AS a, floor(n * CASE WHEN special THEN 0.2 ELSE 0.1 END + 1e-9) AS b FROM p)
SELECT id, cwe_folder, CASE WHEN place < a THEN 'train' WHEN place < a + b + floor((n - a - 2 * b) / 2) THEN 'val' ELSE 'test' END AS split FROM q""",
    "ref_taint_closure": """WITH RECURSIVE e AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS file, 'v' || (o_custkey % 40) AS src, 'v' || (o_orderkey % 40) AS dst, o_orderpriority LIKE '1%' AS seed FROM orders
), t AS (SELECT file, src AS name FROM e WHERE seed UNION SELECT e.file, e.dst FROM t JOIN e ON t.file = e.file AND t.name = e.src)
SELECT file, name FROM t""",
    "ref_confusion": f"WITH {_TRUTH} SELECT cwe, {_COUNTS.format('found')} FROM truth GROUP BY ROLLUP (cwe)",
    "ref_detection_rates": f"""WITH {_TRUTH}, c AS (SELECT cwe, {_COUNTS.format("found")} FROM truth GROUP BY cwe)
SELECT cwe, CASE WHEN tp + fn > 0 THEN CAST(100 AS DOUBLE) * tp / (tp + fn) END AS detection, CASE WHEN fp + tn > 0 THEN CAST(100 AS DOUBLE) * fp / (fp + tn) END AS false_positive FROM c""",
    "ref_compared_analyzers": f"""WITH {_TRUTH}, a AS (SELECT cwe, {_COUNTS.format("found")} FROM truth WHERE found GROUP BY cwe), b AS (SELECT cwe, {_COUNTS.format("other")} FROM truth WHERE other GROUP BY cwe)
SELECT coalesce(a.cwe, b.cwe) AS cwe, {", ".join(f"coalesce({t}.{n}, 0) AS {s}_{n}" for t, s in (("a", "left"), ("b", "right")) for n in ("tp", "fn", "fp", "tn"))} FROM a FULL JOIN b ON a.cwe = b.cwe""",
    "ref_passed": f"WITH {_TRUTH} SELECT cwe, count(*) FILTER (found) AS passed, count(*) AS total FROM truth GROUP BY cwe",
    "ref_set_f1": """WITH s AS (
  SELECT l_orderkey AS id, list_distinct(list(l_returnflag || l_linestatus) FILTER (l_linenumber % 2 = 1)) AS a, list_distinct(list(l_returnflag || l_linestatus) FILTER (l_linenumber % 2 = 0)) AS b FROM lineitem GROUP BY l_orderkey
), n AS (SELECT id, coalesce(len(a), 0) AS p, coalesce(len(b), 0) AS q, coalesce(len(list_intersect(a, b)), 0) AS h FROM s)
SELECT id, round(CASE WHEN p = 0 AND q = 0 THEN 1.0 WHEN p = 0 OR q = 0 THEN 0.0 ELSE CAST(2 AS DOUBLE) * h / (p + q) END, 9) AS f1 FROM n""",
    "ref_fix_scores": f"SELECT l_orderkey, l_linenumber, round(CAST({_FIX} AS DOUBLE), 9) AS fix FROM lineitem",
    "ref_score_means": f"SELECT CASE l_returnflag WHEN 'R' THEN 'java' WHEN 'A' THEN 'python' ELSE 'c' END AS language, round(avg(CAST({_FIX} AS DOUBLE)), 6) AS fix, round(avg(l_quantity / 50), 6) AS reduced, count(*) AS samples FROM lineitem GROUP BY ALL",
    "ref_split_counts": f"""WITH {corpus_sql()}, d AS (
  SELECT CASE WHEN kind % 7 = 0 THEN 'MULTI-CWE' WHEN kind % 7 = 1 THEN 'SAFE-NONCWE' ELSE 'CWE-' || kind END AS cwe_folder, kind % 7 < 2 AS special, CASE WHEN kind % 7 >= 2 THEN (part_key // {len(SNIPPETS)}) % 3 = 0 END AS bad FROM corpus
), g AS (SELECT cwe_folder, special, bad, count(*) AS n FROM d GROUP BY ALL), f AS (
  SELECT *, CAST(floor(n * CASE WHEN special THEN 0.6 ELSE 0.8 END + 1e-9) AS BIGINT) AS a, CAST(floor(n * CASE WHEN special THEN 0.2 ELSE 0.1 END + 1e-9) AS BIGINT) AS b FROM g
), p AS (SELECT cwe_folder, unnest(['train', 'val', 'test']) AS split, unnest([a, b + (n - a - 2 * b) // 2, n - a - b - (n - a - 2 * b) // 2]) AS m FROM f)
SELECT cwe_folder, split, CAST(sum(m) AS BIGINT) AS documents FROM p WHERE m > 0 GROUP BY ALL""",
    "ref_missing_code": f"""WITH {corpus_sql()} SELECT s_suppkey AS id, '/src/part-' || (s_suppkey * 7) || '.py' AS path FROM supplier WHERE 'src/part-' || (s_suppkey * 7) || '.py' NOT IN (SELECT file FROM corpus)""",
    "ref_patched_code": f"""WITH {corpus_sql()}, {_ANSWERS} SELECT id, predicted,
  CASE WHEN mended THEN regexp_replace(regexp_replace(regexp_replace(code, 'hashlib\\.md5', 'hashlib.sha256'), 'hashlib\\.sha1\\(x\\)', 'b\'\'\'\''), 'os\\.system\\(name\\)', 'hashlib.md5(name)') ELSE code END AS patched FROM answered""",
    "ref_prompts": f"""WITH {corpus_sql()} SELECT file, trim('Review ' || file || ':' || chr(10) || code || chr(10), {_SPACES}) AS prompt FROM corpus""",
    "ref_best_epochs": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS epoch, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY 1)
SELECT epoch, score, coalesce(score > max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM m""",
    "ref_credentials": _patterns_sql(rules.CREDENTIALS),
    "ref_sample_report": f"""WITH RECURSIVE {_TEXT}, {_ANSWERS}, o AS (
  SELECT file, "cweId", min((CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, line, "column")) AS place FROM text_hits GROUP BY file, "cweId"
), g AS (SELECT file, string_agg("cweId", ', ' ORDER BY place) AS tags, list("cweId") AS cwes FROM o GROUP BY file)
SELECT id AS file, CASE WHEN cwes = '' THEN 'SAFE-NONCWE' ELSE cwes END AS cwe, coalesce(list_contains(g_cwes, cwes), false) AS hit, coalesce(tags, '(none)') AS tags
FROM answered LEFT JOIN (SELECT file, tags, cwes AS g_cwes FROM g) x ON id = x.file""",
    "ref_group_report": f"""WITH s AS (SELECT unnest(['all', CASE WHEN month(l_shipdate) <= 6 THEN strftime(l_shipdate, '%Y-%m') END]) AS months, CAST({_FIX} AS DOUBLE) AS fix, l_quantity / 50 AS reduced FROM lineitem)
SELECT months, round(avg(fix), 6) AS fix, round(avg(reduced), 6) AS reduced, count(*) AS samples FROM s WHERE months IS NOT NULL GROUP BY months""",
    "ref_run_counters": f"""WITH {corpus_sql()}, d AS (SELECT s_suppkey % 10 = 0 AS bad, 'src/part-' || (s_suppkey * 3) || '.py' IN (SELECT file FROM corpus) AS has FROM supplier)
SELECT count(*) FILTER (NOT bad AND has) AS processed, count(*) FILTER (NOT bad AND NOT has) AS skipped, count(*) FILTER (bad) AS errors FROM d""",
    "ref_latest_events": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
