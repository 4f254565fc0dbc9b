"""Facts about code: calls, assignments, parameters, loops, and so on, as arrays of one row a file.

A tolerant scanner: it knows comments, strings and brackets but no grammar, so incomplete code still
gives facts. Everything that is decided from the facts is decided by Spark expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SCHEMA = (
    "calls array<struct<name:string,method:string,recv:string,made:boolean,at:bigint,text:string,args array<struct<text:string,kind:string,names:array<string>,at:bigint,arith:boolean>>,guards:array<string>>>,"
    "assigns array<struct<lhs:string,form:string,base:string,index:array<string>,kind:string,text:string,names:array<string>,at:bigint,place:bigint,arith:boolean,grown:boolean,made:boolean,last:boolean,guards:array<string>>>,"
    "params array<struct<type:string,name:string>>, loops array<struct<form:string,name:string,text:string,names:array<string>,at:bigint,writes:boolean>>,"
    "steps array<struct<name:string,text:string,at:bigint,guards:array<string>>>, divisions array<struct<text:string,names:array<string>,at:bigint>>,"
    "events array<struct<name:string,kind:string,at:bigint>>, imports array<string>, macros array<struct<name:string,text:string,at:bigint>>"
).replace(" array<", ":array<").replace(", ", ",")
_FIELDS = ["calls", "assigns", "params", "loops", "steps", "divisions", "events", "imports", "macros"]

_STRING = {
    "python": r"""(?:[rRbBuUfF]{0,2})(?:'''[\s\S]*?(?:'''|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)""",
    "java": r'''"""[\s\S]*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?''',
    "c": r'''(?:L|u8|u|U)?"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?''',
}
_COMMENT = {"python": r"#[^\n]*", "java": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", "c": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?<![^\n])[ \t]*\#(?:\\\r?\n|[^\n])*"}
_SCAN = {
    k: re.compile(rf"(?P<skip>{_COMMENT[k]}|[^\S\n]+)|(?P<str>{_STRING[k]})|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<op>\*\*=|//=|<<=|>>=|\.\.\.|->|\+\+|--|==|!=|<=|>=|&&|\|\||::|:=|[-+*/%&|^]=|//|[^\s\w])")
    for k in _STRING
}
_WORDS = {
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False",
    "java": "if else for while do switch case return new throw throws try catch finally synchronized super this instanceof class interface enum extends implements public private protected static final void null true false assert",
    "c": "if else for while do switch case return sizeof goto struct union enum typedef static const extern NULL",
}
_WORDS = {k: frozenset(v.split()) for k, v in _WORDS.items()}
_CALLABLE_BEFORE = {"return", "else", "case", "throw", "new", "in", "and", "or", "not", "yield", "await", "do", "if", "assert", "is", "elif", "while", "with", "lambda", "print", "del", "raise", "goto"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_BINARY = {"+", "-", "*", "/", "%", "//", "&", "|", "^", "<", ">", "<=", ">=", "==", "!=", "&&", "||", "**"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "//=", "**=", "<<=", ">>="}


class Scan:
    """Tokens of one text with matched brackets."""

    def __init__(self, code: str, language: str):
        self.code, self.language, self.words = code, language, _WORDS[language]
        found, depth = [], 0
        for m in _SCAN[language].finditer(code):
            if m.lastgroup == "skip":
                continue
            t = m.group()
            if m.lastgroup == "nl" and (language != "python" or depth):
                continue
            if m.lastgroup == "op":
                depth = max(0, depth + (t in _OPEN) - (t in _CLOSE))
            found.append((m.lastgroup, t, m.start(), m.end()))
        self.kind, self.text, self.start, self.end = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
        self.n = len(found)
        self.match, self.outer, stack = [-1] * self.n, [-1] * self.n, []
        for i, t in enumerate(self.text):
            self.outer[i] = stack[-1] if stack else -1
            if self.kind[i] != "op":
                continue
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE and stack and _OPEN[self.text[stack[-1]]] == t:
                k = stack.pop()
                self.match[k], self.match[i], self.outer[i] = i, k, self.outer[k]

    def source(self, i: int, j: int) -> str:
        return self.code[self.start[i] : self.end[j - 1]] if j > i else ""

    def names(self, i: int, j: int) -> list[str]:
        """Identifiers of a range, those in the braces of f-strings too; C leaves out members."""
        out = []
        for k in range(i, j):
            if self.kind[k] == "id" and self.text[k] not in self.words and not (self.language == "c" and k > i and self.text[k - 1] in (".", "->")):
                out.append(self.text[k])
            elif self.kind[k] == "str" and self.language == "python" and "f" in re.match("[A-Za-z]*", self.text[k])[0].lower():
                for inner in re.findall(r"\{([^{}]*)\}", self.text[k]):
                    out += [w for w in re.findall(r"[A-Za-z_]\w*", inner.split("!")[0].split(":")[0]) if w not in self.words]
        return list(dict.fromkeys(out))

    def top(self, i: int, j: int) -> Iterator[int]:
        """Tokens of a range outside its brackets."""
        while i < j:
            yield i
            i = max(i, self.match[i]) + 1 if self.text[i] in _OPEN and self.match[i] >= 0 else i + 1

    def shape(self, i: int, j: int) -> str:
        """name, text, joined, number, list, call, binary or other."""
        if j <= i:
            return "other"
        kinds = set(self.kind[i:j])
        if j - i == 1:
            return {"id": "name", "str": "text", "num": "number"}.get(self.kind[i], "other")
        if kinds == {"str"}:
            return "joined"
        if self.text[i] == "[" and self.match[i] == j - 1:
            return "list"
        if any(self.text[k] in _BINARY and k > i for k in self.top(i, j)):
            return "binary"
        return "call" if self.text[j - 1] == ")" and self.match[j - 1] > i and self.chain(self.match[j - 1]) == i else "other"

    def arith(self, i: int, j: int) -> bool:
        """A binary + - * or a ++ or -- anywhere inside."""
        for k in range(i, j):
            if self.text[k] in ("++", "--"):
                return True
            if self.kind[k] == "op" and self.text[k] in ("+", "-", "*") and k > i and (self.kind[k - 1] in ("id", "num", "str") or self.text[k - 1] in (")", "]")) and self.text[k - 1] not in self.words:
                if not (self.text[k] == "*" and k + 1 < j and self.text[k + 1] in (")", "*")):  # a pointer type in a cast
                    return True
        return False

    def chain(self, k: int) -> int:
        """First token of the postfix chain (names, members, calls, subscripts) that ends before token ``k``."""
        i = k
        while i > 0:
            p = i - 1
            if self.kind[p] in ("id", "str") and self.text[p] not in self.words - {"this", "super"}:
                i = p
            elif self.text[p] in (")", "]") and self.match[p] >= 0 and (self.match[p] == 0 or self.kind[self.match[p] - 1] in ("id",) and self.text[self.match[p] - 1] not in self.words or self.text[self.match[p] - 1] in (")", "]") or i < k):
                i = self.match[p]
                if i > 0 and (self.kind[i - 1] == "id" and self.text[i - 1] not in self.words - {"this", "super"} or self.text[i - 1] in (")", "]")):
                    continue
            else:
                break
            if i > 0 and self.text[i - 1] in (".", "->", "::"):
                i -= 1
                continue
            break
        return i

    def generic(self, k: int) -> int:
        """First token of the type that is made with the type arguments that end with the > at ``k``; else the token after it."""
        depth, i = 0, k
        while i > 0 and self.text[i] not in (";", "{", "}"):
            depth += (self.text[i] == ">") - (self.text[i] == "<")
            if not depth:
                break
            i -= 1
        while not depth and i > 1 and self.kind[i - 1] == "id":
            i -= 1
            if self.text[i - 1] == "new":
                return i
            if self.text[i - 1] != ".":
                break
            i -= 1
        return k + 1

    def parts(self, k: int) -> list[tuple[int, int]]:
        """Arguments of the bracket at ``k`` as token ranges."""
        out, begin, close = [], k + 1, self.match[k]
        for t in self.top(k + 1, close):
            if self.text[t] == ",":
                out.append((begin, t))
                begin = t + 1
        return [(a, b) for a, b in [*out, (begin, close)] if b > a]

    def statement_end(self, i: int) -> int:
        """Where an expression that starts at ``i`` ends: line or ;, or what closes or parts its bracket."""
        stop = {";", ","} if self.language != "python" else {";"}
        for k in self.top(i, self.n):
            if self.kind[k] == "nl" or self.text[k] in stop or self.text[k] in _CLOSE:
                return k
        return self.n


def _guards(s: Scan) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, int, str]]]:
    """(first token, end, condition) of what each if covers, and (head, first, end of condition, end, form) of loops."""
    ifs, loops = [], []
    for i in range(s.n):
        if s.kind[i] != "id" or s.text[i] not in ("if", "for", "while") or i + 1 >= s.n or s.text[i + 1] != "(" or s.match[i + 1] < 0:
            continue
        close = s.match[i + 1]
        body = close + 1
        end = s.match[body] + 1 if body < s.n and s.text[body] == "{" and s.match[body] >= 0 else next((k + 1 for k in s.top(body, s.n) if s.text[k] == ";"), s.n)
        while s.text[i] == "if" and end < s.n and s.text[end] == "else":
            nxt = end + 1
            end = s.match[nxt] + 1 if nxt < s.n and s.text[nxt] == "{" and s.match[nxt] >= 0 else next((k + 1 for k in s.top(nxt, s.n) if s.text[k] == ";" or s.text[k] == "{" and s.match[k] >= 0), s.n)
            if nxt < s.n and s.text[nxt] == "if":
                end = next((s.match[k] + 1 for k in range(nxt, s.n) if s.text[k] == "{" and s.match[k] >= 0), s.n)
        if s.text[i] == "if":
            ifs.append((i, end, s.source(i + 1, close + 1)))
        else:
            first, last = i + 2, close
            if s.text[i] == "for":
                cuts = [k for k in s.top(i + 2, close) if s.text[k] == ";"]
                first, last = (cuts[0] + 1, cuts[1]) if len(cuts) == 2 else (i + 2, i + 2)
            loops.append((i, first, last, end, s.text[i]))
    return ifs, loops


def extract(code: str, language: str) -> list:
    """The facts of one text, in the order of ``_FIELDS``. ``language``: python, java or c."""
    s = Scan(code, language)
    calls, assigns, params, loops, steps, divisions, events, imports, macros = ([] for _ in range(9))
    ifs, cond_loops = _guards(s) if language != "python" else ([], [])
    around = lambda i: [c for a, b, c in ifs if a < i < b]
    part = lambda a, b: {"text": s.source(a, b), "kind": s.shape(a, b), "names": s.names(a, b), "at": s.start[a] if a < s.n else 0, "arith": s.arith(a, b)}
    frees = set()
    for k in range(1, s.n):
        if s.text[k] != "(" or s.match[k] < 0 or s.kind[k - 1] != "id" and s.text[k - 1] not in (")", "]", ">"):
            continue
        if s.kind[k - 1] == "id" and s.text[k - 1] in s.words and s.text[k - 1] != "sizeof":
            continue
        begin = s.chain(k)
        if s.text[k - 1] == ">" and language == "java":
            begin = s.generic(k - 1)
        before = s.text[begin - 1] if begin else ""
        if begin == k or before in ("def", "class"):
            if before == "def":
                params += [{"type": "", "name": s.text[a]} for a, _ in s.parts(k) if s.kind[a] == "id"]
            continue
        close = s.match[k]
        follows = s.text[close + 1] if close + 1 < s.n else ""
        if language != "python" and (before and (s.kind[begin - 1] == "id" and before not in _CALLABLE_BEFORE or before in ("*", ">", "]", "&"))):
            if follows in ("{", "throws"):
                for a, b in s.parts(k):
                    ids = [j for j in range(a, b) if s.kind[j] == "id"]
                    if len(ids) >= 2 and s.text[a:b].count("[") == 0:
                        params.append({"type": " ".join(s.text[j] for j in ids[:-1] if s.text[j] not in ("final", "const")), "name": s.text[ids[-1]]})
                continue
            if s.kind[begin - 1] == "id" and before not in _CALLABLE_BEFORE:
                continue
        if language != "python" and follows == "{" and before in ("", ";", "}", "{", "public", "private", "protected"):
            for a, b in s.parts(k):
                ids = [j for j in range(a, b) if s.kind[j] == "id"]
                if len(ids) >= 2:
                    params.append({"type": " ".join(s.text[j] for j in ids[:-1] if s.text[j] != "final"), "name": s.text[ids[-1]]})
            continue
        method = s.text[k - 1] if s.kind[k - 1] == "id" else s.source(begin, k)
        recv = s.source(begin, k - 2) if k - 2 > begin and s.text[k - 2] in (".", "->") else ""
        made = language == "java" and before == "new"
        first = begin - 1 if made else begin
        name = re.sub(r"<[^()]*>$", "", s.source(begin, k))
        calls.append({"name": name, "method": method, "recv": recv, "made": made, "at": s.start[first], "text": s.source(first, close + 1), "args": [part(a, b) for a, b in s.parts(k)], "guards": around(k)})
        if language == "c" and name == "free" and close == k + 2 and s.kind[k + 1] == "id":
            frees.add(k + 1)
    resets = set()
    for k in range(1, s.n):
        if s.kind[k] != "op" or s.text[k] not in _ASSIGN:
            continue
        if language == "python" and s.outer[k] >= 0:
            continue  # a keyword argument
        if language == "python":
            begin = next((j + 1 for j in range(k - 1, -1, -1) if s.outer[j] < 0 and (s.kind[j] == "nl" or s.text[j] in (";", "=", ":") and s.text[j] != ":")), 0)
            colon = next((j for j in s.top(begin, k) if s.text[j] == ":"), None)
            target_end = k if colon is None else colon
        else:
            begin, target_end = s.chain(k), k
            if begin == k and s.text[k - 1] == ")" and s.match[k - 1] > 0 and s.text[s.match[k - 1] - 1] == "*":
                begin = s.match[k - 1]
            while begin and s.text[begin - 1] == "*" and (begin < 2 or s.text[begin - 2] in (";", "{", "}", ")", "*")):
                begin -= 1
        end = s.statement_end(k + 1)
        if target_end <= begin or end <= k + 1:
            continue
        lhs, last = s.source(begin, target_end), target_end - 1
        form = "pointer" if s.text[begin] == "*" else "name" if last == begin and s.kind[begin] == "id" else "item" if s.text[last] == "]" and s.match[last] > begin else "other"
        index = s.names(s.match[last] + 1, last) if form == "item" else s.names(begin, target_end) if form == "pointer" else []
        base = s.text[begin] if form == "item" and s.match[last] == begin + 1 else ""
        made = language != "python" and begin > 0 and (s.kind[begin - 1] == "id" and s.text[begin - 1] not in ("return", "else", "do", "case") or s.text[begin - 1] in ("*", ">", "]"))
        rhs = part(k + 1, end)
        if language == "java" and rhs["kind"] == "call" and re.match(r'^"[^"]*"\s*\.\s*(getBytes|toCharArray)\s*\(', rhs["text"]):
            rhs["kind"] = "bytes of text"
        assigns.append({"lhs": lhs, "form": form, "base": base, "index": index, **{c: rhs[c] for c in ("kind", "text", "names", "at", "arith")}, "place": s.start[begin], "grown": s.text[k] != "=", "made": bool(made), "last": False, "guards": around(k)})
        if form == "name":
            resets.add(begin)
    assigns.sort(key=lambda a: (a["place"], a["at"]))
    for a in {a["lhs"]: a for a in assigns if a["form"] == "name" and not a["grown"]}.values():
        a["last"] = True
    if language == "python":
        for i in range(s.n):
            if s.text[i] == "for" and s.kind[i] == "id":
                into = next((j for j in s.top(i + 1, s.n) if s.text[j] == "in" or s.kind[j] == "nl"), s.n)
                if into < s.n and s.text[into] == "in" and into == i + 2 and s.outer[i] < 0:
                    end = next((j for j in s.top(into + 1, s.n) if s.text[j] == ":" or s.kind[j] == "nl"), s.n)
                    loops.append({"form": "each", "name": s.text[i + 1], **{c: part(into + 1, end)[c] for c in ("text", "names", "at")}, "writes": False})
            elif s.text[i] == "/" and 0 < i < s.n - 1:
                end = next((j for j in s.top(i + 1, s.n) if j > i + 1 and (s.text[j] in _BINARY or s.text[j] in (",", ":", "=", "if", "else", "and", "or") or s.text[j] in _CLOSE or s.kind[j] == "nl")), s.n)
                divisions.append({c: part(i + 1, end)[c] for c in ("text", "names", "at")})
        imports = re.findall(r"(?m)^[ \t]*(from[ \t]+[\w.]+(?=[ \t]+import)|import[ \t]+[^\n#]+)", code)
    for head, a, b, end, form in cond_loops:
        inside = [x for x in assigns if s.start[head] < x["place"] < (s.start[end] if end < s.n else len(code)) and x["form"] in ("item", "pointer") and x["place"] > (s.start[b] if b < s.n else 0)]
        loops.append({"form": form, "name": "", "text": s.source(a, b), "names": s.names(a, b), "at": s.start[a] if a < s.n else 0, "writes": bool(inside)})
    if language == "c":
        known = {s.text[i] for i in frees}
        for i in range(s.n):
            if s.kind[i] == "op" and s.text[i] in ("++", "--"):
                j = i - 1 if i and s.kind[i - 1] == "id" else i + 1
                if j < s.n and s.kind[j] == "id":
                    steps.append({"name": s.text[j], "text": s.source(min(i, j), max(i, j) + 1), "at": s.start[min(i, j)], "guards": around(i)})
            if s.kind[i] == "id" and s.text[i] in known and not (i and s.text[i - 1] in (".", "->")):
                events.append({"name": s.text[i], "kind": "free" if i in frees else "assign" if i in resets else "use", "at": s.start[i]})
        for m in re.finditer(r"(?m)^[ \t]*#[ \t]*define[ \t]+(\w+)[ \t]+([^\r\n]*?)[ \t]*(?=//|/\*|\r?$)", code):
            macros.append({"name": m[1], "text": m[2], "at": m.start(2)})
    return [calls, assigns, params, loops, steps, divisions, events, imports, macros]


def _placed(found: list, code: str) -> list:
    """Facts with each place as line * 2**32 + column, which keeps their order, so that rules need no text to tell lines."""
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    todo = [x for facts in found for x in facts]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += x.get("args", ())
            for c in ("at", "place"):
                if c in x:
                    line = bisect_right(starts, x[c])
                    x[c] = (line << 32) + x[c] - starts[line - 1] + 1
    return found


def _facts(code: pa.Array, language: pa.Array, kind: pa.StructType, at_once: int = 200) -> pa.Array:
    """Facts of a batch of texts. A few texts at a time become Arrow: as Python objects facts take many times the room."""
    done = []
    for i in range(0, len(code), at_once):
        pairs = zip(code[i : i + at_once].to_pylist(), language[i : i + at_once].to_pylist(), strict=True)
        rows = [_placed(extract(c, lang), c) if c and lang in _SCAN else [[] for _ in _FIELDS] for c, lang in pairs]
        done.append(pa.StructArray.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*rows, strict=True), kind, strict=True)], fields=list(kind)))
    return pa.concat_arrays(done) if done else pa.array([], kind)


def grammar(path: Column) -> Column:
    """python, java or c by suffix; all C and C++ suffixes count as c."""
    low = F.lower(path)
    return F.when(low.endswith(".py"), "python").when(low.endswith(".java"), "java").when(low.rlike(r"\.(c|cpp|cc|cxx|h|hpp)$"), "c")


def facts(corpus: DataFrame, compat: bool = False) -> DataFrame:
    """(file, code, grammar) plus the fact arrays, one row a file; files of other kinds are left out.

    ``compat`` leaves out .cc, .cxx and .hpp, which the first analyzer didn't dispatch.
    """
    rows = corpus.select("file", "code", grammar(F.col("file")).alias("grammar")).where("grammar is not null")
    if compat:
        rows = rows.where(~F.lower("file").rlike(r"\.(cc|cxx|hpp)$"))
    kind = StructType.fromDDL(SCHEMA)
    arrow = to_arrow_type(kind)

    def found(code: pa.Array, language: pa.Array) -> pa.Array:
        return _facts(code, language, arrow)

    return rows.withColumn("__f", F.arrow_udf(found, kind)("code", "grammar")).select("file", "code", "grammar", "__f.*")
