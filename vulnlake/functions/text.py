"""Languages by suffix, regular expressions with ASCII word borders, matches with places, lines and columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes by language, for analysis and for display.
ANALYSIS_SUFFIXES = {"cpp": "c cpp cc cxx h hpp", "java": "java", "python": "py"}
DISPLAY_SUFFIXES = {
    "python": "py", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp", "javascript": "js", "typescript": "ts",
    "csharp": "cs", "go": "go", "rust": "rs", "php": "php", "ruby": "rb", "json": "json",
}
WHITE = " \t\r\n\f\x0b"
_BORDER = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


#: A border before a letter or _, before a class of such, or before a group of choices that begin with such: nothing of a word before it is enough.
_FIRST = r"[A-Za-z_](?![?*{])"
_CHOICE = rf"{_FIRST}(?:\\.|\[[^\]]*\]|[^\\|()\[\]])*"
_BEFORE = re.compile(rf"\\b(?=(?P<letter>{_FIRST})|(?P<class>\[a-zA-Z_\](?![?*{{])|\(\[a-zA-Z_\]\[a-zA-Z0-9_\]\*\)(?![?*{{]))|\((?:\?:)?(?P<choices>{_CHOICE}(?:\|{_CHOICE})*)\)(?![?*{{]))")


def _before(m: re.Match) -> str:
    """A border that begins a word. Looking at the letter first is cheap and fails nearly everywhere."""
    first = m["letter"] or "".join(dict.fromkeys(c[0] for c in re.findall(_CHOICE, m["choices"] or "")))
    return f"(?=[{first}])(?<![A-Za-z0-9_])" if first else "(?<![A-Za-z0-9_])"


def ascii_borders(pattern: str) -> str:
    r"""``\b`` of Java takes all letters of Unicode for words; here it stays between ASCII ones."""
    return _BEFORE.sub(_before, pattern).replace(r"\b", _BORDER)


def has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(ascii_borders(pattern)))


def _by_suffix(path: Column, table: dict[str, str]) -> Column:
    low = F.lower(path)
    return reduce(lambda acc, kv: acc.when(low.rlike(rf"\.({'|'.join(kv[1].split())})$"), F.lit(kv[0])), list(table.items())[1:], F.when(low.rlike(rf"\.({'|'.join(next(iter(table.values())).split())})$"), F.lit(next(iter(table))))).otherwise(F.lit("unknown"))


def detect_language(path: Column) -> Column:
    """cpp, java, python or unknown."""
    return _by_suffix(path, ANALYSIS_SUFFIXES)


def display_language(path: Column) -> Column:
    return _by_suffix(path, DISPLAY_SUFFIXES)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


_MATCH = "at:int,line:int,column:int,hit:string,arg:string,after:string"


def _moved(line: Column, column: Column, text: Column) -> tuple[Column, Column]:
    """Line and column behind ``text`` that begins at ``line`` and ``column``."""
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    last = F.char_length(F.substring_index(text, "\n", -1))
    return line + breaks, F.when(breaks > 0, last + 1).otherwise(column + last)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<at, line, column, hit, arg, after>> of all matches from left to right: 0-based place, 1-based line and column,
    the match, one of its groups, and what follows up to the next match.

    Places, lines and columns are what the gaps and matches before add up to: one fold looks at each character of the text a fixed number of times.
    A text without a match is looked at once.
    """
    rx = F.lit(ascii_borders(pattern))
    args = [F.regexp_extract_all(text, rx, F.lit(group)).alias("arg")] if group else []
    gaps = F.split(text, ascii_borders(pattern), -1)
    parts = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"), gaps.alias("gap"), F.slice(gaps, 2, 2**30).alias("after"), *args)
    start = F.struct(F.lit(0).alias("end"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.array().cast(f"array<struct<{_MATCH}>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        at, (line, column) = s["end"] + F.char_length(x["gap"]), _moved(s["line"], s["column"], x["gap"])
        arg = x["arg"] if group else x["hit"]
        found = F.struct(at.alias("at"), line.alias("line"), column.alias("column"), x["hit"].alias("hit"), arg.alias("arg"), x["after"].alias("after"))
        below, right = _moved(line, column, x["hit"])
        return F.struct((at + F.char_length(x["hit"])).alias("end"), below.alias("line"), right.alias("column"), F.array_append(s["out"], found).alias("out"))

    found = F.aggregate(F.filter(parts, lambda x: x["hit"].isNotNull()), start, step, lambda s: s["out"])
    return F.when(has(text, pattern), found).when(text.isNotNull(), F.array().cast(f"array<struct<{_MATCH}>>"))


def top_level_args(text: Column) -> Column:
    """Arguments between commas outside quotes and brackets, trimmed; an empty last one is dropped."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit("").alias("last"), F.lit(1).alias("at"), F.lit(1).alias("begin"), F.array().cast("array<string>").alias("done"))
    cut_out = lambda s: trim(F.substring(text, s["begin"], s["at"] - s["begin"]))

    def step(s: Column, c: Column) -> Column:
        quoting = (s["quote"] == c) & (s["last"] != "\\")
        opening = (s["quote"] == "") & c.isin("'", '"')
        plain = s["quote"] == ""
        depth = s["depth"] + F.when(plain & c.isin("(", "[", "{"), 1).when(plain & c.isin(")", "]", "}"), -1).otherwise(0)
        cut = plain & (c == ",") & (s["depth"] == 0)
        return F.struct(
            depth.alias("depth"), F.when(quoting, "").when(opening, c).otherwise(s["quote"]).alias("quote"), c.alias("last"), (s["at"] + 1).alias("at"),
            F.when(cut, s["at"] + 1).otherwise(s["begin"]).alias("begin"), F.when(cut, F.array_append(s["done"], cut_out(s))).otherwise(s["done"]).alias("done"),
        )

    finish = lambda s: F.when(cut_out(s) != "", F.array_append(s["done"], cut_out(s))).otherwise(s["done"])
    return F.aggregate(F.split(text, ""), start, step, finish)


def is_literal(text: Column) -> Column:
    """One string literal without its own quote inside."""
    return trim(text).rlike("""^("[^"]*"|'[^']*')$""")


def is_name(text: Column) -> Column:
    return trim(text).rlike("^[a-zA-Z_][a-zA-Z0-9_]*$")


def names_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
