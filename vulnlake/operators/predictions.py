"""Model answers: parsing, prompts, applying fixes, syntax."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trim
from ..schemas import PREDICTION


_ITEMS = PREDICTION.split("vulnerabilities:")[1][:-1]


def parse(raw: Column) -> Column:
    """The JSON from the first { to the last } of an answer; items that aren't well formed are dropped, a bad answer has none.

    Types are looked at as they are in the JSON: an item counts if it is an object whose own ``cwe`` is a string, whatever lies inside its other fields. Fixes
    are kept where they are objects; an origin or replacement that isn't a string is null.
    """
    answer = F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    items = F.try_variant_get(answer, "$.vulnerabilities", "array<variant>")
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda v, path: F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))

    def fix(v: Column) -> Column:
        return F.struct(text(v, "$.origin").alias("origin"), text(v, "$.replacement").alias("replacement"))

    def item(v: Column) -> Column:
        fixes = F.filter(F.try_variant_get(v, "$.fixes", "array<variant>"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
        return F.struct(text(v, "$.cwe").alias("cwe"), F.transform(fixes, fix).alias("fixes"))

    read = F.filter(F.transform(items, item), lambda v: v["cwe"].isNotNull())
    return F.coalesce(read, F.array().cast(_ITEMS))


def predicted_cwes(vulnerabilities: Column) -> Column:
    return F.array_distinct(F.transform(vulnerabilities, lambda v: v["cwe"]))


def fixes_for(vulnerabilities: Column, truth: Column) -> Column:
    """The fixes of those predictions whose CWE is true, in order."""
    return F.flatten(F.transform(F.filter(vulnerabilities, lambda v: F.array_contains(truth, v["cwe"])), lambda v: F.coalesce(v["fixes"], F.array().cast("array<struct<origin:string,replacement:string>>"))))


def apply_fixes(code: Column, fixes: Column) -> Column:
    """Code after the fixes one by one: of each the first occurrence of origin is replaced, if there is one."""

    def one(text: Column, fix: Column) -> Column:
        at = F.call_function("instr", text, fix["origin"])
        usable = fix["origin"].isNotNull() & fix["replacement"].isNotNull() & (F.char_length(fix["origin"]) > 0) & (at > 0)
        return F.when(usable, F.overlay(text, fix["replacement"], at, F.char_length(fix["origin"]))).otherwise(text)

    return F.aggregate(fixes, code, one)


def fill(template: str, **values: Column) -> Column:
    """A prompt: each {name} of the template replaced in turn, white space trimmed."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return trim(out)


def _compiles(code: pd.Series, language: pd.Series) -> pd.Series:
    def score(text: str | None, lang: str | None) -> float | None:
        if lang == "java":
            return 0.0
        if lang != "python" or text is None:
            return None
        try:
            compile(text, "sample", "exec")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return 0.0
        return 1.0

    return pd.Series([score(c, x) for c, x in zip(code, language, strict=True)], dtype="float64")


def compiles(code: Column, language: Column) -> Column:
    """1 or 0 for Python text that parses or doesn't (it is never run); 0 for Java by definition; null for C, which needs a compiler."""
    return F.pandas_udf(_compiles, "double")(code, language)
