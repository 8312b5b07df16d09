"""Parsers of answers and confidences: Column expressions only.

A response ends in one JSON object with exactly one expected key. The object begins at the last opening brace; version 1 wants nothing after
it, version 2 allows exactly three backticks. Duplicate keys, other types and values out of range are invalid.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From the last opening brace to the end, and there: an object without inner objects, strings read as such, then what follows it.
SUFFIX = r"(?s)^.*(\{.*)$"
OBJECT = r"(?s)^(\{(?:[^{}\"]++|\"(?:[^\"\\]++|\\.)*+\")*+\})(.*)$"


def terminal_object(text: Column, fence: bool) -> Column:
    """The JSON text of the last object, or null where there is none or something follows it."""
    suffix = F.regexp_extract(text, SUFFIX, 1)
    obj, rest = F.regexp_extract(suffix, OBJECT, 1), F.trim(F.regexp_replace(F.regexp_extract(suffix, OBJECT, 2), r"\s+", " "))
    ok = (rest == "") | (F.lit(fence) & (rest == "```"))
    return F.when((obj != "") & ok, obj)


def _value(text: Column, key: str, fence: bool) -> tuple[Column, Column]:
    obj = terminal_object(text, fence)
    variant = F.try_parse_json(obj)
    keys = F.json_object_keys(obj)
    alone = (F.size(keys) == 1) & (F.get(keys, F.lit(0)) == key)
    return F.when(alone, F.schema_of_variant(F.try_variant_get(variant, f"$.{key}", "variant"))), variant


def answer(text: Column, fence: bool = True) -> Column:
    """The answer, null where it is invalid: exactly one key 'answer' with a string of at least one character."""
    kind, variant = _value(text, "answer", fence)
    got = F.try_variant_get(variant, "$.answer", "string")
    return F.when((kind == "STRING") & (F.length(got) >= 1), got)


def identity_answer(text: Column) -> Column:
    """The text itself, null where it is blank."""
    return F.when(F.length(F.regexp_replace(text, r"\s+", "")) > 0, text)


def confidence(text: Column, fence: bool = True) -> Column:
    """The confidence, null where it is invalid: exactly one key 'confidence' with a JSON number from 0 to 1. Booleans and strings are none."""
    kind, variant = _value(text, "confidence", fence)
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    got = F.try_variant_get(variant, "$.confidence", "double")
    return F.when(number & (got >= 0) & (got <= 1), got)


#: Parsers of confidences by version: version 1 wants nothing after the object, version 2 allows a closing fence.
CONFIDENCE_PARSERS: dict[str, Callable[[Column], Column]] = {"v1": lambda t: confidence(t, fence=False), "v2": lambda t: confidence(t, fence=True)}
#: Parsers of answers by version: version 0 takes the text as it is.
ANSWER_PARSERS: dict[str, Callable[[Column], Column]] = {"v0": lambda t: identity_answer(t), "v1": lambda t: answer(t, fence=False), "v2": lambda t: answer(t, fence=True)}


def first_difference(left: Column, right: Column) -> Column:
    """The path of the first entry, keys in order, in which two JSON objects differ; null where they are alike, '$' where one is no object."""

    def walk(a: dict, b: dict, trail: tuple[str, ...]) -> str | None:
        left_over = [(key, a.get(key), b.get(key)) for key in sorted(a.keys() | b.keys()) if a.get(key) != b.get(key)]
        if not left_over:
            return None
        key, x, y = left_over[0]
        deeper = walk(x, y, (*trail, key)) if isinstance(x, dict) and isinstance(y, dict) else None
        return deeper or ".".join((*trail, key))

    @F.pandas_udf("string")
    def compare(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            try:
                a, b = json.loads(x or "null"), json.loads(y or "null")
            except ValueError:
                a = b = None
            out.append(walk(a, b, ()) if isinstance(a, dict) and isinstance(b, dict) else None if x == y else "$")
        return pd.Series(out, index=xs.index, dtype="object")

    return compare(left, right)


def exact_match(given: Column, wanted: Column) -> Column:
    """Equality of trimmed, case-folded text; a missing answer is wrong, a missing key pending (null)."""
    fold = lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(wanted.isNotNull(), F.coalesce(fold(given) == fold(wanted), F.lit(False)))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each {name} replaced once by its column. Values are never scanned for placeholders, since the template is cut first."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = sorted((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest)
        if not found:
            parts.append(F.lit(rest))
            break
        at, key = found[0]
        parts += [F.lit(rest[:at]), values[key]]
        rest = rest[at + len(key) + 2 :]
    if any(template.count("{" + k + "}") != 1 for k in values):
        raise ValueError("each placeholder must stand in the template exactly once")
    return F.concat(*parts)


def shared_prefix(a: Column, b: Column) -> Column:
    """The number of characters that two texts have in common at their beginning."""
    n = F.least(F.length(a), F.length(b))
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), False)
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def choices(options: Column) -> Column:
    """'A. first' to the last option, one a line."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


#: Scorers by name: each takes the given and the wanted text and gives right, wrong, or null while pending.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "exact": exact_match,
    "letter": lambda given, wanted: exact_match(F.regexp_extract(given, r"^\W*([A-Za-z])\b", 1), wanted),
    "external": lambda given, wanted: F.lit(None).cast("boolean"),
}
