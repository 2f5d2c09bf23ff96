"""Field values out of model-made JSON, always as text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from formlake.functions.text import let


_JAVA_BLANKS = " \t\n\x0b\f\r"


def outermost_object(c: Column) -> Column:
    """From the first opening to the last closing brace, '' without one."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def quote_bare(c: Column) -> Column:
    """Bare scalars in quotes, so that leading zeros and decimals survive; null, true and false stay."""
    return F.regexp_replace(c, r'(:\s*)(?!null\b|true\b|false\b)([^\s"\[\]{},][^,}\]\n"]*?)(\s*[,}])', '$1"$2"$3')


def fields_of(c: Column) -> Column:
    """Map of a JSON object's fields to their texts; null where it cannot be read."""
    return F.from_json(quote_bare(outermost_object(c)), "map<string,string>")


def extra_keys(keys: Column, known: list[str]) -> Column:
    """Keys beyond the known ones, in order."""
    return F.array_sort(F.array_except(keys, F.array(*map(F.lit, known))))


def _located(key: str) -> tuple[str, str]:
    """Patterns for a key with its value, and for the key alone: a string with escapes, an array, or anything up to a comma, brace or line end."""
    head = rf'"{re.escape(key)}"\s*:\s*'
    string = r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"'
    return rf"{head}(?:{string}|\[[^\]]*\]|[^,}}\n]*)", f"^{head}"


def value_span(c: Column, key: str) -> Column:
    """Where a key's value stands in a raw text, well-formed JSON or not: struct<kind, s, e, outer_s, outer_e, raw>, null without the key.

    Offsets count characters from 0, the end excluded. Of repeated keys the last
    counts, as for a JSON reader. ``kind`` is string, array or bare; a string's outer
    span includes its quotes, a bare value has no blanks around it. A lone match
    stands where its text does first; behind the last of several stands the last
    piece of the text split at all of them.
    """
    whole, head = _located(key)

    def of(found: Column) -> Column:
        match = F.element_at(found, -1)
        behind = lambda: F.element_at(F.split(c, whole, -1), -1)
        end = F.when(F.size(found) == 1, F.call_function("instr", c, match) - 1 + F.length(match)).otherwise(F.length(c) - F.length(behind()))
        placed = F.struct(F.regexp_replace(match, head, "").alias("body"), end.alias("end"))
        return F.when(F.size(found) > 0, let(placed, told))

    def told(at: Column) -> Column:
        body, start = at["body"], at["end"] - F.length(at["body"])
        wrapped = lambda a, b: F.startswith(body, F.lit(a)) & F.endswith(body, F.lit(b)) & (F.length(body) >= 2)

        def span(kind: str, s: Column, raw: Column, outer: int = 0) -> Column:
            e = s + F.length(raw)
            return F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), (s - outer).alias("outer_s"), (e + outer).alias("outer_e"), raw.alias("raw"))

        inside = F.substring(body, F.lit(2), F.length(body) - 2)
        bare = let(F.regexp_replace(body, r"\s+\z", ""), lambda b: let(F.regexp_replace(b, r"^\s+", ""), lambda x: span("bare", start + F.length(b) - F.length(x), x)))
        return F.when(wrapped('"', '"'), span("string", start + 1, inside, 1)).when(wrapped("[", "]"), span("array", start, body)).otherwise(bare)

    return let(F.regexp_extract_all(c, F.lit(whole), 0), of)


def text_spans(keys: Sequence[str]) -> Callable[[str], list[tuple[str, int, int, int] | None]]:
    """``value_span`` of each key over a text in Python: (kind, s, e, how far the outer span goes beyond)."""
    patterns = [(f'"{key}"', re.compile(whole, re.ASCII), re.compile(head, re.ASCII)) for key, (whole, head) in zip(keys, map(_located, keys), strict=True)]

    def one(text: str, name: str, whole: re.Pattern, head: re.Pattern) -> tuple[str, int, int, int] | None:
        if name not in text:
            return None
        match = None
        for match in whole.finditer(text):
            pass
        if match is None:
            return None
        body = match[0][head.match(match[0]).end() :]
        end = match.end()
        start = end - len(body)
        if len(body) >= 2 and body[0] == body[-1] == '"':
            return "string", start + 1, end - 1, 1
        if len(body) >= 2 and body[0] == "[" and body[-1] == "]":
            return "array", start, end, 0
        bare = body.rstrip(_JAVA_BLANKS)
        first = start + len(bare) - len(bare.lstrip(_JAVA_BLANKS))
        return "bare", first, start + len(bare), 0

    return lambda text: [one(text, *p) for p in patterns]


def value_as_parsed(span: Column, separator: str = " ") -> Column:
    """What a JSON reader makes of a span's text, an array's elements joined; null where it can't be read."""
    string = F.from_json(F.concat(F.lit('{"v":"'), span["raw"], F.lit('"}')), "v string", {"mode": "PERMISSIVE"})["v"]
    array = F.from_json(span["raw"], "array<string>")
    return F.btrim(F.when(span["kind"] == "string", string).when(span["kind"] == "array", F.array_join(array, separator)).otherwise(span["raw"]))
