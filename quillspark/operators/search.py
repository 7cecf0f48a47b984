"""Property search by query strings such as ``tags=a&title=x*&!status=done``.

All pairs must hold; a key that begins with ``!`` rejects notes that match it. What a
value means depends on the property's type:

========  ==============  ============  ===============  ================  =========
kind      ``v*``          ``*v``        ``>v``           ``<v``            ``v``
========  ==============  ============  ===============  ================  =========
string    begins with     ends with     integers, >      never             equal
list      some begins     some ends     some ends        some ends         contains
bool      false           false         false            false             equal
int       type error      type error    >                <                 equal
other     never           never         never            never             never
========  ==============  ============  ===============  ================  =========

An empty value asks for the key's presence; ``!k=`` passes where the key is absent and
otherwise compares with the empty text. ``fixed_semantics`` gives what was meant instead:
``<`` on strings, comparisons on lists' numbers, and ``!k=`` as absence.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from functools import reduce
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Props, has_key, is_kind, prop

INTEGER = r"^[+-]?[0-9]+$"
INT32 = range(-(1 << 31), 1 << 31)


def _decoded(part: str) -> str:
    """URL-decoded, or as it stands if an escape is bad."""
    for i, c in enumerate(part):
        if c == "%" and not (len(part) >= i + 3 and all(x in "0123456789abcdefABCDEF" for x in part[i + 1 : i + 3])):
            return part
    return unquote_to_bytes(part.replace("+", " ")).decode("utf-8", "replace")


def parse(query: str | None) -> dict[str, list[str]]:
    """Keys and their values; a pair without ``=`` (or with nothing before it) is a key alone."""
    out: dict[str, list[str]] = {}
    for pair in (query or "").split("&"):
        if pair:
            at = pair.find("=")
            key, value = (pair[:at], pair[at + 1 :]) if at > 0 else (pair, "")
            out.setdefault(_decoded(key), []).append(_decoded(value))
    return out


def _int(c: Column) -> Column:
    return F.when(c.rlike(INTEGER), c.try_cast("int"))


def _whole(text: str) -> int | None:
    """The 32-bit integer that a text is, if it is one."""
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) and len(text) < 20 and int(text) in INT32 else None


def matches(key: str, value: str, props: Props = "props", on_type_error: str = "false", fixed_semantics: bool = False, kinds: Collection[str] | None = None) -> Column:
    """Whether the property matches the value; never null. ``kinds``: those that the key has at all, if known."""
    v = prop(key, props)
    s, items = v["str"], v["list"]
    number = _whole(value[1:]) if value[:1] in ("<", ">") else None
    plain = _whole(value)
    bad = F.raise_error(F.lit(f"not an integer for property {key}: {value}")).cast("boolean") if on_type_error == "raise" else F.lit(False)
    if value.endswith("*"):
        text, any_of, whole = s.startswith(value[:-1]), F.exists(items, lambda x: x.startswith(value[:-1])), bad
    elif value.startswith("*"):
        text, any_of, whole = s.endswith(value[1:]), F.exists(items, lambda x: x.endswith(value[1:])), bad
    elif value[:1] in ("<", ">"):
        more = value[0] == ">"
        compare = lambda c: F.lit(False) if number is None else c > number if more else c < number
        text = F.coalesce(compare(_int(s)), F.lit(False)) if more or fixed_semantics else F.lit(False)
        any_of = F.exists(items, lambda x: compare(_int(x))) if fixed_semantics else F.exists(items, lambda x: x.endswith(value[1:]))
        whole = bad if number is None else compare(v["int"])
    else:
        text, any_of = s == value, F.array_contains(items, value)
        whole = bad if plain is None else v["int"] == plain
    # A type error is raised inside a case, as the optimiser may change the order of plain conditions.
    raises = whole is bad and on_type_error == "raise"
    tests = {
        "string": is_kind(v, "string", "str", text),
        "list": is_kind(v, "list", "list", F.coalesce(any_of, F.lit(False))),
        "bool": is_kind(v, "bool", "bool", v["bool"] == F.lit(value.lower() == "true")),
        "int": F.coalesce(F.when(v["kind"] == "int", whole), F.lit(False)) if raises else is_kind(v, "int", "int", whole),
    }
    own = [test for kind, test in tests.items() if kinds is None or kind in kinds]
    return reduce(lambda a, b: a | b, own) if own else F.lit(False)


def predicate(query: str | dict[str, list[str]] | None, props: Props = "props", on_type_error: str = "false", fixed_semantics: bool = False, kinds: dict[str, Collection[str]] | None = None) -> Column:
    """The whole query as one condition, so that it is part of the scan's plan.

    ``kinds``: for some keys, the kinds that their values have; tests of other kinds are left out.
    """
    params = query if isinstance(query, dict) else parse(query)
    test = lambda key, value: matches(key, value, props, on_type_error, fixed_semantics, (kinds or {}).get(key))
    tests = []
    for key, values in params.items():
        for value in values:
            if not key.startswith("!"):
                tests.append(has_key(key, props) if value == "" else test(key, value))
            elif value == "":
                tests.append(~has_key(key[1:], props) | (F.lit(False) if fixed_semantics else ~test(key[1:], "")))
            else:
                tests.append(~test(key[1:], value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def search(notes: DataFrame, query: str | dict[str, list[str]] | None, **options) -> DataFrame:
    """The notes that match the query."""
    return notes.where(predicate(query, **options))


def project(notes: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Keep the included properties (all if none are named), then drop the excluded ones."""
    test = lambda k, v: v["kind"].isNotNull() & (k.isin(list(include)) if include else F.lit(True)) & (~k.isin(list(exclude)) if exclude else F.lit(True))
    return notes.withColumn("props", F.map_filter("props", test))


def listing(notes: DataFrame, query: str = "") -> DataFrame:
    """Search results without their text."""
    return project(search(notes, query), exclude=["content"])


GRAPH_KEYS = ["links", "backlinks", "tags", "filePath"]


def graph_listing(notes: DataFrame, query: str = "") -> DataFrame:
    """Search results with the properties of a graph's nodes."""
    return project(search(notes, query), include=GRAPH_KEYS)
