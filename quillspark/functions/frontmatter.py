"""YAML front matter as typed properties.

Spark cuts the block out of the text; a small vectorised function turns its YAML into JSON
in the property model's shape, and Spark reads that as the property map. Blocks that are
missing, empty, invalid or not a mapping give null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import PROPS

# Fixed value: a block between two lines of three dashes at the very start.
BLOCK = r"(?sm)\A---\s*$(.*?)^---\s*$"


# A double-quoted text without escapes or line breaks, and a block made only of one-line entries:
# keys with such a text, a list of them or a plain word, and list items. In such a block every quoted text is
# a value of its own, so what it says has no bearing on how the rest is read.
QUOTED = r'"([ !#-\[\]-~\u00a1-\u1fff]{0,500})"'
_QUOTED = re.compile(QUOTED)
_ANY = QUOTED.replace("(", "(?:", 1)
_PLAIN_BLOCK = re.compile(rf"\s*(?:(?:- {_ANY}|[A-Za-z]\w{{0,99}}:(?: (?:{_ANY}|\[{_ANY}(?:, {_ANY})*\]|[\w.+-]{{1,100}}))?)\n+)+", re.ASCII)
#: Forms of blocks that a worker keeps.
FORMS = 10_000
_forms: dict[str, list[str] | None] = {}


def typed(value) -> dict:
    """One YAML value in the property model."""
    if value is None:
        return {"kind": "null"}
    if isinstance(value, bool):
        return {"kind": "bool", "bool": value}
    if isinstance(value, int):
        return {"kind": "int", "int": value, "num": float(value)} if -(1 << 31) <= value < 1 << 31 else {"kind": "other", "json": str(value)}
    if isinstance(value, float):
        return {"kind": "double", "num": value} if value == value and abs(value) != float("inf") else {"kind": "other", "json": str(value)}
    if isinstance(value, str):
        return {"kind": "string", "str": value}
    if isinstance(value, list):
        return {"kind": "list", "list": [x if isinstance(x, str) else None for x in value]}
    return {"kind": "other", "json": json.dumps(value, default=str)}


def yaml_to_json(block: str | None) -> str | None:
    import yaml

    if not block or not block.strip():
        return None
    try:
        found = yaml.load(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None
    return json.dumps({str(k): typed(v) for k, v in found.items()}) if isinstance(found, dict) and found else None


def block_to_json(block: str | None) -> str | None:
    """``yaml_to_json``, with blocks that differ in quoted texts only read once as YAML.

    The quoted texts are numbered, and the JSON of that form is cut where they go.
    """
    if not block or not _PLAIN_BLOCK.fullmatch(block):
        return yaml_to_json(block)
    parts = _QUOTED.split(block)  # every second one is a quoted text
    form = '"@"'.join(parts[::2])
    if form not in _forms:
        if len(_forms) >= FORMS:
            _forms.clear()
        numbered = "".join(x if i % 2 == 0 else f'"@{i // 2}@"' for i, x in enumerate(parts))
        found = yaml_to_json(numbered)
        # Pieces of JSON and numbers of texts in turn: a text that a repeated key hides is not there.
        _forms[form] = None if found is None else re.split(r'"@(\d+)@"', found)
    pieces = _forms[form]
    if pieces is None:
        return None
    return "".join([x if i % 2 == 0 else json.dumps(parts[2 * int(x) + 1]) for i, x in enumerate(pieces)])


@F.pandas_udf(StringType())
def _parsed(blocks: pd.Series) -> pd.Series:
    # Blocks made from one template are often equal: each is read once for a batch.
    number, distinct = pd.factorize(blocks, use_na_sentinel=False)
    found = pd.Series([block_to_json(None if pd.isna(b) else b) for b in distinct], dtype=object)
    return found.take(number).reset_index(drop=True)


#: Called non-deterministic so that the optimiser keeps one call where a filter and a projection use it.
_parsed = _parsed.asNondeterministic()


def front_matter_json(text: Column) -> Column:
    """The properties of a note's front matter as JSON, or null; a test for null need not read the JSON."""
    return _parsed(F.regexp_extract(text, BLOCK, 1))


def front_matter(text: Column) -> Column:
    """The property map of a note's front matter, or null."""
    return F.from_json(front_matter_json(text), PROPS)
