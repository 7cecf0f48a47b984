"""The note model: a path, its text, and a bag of typed properties.

A property keeps the type it had in YAML, as a tagged struct: ``kind`` is one of string,
list, bool, int (32 bits), double, null and other (longer integers, dates, mappings). Lists
keep their string elements and hold null for others; ``num`` is filled for int and double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where properties are looked up: the name of a map column, or a function of the key.
Props = str | Callable[[str], Column]
VALUE = "struct<kind:string,str:string,int:int,num:double,bool:boolean,list:array<string>,json:string>"
PROPS = f"map<string,{VALUE}>"
_FIELDS = {"kind": "string", "str": "string", "int": "int", "num": "double", "bool": "boolean", "list": "array<string>", "json": "string"}


def _value(kind: str, present: Column, **fields: Column) -> Column:
    made = F.struct(F.lit(kind).alias("kind"), *[fields.get(name, F.lit(None)).cast(t).alias(name) for name, t in _FIELDS.items() if name != "kind"])
    return F.when(present, made)


def string(c: Column) -> Column:
    return _value("string", c.isNotNull(), str=c)


def strings(c: Column) -> Column:
    return _value("list", c.isNotNull(), list=c)


def integer(c: Column) -> Column:
    return _value("int", c.isNotNull(), int=c, num=c)


def double(c: Column) -> Column:
    return _value("double", c.isNotNull(), num=c)


def boolean(c: Column) -> Column:
    return _value("bool", c.isNotNull(), bool=c)


def value_sql(kind: str, column: str, field: str) -> str:
    """The SQL of a typed value; its kind is null where the column is.

    The fields are the columns themselves, so that a test of one can reach the scan.
    """
    fields = ", ".join(f"'{name}', CAST({column if name == field or (name == 'num' and kind == 'int') else 'NULL'} AS {t})" for name, t in _FIELDS.items() if name != "kind")
    return f"named_struct('kind', IF({column} IS NOT NULL, '{kind}', NULL), {fields})"


def bag_sql(**columns: tuple[str, str]) -> str:
    """The SQL of ``bag`` for columns of a table: key -> (kind, column)."""
    field = {"string": "str", "list": "list", "int": "int", "double": "num", "bool": "bool"}
    return f"map({', '.join(f"'{key}', {value_sql(kind, column, field[kind])}" for key, (kind, column) in columns.items())})"


def bag(**values: Column) -> Column:
    """A property map; a key whose value is null counts as absent.

    It stays a plain map constructor, so that the optimiser replaces a lookup of a constant key
    by the value itself, and a comparison of its constant kind by its outcome.
    """
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def prop(name: str, props: Props = "props") -> Column:
    """The value struct of a property; it, or its kind, is null where the key is absent."""
    return F.col(props)[name] if isinstance(props, str) else props(name)


def has_key(name: str, props: Props = "props") -> Column:
    """Whether the key is there, also with YAML's null (a value of kind ``null``)."""
    return prop(name, props)["kind"].isNotNull()


def is_kind(v: Column, kind: str, field: str, test: Column) -> Column:
    """Whether the value is of the kind and passes a test of its field; never null, and plain enough for a scan."""
    return v["kind"].eqNullSafe(kind) & v[field].isNotNull() & test


def as_list(name: str, props: Props = "props") -> Column:
    """A list property, or a scalar string as a list of one; empty where there is neither."""
    v = prop(name, props)
    return F.coalesce(F.when(v["kind"] == "list", v["list"]).when(v["kind"] == "string", F.array(v["str"])), F.array().cast("array<string>"))


def number_text(x: Column) -> Column:
    """A number as text: without a point if it is whole."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def text(v: Column) -> Column:
    """A property value as text, as a view shows it."""
    return (
        F.when(v["kind"] == "string", v["str"])
        .when(v["kind"] == "list", F.concat(F.lit("["), F.array_join(v["list"], ", ", "nil"), F.lit("]")))
        .when(v["kind"] == "bool", v["bool"].cast("string"))
        .when(v["kind"].isin("int", "double"), number_text(v["num"]))
        .when(v["kind"] == "null", F.lit("nil"))
        .otherwise(v["json"])
    )
