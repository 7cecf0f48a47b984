"""Notes made of relational tables: one note per entity, foreign keys as links.

``NOTES_SQL`` is the same definition for DuckDB, as the head of a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import as_list, bag_sql, prop
from ..shared import spread


ROWS = """
SELECT concat('region/', r_name, '.md') AS path, r_name AS title, array('region', r_name) AS tags, CAST(NULL AS INT) AS size, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS acctbal, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS STRING) AS keytext, CAST(NULL AS BOOLEAN) AS instock, CAST(NULL AS ARRAY<STRING>) AS links FROM {region}
UNION ALL SELECT concat('nation/', n_name, '.md'), n_name, array('nation', r_name), NULL, NULL, NULL, NULL, NULL, NULL, array(concat('region/', r_name, '.md')) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('supplier/', s_suppkey, '.md'), s_name, array('supplier', n_name), NULL, NULL, s_acctbal, NULL, NULL, NULL, array(concat('nation/', n_name, '.md')) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT concat('customer/', c_custkey, '.md'), c_name, array('customer', c_mktsegment), NULL, NULL, c_acctbal, NULL, NULL, NULL, array(concat('nation/', n_name, '.md')) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT concat('part/', p_partkey, '.md'), p_name, array('part', p_type, p_brand), p_size, p_retailprice, NULL, NULL, CAST(p_partkey AS STRING), p_size % 2 = 0, NULL FROM {part}
UNION ALL SELECT concat('order/', o_orderkey, '.md'), NULL, array('order', o_orderpriority, o_orderstatus), NULL, NULL, NULL, o_totalprice, NULL, NULL, array(concat('customer/', o_custkey, '.md')) FROM {orders}
"""


def note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes' properties as plain columns (null where absent)."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier", "customer", "part", "orders")}
    return spark.sql(ROWS, **tables)


def notes(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] | None = None, dealt: bool = False) -> DataFrame:
    """The notes with their property maps (no text), of the named keys or of all.

    ``dealt`` deals the rows that pass the query's tests over tasks, for work that is dear beside the
    reading: a table's file is small for the rows that it holds, and one task would get all of them.
    """
    columns = dict(
        filePath=("string", "path"), title=("string", "title"), tags=("list", "tags"), size=("int", "size"), price=("double", "price"), acctbal=("double", "acctbal"),
        total=("double", "total"), keytext=("string", "keytext"), inStock=("bool", "instock"), links=("list", "links"),
    )
    props = bag_sql(**{k: v for k, v in columns.items() if keys is None or k in keys})
    rows = note_rows(spark, sf_dir)
    return (spread(rows) if dealt else rows).selectExpr("path", "'md' AS ext", "CAST(NULL AS STRING) AS raw", "CAST(NULL AS STRING) AS rendered", f"{props} AS props")


def as_markdown(structured: DataFrame) -> DataFrame:
    """(path, raw): each note written as a Markdown file with front matter, links and wikilinks."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise(F.lit(""))
    title, links = prop("title")["str"], as_list("links")
    matter = F.concat(
        F.lit("---\n"), line("title", quoted(title)), F.lit("tags:\n"), F.array_join(F.transform(as_list("tags"), lambda t: F.concat(F.lit("- "), quoted(t), F.lit("\n"))), ""),
        line("aliases", F.concat(F.lit("["), quoted(title), F.lit("]"))), line("size", prop("size")["int"].cast("string")), line("inStock", prop("inStock")["bool"].cast("string")), F.lit("---\n"),
    )
    body = F.concat(
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("see [it]("), x, F.lit(") and again [it]("), x, F.lit(")\n"))), ""),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("wiki [["), F.element_at(F.split(x, "/"), -1), F.lit("]] and [["), F.regexp_replace(F.element_at(F.split(x, "/"), -1), r"\.md$", ""), F.lit("|label]] but ~[["), F.element_at(F.split(x, "/"), -1), F.lit("]]\n"))), ""),
        F.lit("web [site](https://example.org/a) and [[no such note]]\n"),
    )
    return structured.select("path", F.concat(matter, body).alias("raw"))


NOTES_SQL = """WITH notes AS (
SELECT 'region/' || r_name || '.md' AS path, r_name AS title, ['region', r_name] AS tags, CAST(NULL AS INTEGER) AS size, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS acctbal, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS keytext, CAST(NULL AS BOOLEAN) AS instock, CAST(NULL AS VARCHAR[]) AS links FROM region
UNION ALL SELECT 'nation/' || n_name || '.md', n_name, ['nation', r_name], NULL, NULL, NULL, NULL, NULL, NULL, ['region/' || r_name || '.md'] FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier/' || s_suppkey || '.md', s_name, ['supplier', n_name], NULL, NULL, s_acctbal, NULL, NULL, NULL, ['nation/' || n_name || '.md'] FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'customer/' || c_custkey || '.md', c_name, ['customer', c_mktsegment], NULL, NULL, c_acctbal, NULL, NULL, NULL, ['nation/' || n_name || '.md'] FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'part/' || p_partkey || '.md', p_name, ['part', p_type, p_brand], p_size, p_retailprice, NULL, NULL, CAST(p_partkey AS VARCHAR), p_size % 2 = 0, NULL FROM part
UNION ALL SELECT 'order/' || o_orderkey || '.md', NULL, ['order', o_orderpriority, o_orderstatus], NULL, NULL, NULL, o_totalprice, NULL, NULL, ['customer/' || o_custkey || '.md'] FROM orders)"""
