import duckdb
import pytest

from quillspark.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", ["search_tag_and_path", "search_absence_quirk_bool", "graph_neighbourhood", "wikilink_rewrite", "view_formula", "formula_bodies", "expression_text_functions", "base_convert_and_run", "json_rows"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    found = con.sql(ORACLES[name])
    assert columns == sorted(found.columns)
    assert plain(got.select(*columns).collect()) == plain(found.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
