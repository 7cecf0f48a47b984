import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import infill
from quillspark.llm.queries import op11_fill_in_middle


def brute(doc_id, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output), from the text as a list of code points."""
    text, units = text or "", list(text or "")
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in infill.MARKERS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "a", "é😀́\r\n\x00", "<P>", "x<S>y", "<M", "<", "<<P", ">", "S><P", " \n ", "日本語" * 50, "ab<" * 40, "long " * 60_000]


def test_same_as_brute_force(spark):
    rows = [(i, ODD[i % len(ODD)], "clash") for i in range(120)] + [(None, "no key", "c"), (7, "again", "c"), (7, "again", "c"), (-5, "negative", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string").withColumnRenamed("h1", "n")
    made = infill.transform(docs)
    got = made.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    own = sorted((repr(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got)
    want = sorted((repr(i), *brute(i, t), t or "") for i, t, _ in rows)
    assert [tuple(map(repr, x)) for x in own] == [tuple(map(repr, x)) for x in want]
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_units(spark):
    docs = spark.createDataFrame([(i, "  one two\tthree, four  \n five ") for i in range(60)], "doc_id long, text string")
    for pattern, ends in ((r"\S+", [0, 5, 9, 16, 21, 29]), (r"[^\n]*\n?", None)):
        rows = infill.transform(docs, pattern=pattern, seed=3).collect()
        assert {r["n"] for r in rows} == {len(list(re.finditer(pattern, "  one two\tthree, four  \n five ")))}
        cut = [r for r in rows if r["form"] != "plain"]
        assert cut
        if ends:
            assert {r["prefix_chars"] for r in cut} <= set(ends) and {r["prefix_chars"] + r["middle_chars"] for r in cut} <= set(ends)
    assert infill.transform(docs, share=0).where("form <> 'plain'").isEmpty()
    assert infill.transform(docs, share=100, spm_share=100).where("form <> 'spm'").isEmpty()


def test_an_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id int, text string, spm int")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(0, 80), st.integers(0, 80))
def test_the_iterator_stops_where_a_list_would(text, x, y):
    unit = re.compile(infill.CODE_POINT)
    n = infill.units(unit, text)
    low, high = sorted((x % (n + 1), y % (n + 1)))
    assert n == len(text) and infill.ends(unit, text, low, high) == (low, high)


@pytest.mark.parametrize("size", [1_000, 100_000])
def test_memory_does_not_follow_the_text(size):
    import tracemalloc

    unit, text = re.compile(infill.CODE_POINT), "x" * size
    tracemalloc.start()
    assert infill.units(unit, text) == size and infill.ends(unit, text, size // 3, size) == (size // 3, size)
    assert tracemalloc.get_traced_memory()[1] < 20_000
    tracemalloc.stop()


def test_the_query_has_sqls_rows(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = op11_fill_in_middle(spark, sf)
    want = con.sql(infill.oracle_sql()).select(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
