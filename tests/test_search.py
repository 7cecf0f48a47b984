import pytest
from pyspark.sql import functions as F

from quillspark.operators.search import parse, predicate, search
from quillspark.schema import PROPS, bag, boolean, double, integer, string, strings


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        ("s", "x ab", None, None, None, None),
        ("l", None, ["ab", None, "cd"], None, None, None),
        ("i", None, None, 7, None, None),
        ("d", None, None, None, 7.0, None),
        ("b", None, None, None, None, True),
        ("n", None, None, None, None, None),
        ("num", "12", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "path string, s string, l array<string>, i int, d double, b boolean")
    c = F.col
    value = F.coalesce(string(c("s")), strings(c("l")), integer(c("i")), double(c("d")), boolean(c("b")))
    return df.select("path", bag(k=value, filePath=string(c("path"))).alias("props")).cache()


def hits(notes, query, **options):
    return sorted(r["path"] for r in search(notes, query, **options).collect())


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("", ["b", "d", "i", "l", "n", "num", "s"]),
        ("k=x+ab", ["s"]),
        ("k=x*", ["s"]),
        ("k=*ab", ["l", "s"]),
        ("k=a*", ["l"]),
        ("k=ab", ["l"]),
        ("k=*", ["l", "num", "s"]),
        ("k=>b", ["l"]),
        ("k=<d", ["l"]),
        ("k=7", ["i"]),
        ("k=>6", ["i", "num"]),
        ("k=<8", ["i"]),
        ("k=true", ["b"]),
        ("k=", ["b", "d", "i", "l", "num", "s"]),
        ("k", ["b", "d", "i", "l", "num", "s"]),
        ("!k=", ["b", "d", "i", "l", "n", "num", "s"]),
        ("!k=ab", ["b", "d", "i", "n", "num", "s"]),
        ("k=*ab&!k=x*", ["l"]),
        ("k=7.0", []),
        ("other=1", []),
    ],
)
def test_truth_table(notes, query, found):
    assert hits(notes, query) == found


def test_intended_semantics(notes):
    assert hits(notes, "!k=", fixed_semantics=True) == ["n"]
    assert hits(notes, "k=<20", fixed_semantics=True) == ["i", "num"]


def test_type_errors_can_raise(notes):
    with pytest.raises(Exception, match="not an integer"):
        search(notes, "k=seven", on_type_error="raise").collect()


@pytest.mark.parametrize("odd", ["--5", "²", ">--1", "4294967296", ">99999999999999999999", "+", "<"])
def test_odd_numbers_are_type_errors(notes, odd):
    from urllib.parse import quote_plus

    assert hits(notes, f"k={quote_plus(odd)}") in ([], ["l"])
    with pytest.raises(Exception, match="not an integer"):
        search(notes, f"k={quote_plus(odd)}", on_type_error="raise").collect()


def test_parse():
    assert parse("a=1&&a=2&b&=c&d=%zz&e=%20f") == {"a": ["1", "2"], "b": [""], "=c": [""], "d": ["%zz"], "e": [" f"]}


def test_null_values_are_present(spark):
    df = spark.sql("SELECT from_json('{\"k\": {\"kind\": \"null\"}}', '" + PROPS + "') AS props")
    assert df.where(predicate("k=")).count() == 1
    assert df.where(predicate("k=x")).count() == 0


def test_constant_kinds_fold_away(spark):
    df = spark.range(1).select(bag(tags=strings(F.array(F.lit("a"), F.col("id").cast("string")))).alias("props"))
    plan = search(df, "tags=a")._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan.split("Filter")[-1]


@pytest.mark.parametrize(("query", "pushed"), [("title=cold+widget", "EqualTo(p_name,cold widget)"), ("title=cold*", "StringStartsWith(p_name,cold)"), ("size=7", "EqualTo(p_size,7)"), ("size=>6&!title=x", "GreaterThan(p_size,6)")])
def test_a_search_reaches_the_scan(spark, query, pushed):
    from quillspark.sources.tables import notes as made

    assert pushed in search(made(spark, "/root/testdata/sf0.001"), query).select("path")._jdf.queryExecution().toString()
