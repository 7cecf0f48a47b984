from functools import partial, reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.search import parse, search
from quillspark.operators.store import NoteStore, bucket_of
from quillspark.schema import PROPS, bag, boolean, double, integer, prop, string, strings
from quillspark.sources.vault import notes_from_files


@pytest.fixture(scope="module")
def kinds(spark):
    """Notes whose property ``k`` has every kind, and a rare one ``odd.key``."""
    rows = [("s", "x ab", None, None, None, None), ("l", None, ["ab", None, "cd"], None, None, None), ("i", None, None, 7, None, None), ("d", None, None, None, 7.0, None), ("b", None, None, None, None, True), ("n", None, None, None, None, None), ("num", "12", None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, s string, l array<string>, i int, d double, b boolean")
    c = F.col
    value = F.coalesce(string(c("s")), strings(c("l")), integer(c("i")), double(c("d")), boolean(c("b")))
    return df.select("path", bag(k=value, **{"odd.key": string(F.when(c("path") == "s", F.lit("once")))}, filePath=string(c("path"))).cast(PROPS).alias("props")).cache()


QUERIES = ["", "k=x+ab", "k=x*", "k=*ab", "k=a*", "k=ab", "k=*", "k=>b", "k=<d", "k=7", "k=>6", "k=<8", "k=true", "k=", "k", "!k=", "!k=ab", "k=*ab&!k=x*", "k=7.0", "other=1", "!other=1", "odd.key=once", "odd.key=", "!odd.key=once", "filePath=n*", "filePath=n*&k=>3"]


@pytest.mark.parametrize("share", [0.0, 0.5, 2.0])
def test_columns_do_not_change_what_is_found(spark, kinds, tmp_path, share):
    store = NoteStore(spark, f"{tmp_path}/s", buckets=3, least_share=share)
    store.init()
    store.save(kinds)
    assert store.manifest().keys == {0.0: ["filePath", "k", "odd.key"], 0.5: ["filePath", "k"], 2.0: []}[share]
    found = lambda of: sorted(map(tuple, reduce(DataFrame.union, [of(q, fixed_semantics=x).select(F.lit(q), F.lit(x), "path") for q in QUERIES for x in (False, True)]).collect()))
    assert found(store.search) == found(partial(search, kinds))
    with pytest.raises(Exception, match="not an integer"):
        store.search("k=seven", on_type_error="raise").collect()
    back = {r["path"]: {k: v.asDict() for k, v in r["props"].items()} for r in store.notes().collect()}
    assert back == {r["path"]: {k: v.asDict() for k, v in r["props"].items() if v and v["kind"]} for r in kinds.collect()}


def physical(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_reach_the_scan(spark, kinds, tmp_path):
    store = NoteStore(spark, f"{tmp_path}/s", buckets=2)
    store.init()
    store.save(kinds.select("path", bag(title=string(F.concat(F.lit("t"), "path")), size=integer(F.length("path")), filePath=string(F.col("path")), tags=strings(F.array(F.lit("x")))).cast(PROPS).alias("props")))
    at = {key: i for i, key in enumerate(store.manifest().keys)}
    plan = physical(store.search("title=tnum&size=>2").select("path"))
    assert f"EqualTo(p{at['title']}.str,tnum)" in plan and f"GreaterThan(p{at['size']}.int,2)" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "rest" not in schema and f"p{at['tags']}" not in schema and "bool" not in schema
    assert f"StringStartsWith(p{at['filePath']}.str,n)" in physical(store.search("filePath=n*").select("path"))
    assert f"IsNotNull(p{at['size']}.kind)" in physical(store.search("size=").select("path"))


def many(spark, n, extra=0):
    """Notes n: all have a hot tag, each its own tag and a link to the one before."""
    ids = spark.range(extra, n)
    path = lambda c: F.concat(F.lit("d/"), c.cast("string"), F.lit(".md"))
    tags = strings(F.array(F.lit("hot"), F.concat(F.lit("own"), F.col("id").cast("string")), F.lit("hot")))
    return ids.select(path(F.col("id")).alias("path"), bag(tags=tags, links=strings(F.array(path(F.col("id") - 1)))).cast(PROPS).alias("props"))


def test_few_files_are_read(spark, tmp_path):
    store = NoteStore(spark, f"{tmp_path}/s", buckets=32, slots=8)
    store.init()
    store.save(many(spark, 300))
    state = store.manifest()
    assert len(state.writes) == 32
    assert len(store.find_by_path("d/7.md").inputFiles()) == 1
    assert len(store.find_by_tag("own7").inputFiles()) == 1 and store.find_by_tag("own7").first()["path"] == "d/7.md"
    assert store.buckets_with("link", "d/7.md") == {bucket_of("d/8.md", 32)}
    assert [r["path"] for r in store.find_backlinks("d/7.md").collect()] == ["d/8.md"]
    assert len(store.find_backlinks("d/7.md").inputFiles()) == 1
    assert len(store.search("tags=hot&tags=own9").inputFiles()) == 1 and store.search("tags=hot&tags=own9").count() == 1
    assert store.search("tags=own9&tags=own8").count() == 0
    assert [r["path"] for r in store.outgoing("d/9.md").collect()] == ["d/8.md"]
    # The hot tag has a row for each bucket, and its slot is read alone.
    hot = store.terms().where("kind = 'tag' and term = 'hot'")
    assert hot.count() == 32 and hot.agg(F.sum("n")).first()[0] == 300 and store.find_by_tag("hot").count() == 300
    slot = hot.first()["slot"]
    scan = physical(store.terms().where((F.col("slot") == slot) & (F.col("term") == "hot")))
    assert f"PartitionFilters: [isnotnull(slot" in scan and "EqualTo(term,hot)" in scan  # noqa: F541
    assert {r["term"]: r["n"] for r in store.counts("tag").where("n > 1").collect()} == {"hot": 300}
    assert store.find_by_tag("none").collect() == [] and store.find_by_id("zz").collect() == []


def test_a_change_writes_the_buckets_it_touches(spark, tmp_path):
    store = NoteStore(spark, f"{tmp_path}/s", buckets=8)
    store.init()
    store.save(many(spark, 60))
    before = store.manifest()
    assert store.save(many(spark, 60)).count() == 0 and store.versions() == [1, 2]
    saved = store.save(many(spark, 61))
    assert [r["path"] for r in saved.collect()] == ["d/60.md"]
    after = store.manifest()
    moved = {b for b in after.writes if after.writes[b] != before.writes.get(b)}
    assert moved == {bucket_of("d/60.md", 8)}
    own = [p.name for p in (tmp_path / "s" / "rows" / f"write={after.writes[moved.pop()]}").glob("bucket=*")]
    assert own == [f"bucket={bucket_of('d/60.md', 8)}"]
    # The time of creation stays, the index follows.
    first = store.find_by_path("d/5.md").first()
    store.update(notes_from_files(spark.createDataFrame([("d/5.md", "---\ntags: [fresh]\n---\n")], "path string, raw string")))
    again = store.find_by_path("d/5.md").first()
    assert again["created_at"] == first["created_at"] and again["updated_at"] > first["updated_at"]
    assert store.find_by_tag("own5").collect() == [] and [r["path"] for r in store.find_by_tag("fresh").collect()] == ["d/5.md"]
    assert store.counts("tag").where("term = 'hot'").first()["n"] == 60
    # Earlier versions are as they were, until they are removed.
    assert [r["path"] for r in store.at(before.number).find_by_tag("own5").collect()] == ["d/5.md"]
    assert store.at(before.number).find_all().count() == 60 and store.find_all().count() == 61
    with pytest.raises(ValueError, match="for reading"):
        store.at(before.number).save(many(spark, 70))
    store.compact()
    store.vacuum(1)
    assert store.find_all().count() == 61 and len(list((tmp_path / "s" / "rows").glob("write=*"))) == 1
    with pytest.raises(KeyError):
        store.at(before.number).manifest()


def test_a_writer_that_loses_changes_nothing(spark, tmp_path, monkeypatch):
    store, other = (NoteStore(spark, f"{tmp_path}/s", buckets=4) for _ in range(2))
    store.init()
    store.save(many(spark, 10))
    old = store.manifest()
    other.save(many(spark, 12))
    monkeypatch.setattr(store, "manifest", lambda: old)  # it began before the other ended
    with pytest.raises(RuntimeError, match="another writer"):
        store.save(many(spark, 14))
    monkeypatch.undo()
    assert store.find_all().count() == 12 and store.versions() == [1, 2, 3]
    assert not list((tmp_path / "s").glob("next-*")) and not list((tmp_path / "s").glob("version-*/next-*"))
    monkeypatch.setattr(store, "_commit", lambda made: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        store.save(many(spark, 20))
    assert other.find_all().count() == 12
    other.vacuum(1)
    assert other.find_all().count() == 12


def test_batches_are_applied_once(spark, tmp_path):
    store = NoteStore(spark, f"{tmp_path}/s", buckets=4)
    store.init()
    one = lambda path, title: spark.createDataFrame([(path, title)], "path string, t string").select("path", bag(title=string(F.col("t"))).cast(PROPS).alias("props"))
    assert store.apply(one("a", "first"), batch=("in", 0)) and store.apply(one("b", "second").union(one("a", "third")), batch=("in", 1))
    assert not store.apply(one("a", "late"), batch=("in", 1)) and not store.apply(one("a", "late"), batch=("in", 0))
    assert store.apply(one("c", "other"), one("b", "").select("path"), batch=("else", 0))
    assert {r["path"]: r["t"] for r in store.notes().select("path", prop("title")["str"].alias("t")).collect()} == {"a": "third", "c": "other"}


def test_odd_rows(spark, tmp_path):
    store = NoteStore(spark, f"{tmp_path}/s", buckets=2)
    store.init()
    assert store.find_all().collect() == [] and store.terms().collect() == [] and store.notes().collect() == [] and store.search("a=1").collect() == []
    none = spark.createDataFrame([], f"path string, props {PROPS}")
    assert store.save(none).collect() == [] and store.versions() == [1]
    rows = [("", "x"), ("ä/ö.md", "y"), ("twice", "b"), ("twice", "a"), (None, "z"), ("bare", None)]
    df = spark.createDataFrame(rows, "path string, t string").select("path", bag(title=string(F.col("t"))).cast(PROPS).alias("props"))
    assert store.save(df).count() == 4
    assert {r["path"]: r["t"] for r in store.notes().select("path", prop("title")["str"].alias("t")).collect()} == {"": "x", "ä/ö.md": "y", "twice": "a", "bare": None}
    assert store.find_by_path("ä/ö.md").count() == 1 and parse("title=") and store.search("title=").count() == 3
    store.apply(none, df.select("path"))
    assert store.find_all().collect() == [] and store.manifest().writes == {}
