import pytest
from pyspark.sql import functions as F

from quillspark.operators import export, graph, links, views
from quillspark.operators.store import NoteStore
from quillspark.plans.pipeline import changes, update, worklist
from quillspark.schema import prop, text
from quillspark.shared import materialize
from quillspark.sources.vault import load_errors, notes_from_files, read_files, read_vault


def vault(spark, files):
    return notes_from_files(spark.createDataFrame(list(files.items()), "path string, raw string"))


@pytest.fixture(scope="module")
def notes(spark):
    return update(vault(spark, {
        "A.md": "---\ntitle: First\ntags: [x, y]\naliases: [Alpha]\n---\n[to](B.md) [web](https://a.b) [[B]] ~[[B]] [[none|n]]\n",
        "B.md": "---\ntags: y\nn: 42\nbig: 99999999999\nf: 1.5\nd: 2024-01-01\nm: {a: 1}\nz: null\nb: yes\nmix: [a, 5]\n---\n[[Alpha|first]]\n",
        "sub/C.md": "---\ntags: [z]\nlinks: [A.md]\n---\nnothing\n",
        "dropped.md": "no front matter",
        "empty.md": "---\n---\n",
        "V.md": '---\ntags: [v]\n---\nT:\n```base\nviews:\n  - type: table\n    filters:\n      and:\n        - file.tags.containsAny("x")\n    order:\n      - file.name\n      - file.tags\n```\nend\n```base\nviews: 3\n```\n',
        "pic.png": "ignored",
    })).cache()


def test_admission_and_kinds(notes):
    assert sorted(r["path"] for r in notes.collect()) == ["A.md", "B.md", "V.md", "pic.png", "sub/C.md"]
    kinds = notes.where("path = 'B.md'").first()["props"]
    assert {k: v["kind"] for k, v in kinds.items()} == {"tags": "string", "n": "int", "big": "other", "f": "double", "d": "other", "m": "other", "z": "null", "b": "bool", "mix": "list", "filePath": "string", "links": "list"}
    assert kinds["mix"]["list"] == ["a", None]


def test_links_and_wikilinks(notes):
    a = notes.where("path = 'A.md'").first()
    assert a["rendered"].endswith("[to](B.md) [web](https://a.b) [B](B.md) ~[[B]] [[none|n]]\n")
    assert a["props"]["links"]["list"] == ["B.md"]
    b = notes.where("path = 'B.md'").first()
    assert b["rendered"].endswith("[first](A.md)\n") and b["props"]["links"]["list"] == ["A.md"]
    assert notes.where("path = 'sub/C.md'").first()["props"]["links"]["list"] == ["A.md"]


def test_embedded_views(notes):
    v = notes.where("path = 'V.md'").first()["rendered"]
    # The view's [[A.md]] is a wikilink by then, and is resolved in its turn.
    assert v == "---\ntags: [v]\n---\nT:\n| filePath | tags |\n|---|---|\n| [A.md](A.md) | #x #y |\n\nend\n\n"


def test_graph(notes):
    assert sorted(r["path"] for r in graph.neighbourhood(notes, "tags=x").collect()) == ["A.md", "B.md"]
    assert {r["path"]: r["backlinks"] for r in graph.backlinks(notes).collect()} == {"A.md": ["B.md", "V.md", "sub/C.md"], "B.md": ["A.md"]}
    assert {r["path"]: r["depth"] for r in graph.within(notes, "filePath=sub/C.md", 2).collect()} == {"sub/C.md": 0, "A.md": 1, "B.md": 2}


def test_tags_as_queries(spark):
    n = vault(spark, {"a.md": "---\ntags: ['x*']\n---\n", "b.md": "---\ntags: [xyz]\n---\n", "c.md": "---\ntags: [y]\n---\n"})
    assert [r["path"] for r in graph.neighbourhood(n, "filePath=a.md").collect()] == ["a.md"]
    assert sorted(r["path"] for r in graph.neighbourhood(n, "filePath=a.md", compat_tag_query=True).collect()) == ["a.md", "b.md"]


def test_ambiguous_names(spark):
    n = vault(spark, {"x/N.md": "---\na: 1\n---\n", "y/N.md": "---\na: 1\n---\n", "Q.md": "---\na: 1\n---\n[[N]] [[/N.md]] [[x/N]]"})
    found = links.resolve(links.wikilinks(n), links.name_dictionary(n)).orderBy("pos").collect()
    assert [(r["path"], r["ambiguous"]) for r in found] == [("x/N.md", True), ("x/N.md", True), (None, False)]


TOOLS = """
formulas:
  weight: 'return string.format("%.1f kg", file:get("kg"))'
  load: 'return getPropertyValue(file, "kg", 0) * getPropertyValue(file, "pieces", 1)'
views:
  - type: table
    filters:
      or:
        - 'hasPropertyValue(file, "shelf", "north") and load(file) < 100'
        - 'file:get("owner") == "Ada"'
    order:
      - 'file:get("filePath"), "Tool"'
      - 'weight(file), "Weight"'
      - 'load(file), "Load"'
      - 'toFixed(load(file) / 4, 2), "Quarter"'
      - 'file:get("owner") or "nobody", "Owner"'
    sort:
      - property: kg
        direction: DESC
    limit: 2
"""
RACK = {f"{name}.md": f"---\nshelf: [{shelf}]\nkg: {kg}\npieces: {n}\n{owner}---\n" for name, shelf, kg, n, owner in (
    ("saw", "north", 1.25, 4, ""), ("anvil", "north", 80, 2, ""), ("vice", "south", 12.5, 1, "owner: Ada\n"), ("file", "north", 0.5, 3, "owner: Bo\n"))}


def test_tools_view(spark):
    n, view = vault(spark, RACK), views.from_expressions(TOOLS)
    head = "| Tool | Weight | Load | Quarter | Owner |\n|---|---|---|---|---|\n"
    rows = ["| vice.md | 12.5 kg | 12.5 | 3.125 | Ada |\n", "| saw.md | 1.25 kg | 5 | 1.25 | nobody |\n", "| file.md | 0.5 kg | 1.5 | 0.375 | Bo |\n"]
    assert views.render(n, view).first()["text"] == head + "".join(rows)
    assert views.render(n, view, honor_limit=True).first()["text"] == head + "".join(rows[:2])
    assert [(r["path"], r["pos"]) for r in views.cells(n, view).orderBy("pos").collect()] == [("vice.md", 1), ("saw.md", 2), ("file.md", 3)]


def test_extended_base(spark):
    base = "formulas:\n  heavy: 'return file:get(\"kg\") > 1'\nviews:\n  - type: list\n    filters:\n      or:\n        - shelf == \"south\"\n        - heavy(file)\n    order: [file.name]\n    limit: 2\n"
    n = vault(spark, RACK)
    assert views.render(n, views.from_base(base, extended=True), honor_limit=True).first()["text"] == " - [[anvil.md]]\n - [[saw.md]]\n"
    assert views.from_base(base).filters is None or not views.from_base(base).filters
    assert views.render(n, views.from_base(base.replace("order: [file.name]", "order: [plain]"), extended=True)).first()["text"] == " - nil\n - nil\n - nil\n".replace("nil", "")


def test_failing_blocks_leave_the_others_alone(spark):
    block = lambda text: f"```base\n{text}\n```\n"
    good = "views:\n  - type: list\n    filters:\n      and:\n        - kind == \"a\"\n    order:\n      - filePath\n"
    bad = ["views: [", "views: 3", "views:\n  - name: x", good.replace("kind ==", "os.execute("), good.replace('kind == "a"', "10 /"), "- 1", "views:\n  - type: list\n    order: 5"]
    n = vault(spark, {"x.md": "---\nkind: a\n---\n" + "".join(map(block, [*bad, good])), "y.md": "---\nkind: b\n---\n" + block(bad[0]), "z.md": "---\nkind: a\n---\n" + block(good.replace('kind == "a"', '10 / 0 > file:get("path") or true'))})
    got = {r["path"]: r["rendered"] for r in update(n).collect()}
    assert got["x.md"] == "---\nkind: a\n---\n" + "\n" * len(bad) + " - x.md\n - z.md\n\n"
    assert got["y.md"] is None
    assert got["z.md"] is not None


def test_rounds_follow_what_the_first_one_made(spark):
    n = vault(spark, {"hub.md": "---\nkind: hub\n---\n```base\nviews:\n  - type: list\n    filters:\n      and:\n        - kind == \"leaf\"\n    order: [title]\n```\n", "leaf.md": "---\nkind: leaf\ntitle: '[[late]]'\n---\n", "late.md": "---\nkind: other\n---\n[[leaf]]\n"})
    one, two = update(n), update(n, rounds=3)
    assert {r["path"]: r["rendered"] for r in two.collect()} == {r["path"]: r["rendered"] for r in one.collect()}
    moved = {r["path"]: (r["added"], r["rewritten"]) for r in changes(n, one).collect()}
    assert moved == {"hub.md": (["late.md"], True), "leaf.md": (["late.md"], True), "late.md": (["leaf.md"], True)}


def test_many_views_from_one_scan(spark):
    n, shelf = vault(spark, RACK), lambda x, sort: f'views:\n  - type: list\n    filters:\n      and:\n        - shelf == "{x}"\n    order: [title, kg]\n    sort:\n      - property: kg\n        direction: {sort}\n    limit: 1\n'
    made = {i: views.from_base(shelf(x, sort), extended=True) for i, (x, sort) in enumerate([("north", "ASC"), ("north", "DESC"), ("south", "ASC"), ("none", "ASC")])}
    made |= {7: views.View("table"), 9: views.View("cards")}
    frame = views.rendered(n, made)
    got = {r["view"]: r["text"] for r in frame.collect()}
    listed = lambda *kg: "".join(f" -  {x}\n" for x in kg)
    assert got == {0: listed(0.5, 1.25, 80), 1: listed(80, 1.25, 0.5), 2: listed(12.5), 3: "", 7: "| Path |\n|---|\n| anvil.md |\n| file.md |\n| saw.md |\n| vice.md |\n", 9: "ERROR in type"}
    assert {r["view"]: r["text"] for r in views.rendered(n, made, honor_limit=True).collect()} == got | {0: listed(0.5), 1: listed(80)}


def test_later_rounds_read_what_was_rewritten(spark):
    inner = "```base\nviews:\n  - type: list\n    filters:\n      and:\n        - kind == \"leaf\"\n    order: [title]\n```"
    outer = inner.replace("leaf", "hub").replace("title", "inner")
    import json
    files = {"top.md": f"---\nkind: top\n---\n{outer}\n", "hub.md": f"---\nkind: hub\ninner: {json.dumps(inner)}\n---\n", "leaf.md": "---\nkind: leaf\ntitle: a leaf\n---\nplain\n"}
    n = vault(spark, files)
    text = lambda rounds: {r["path"]: r["rendered"] for r in update(n, rounds).collect()}
    assert text(1)["top.md"].endswith(f"---\n - {inner}\n\n")
    assert text(2)["top.md"].endswith("---\n -  - a leaf\n\n\n") and text(4) == text(2)
    assert text(2)["leaf.md"] is None
    first = materialize(update(n).withColumn("__new", F.col("rendered").isNotNull()), by="__new")
    work = worklist(first)
    files = sorted({f.split("__new=")[1][:5].rstrip("/") for f in work.inputFiles()})
    scan = work._jdf.queryExecution().executedPlan().toString()
    assert files == ["false", "true"] and "PartitionFilters: [isnotnull(__new" in scan and [r["path"] for r in work.collect()] == ["top.md"]


def test_other_view_types(notes):
    assert views.render(notes, views.View("cards")).first()["text"] == "ERROR in type"
    with pytest.raises(ValueError, match="type"):
        views.from_base("views:\n  - name: x\n")
    tests = {'a == "x"': 'hasPropertyValue(file, "a", "x")', '!a.containsAny("x")': 'not hasPropertyValue(file, "a", "x")', '!!a == "x"': '!a == "x"', 'a == ""': 'a == ""'}
    for text, made in tests.items():
        assert views._base_filter(text) == made


def test_store(spark, tmp_path):
    n = vault(spark, {"a.md": "---\ntags: [t]\n---\n", "b.md": "---\ntags: t\nlinks: [a.md]\n---\n", "c.md": "---\ntags: [u]\n---\n"})
    store = NoteStore(spark, f"{tmp_path}/store")
    store.init()
    assert store.save(n.where("path <> 'c.md'")).count() == 2
    assert [r["path"] for r in store.save(n).collect()] == ["c.md"]
    assert sorted(r["path"] for r in store.find_by_tag("t").collect()) == ["a.md", "b.md"]
    assert [r["path"] for r in store.find_backlinks("a.md").collect()] == ["b.md"]
    store.update(vault(spark, {"a.md": "---\ntags: [new]\n---\n"}))
    assert [r["path"] for r in store.find_by_tag("new").collect()] == ["a.md"]
    row = store.find_by_path("a.md").first()
    assert store.find_by_id(row["id"]).first()["path"] == "a.md" and store.find_all().count() == 3
    with pytest.raises(KeyError):
        store.update(vault(spark, {"zz.md": "---\na: 1\n---\n"}))
    assert [r["path"] for r in store.search({"tags": "t*"}, {"links": "a.md"}).collect()] == []
    assert [r["path"] for r in store.search({"tags": "t"}).collect()] == ["b.md"]
    assert [r["path"] for r in store.outgoing("b.md").collect()] == ["a.md"]
    (tmp_path / "store" / "version-99-half").mkdir()  # a writer that stopped half-way
    store.init()
    assert store.find_all().count() == 3
    store.vacuum(1)
    assert store.find_all().count() == 3 and len(list((tmp_path / "store").glob("version-*/_SUCCESS"))) == 1


def test_hidden_files_and_load_errors(spark, tmp_path):
    for name, raw in (("a.md", "---\nn: 1\n---\n"), (".b.md", "---\nn: 2\n---\n"), ("_d/c.md", "---\nn: 3\n---\n"), (".x/y.png", ""), ("none.md", "text"), ("list.md", "---\n- 1\n---\n"), ("bad.md", "---\na: [\n---\n"), ("blank.md", "---\n---\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(raw)
    assert sorted(r["path"] for r in read_vault(spark, str(tmp_path)).collect()) == [".b.md", ".x/y.png", "_d/c.md", "a.md"]
    errors = {r["path"]: r["error"] for r in load_errors(read_files(spark, str(tmp_path))).collect()}
    assert errors == {"none.md": "no front matter", "list.md": "front matter is not a mapping", "bad.md": "front matter is not a mapping", "blank.md": "empty front matter"}


def test_json_and_export(spark, tmp_path):
    source, out = tmp_path / "vault", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    (source / "sub" / "a.md").write_text('---\ntags: [t]\nq: "a\\"b"\n---\n![i](sub/p.png) [[b]]')
    (source / "b.md").write_text("---\nn: 1\n---\n")
    (source / "sub" / "p.png").write_bytes(b"png")
    n = update(read_vault(spark, str(source)))
    assert sorted(r["path"] for r in n.collect()) == ["b.md", "sub/a.md", "sub/p.png"]
    json = export.json_result(n).first()
    assert export.result_size(n).first()["resultSize"] == 3 == json["resultSize"] and '{"filePath":"b.md","n":1}' in json["json"] and '"q":"a\\"b"' in json["json"]
    plan = {r["path"]: r["done"] for r in export.export(n, str(source), str(out), "tags=t", dry_run=True).collect()}
    assert set(plan) == {"sub/a.md", "sub/p.png"} and not out.exists()
    done = {r["path"]: r["done"] for r in export.export(n, str(source), str(out), "tags=t").collect()}
    assert done == {"sub/a.md": "written", "sub/p.png": "copied"}
    assert (out / "sub" / "a.md").read_text().endswith("[b](b.md)")


def test_text_of_values(notes):
    row = notes.where("path = 'B.md'").select(text(prop("n")).alias("n"), text(prop("mix")).alias("mix"), text(prop("f")).alias("f")).first()
    assert (row["n"], row["mix"], row["f"]) == ("42", "[a, nil]", "1.5")


def test_stream(spark, tmp_path):
    from quillspark.streaming.ingest import append_notes, note_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("---\nn: 1\n---\n")
    for count in (1, 2):
        append_notes(note_stream(spark, str(folder)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "t")).count() == count
        (folder / "b.md").write_text("---\nn: 2\n---\n")
