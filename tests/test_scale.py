"""Work that must not grow faster than the rows: what is computed once, dealt over tasks, or left out of a join."""

from pyspark.sql import functions as F

from quillspark.functions import frontmatter
from quillspark.operators import export, links, views
from quillspark.plans import pipeline
from quillspark.plans.pipeline import render_blocks
from quillspark.schema import PROPS, bag, string, strings
from quillspark.sources.vault import read_files


def test_rows_are_computed_once_before_they_are_numbered(spark, tmp_path):
    log = str(tmp_path / "log")

    @F.udf("long")
    def seen(x):
        with open(log, "a") as f:
            f.write(f"{x}\n")
        return x

    rows = spark.range(200, numPartitions=3).select(F.format_string("%03d", F.lit(199) - F.col("id")).alias("path"), seen("id").alias("c0"))
    made = views.numbered(rows, [F.asc("path")]).select("path", "pos").collect()
    assert {(r["path"], r["pos"]) for r in made} == {(f"{i:03d}", i + 1) for i in range(200)}
    assert len(open(log).readlines()) == 200


def test_files_are_read_once_by_tasks_that_do_not_follow_their_number(spark, tmp_path):
    names = {f"n{i}.md" for i in range(400)} | {"_x=1.md", "_y.md", "d=1/a.md"}
    (tmp_path / "d=1").mkdir()
    for n in names:
        (tmp_path / n).write_text(f"text of {n}")
    (tmp_path / "broken.md").symlink_to(tmp_path / "nowhere")
    read = read_files(spark, str(tmp_path))
    assert sorted((r["path"], r["raw"]) for r in read.collect()) == sorted((n, f"text of {n}") for n in names)
    assert read.rdd.getNumPartitions() == 4


def test_notes_are_computed_once_for_an_export_plan(spark, tmp_path):
    log = str(tmp_path / "log")

    @F.udf("string")
    def seen(x):
        with open(log, "a") as f:
            f.write(f"{x}\n")
        return x

    own = spark.createDataFrame([("a.md", None, "text"), ("i/b.png", None, None)], "path string, ext string, rendered string").withColumn("path", seen("path"))
    own = own.withColumn("props", bag(links=strings(F.array(F.lit("i/b.png|80"), F.lit("i/c.jpg"), F.lit("i/c.jpg|9"), F.lit("d.md")))).cast(PROPS))
    plan = export.export_plan(own)
    assert sorted(tuple(r) for r in plan.collect()) == [("a.md", "write", "a.md"), ("i/b.png", "copy", "i/b.png"), ("i/c.jpg", "copy", "i/c.jpg")]
    assert sorted(open(log).read().split()) == ["a.md", "i/b.png"]


def test_notes_are_computed_once_for_an_export(spark, tmp_path):
    log = str(tmp_path / "log")

    @F.udf("string")
    def seen(x):
        with open(log, "a") as f:
            f.write(f"{x}\n")
        return x

    own = spark.createDataFrame([("a.md", "md", "text"), ("d/b.md", "md", "more")], "path string, ext string, rendered string").withColumn("rendered", seen("rendered"))
    done = export.export(own.withColumn("props", F.create_map().cast(PROPS)), str(tmp_path / "v"), str(tmp_path / "o"))
    assert {r["path"]: r["done"] for r in done.collect()} == {"a.md": "written", "d/b.md": "written"}
    assert [(tmp_path / "o" / n).read_text() for n in ("a.md", "d/b.md")] == ["text", "more"]
    assert sorted(open(log).read().split()) == ["more", "text"]


def test_one_join_finds_what_a_wikilink_means_and_notes_without_one_stay_out(spark):
    texts = {"d/a.md": "[[b]] and [[b.md|x]], ~[[b]] [[none]] [[/c|y|z]]", "b.md": "plain", "b": "[[none]]", "e/c.md": None, "f/c.md": "[[a]]"}
    own = spark.createDataFrame(list(texts.items()), "path string, raw string").withColumn("props", F.create_map().cast(PROPS))
    names = links.name_dictionary(own)
    resolved = links.resolve(links.wikilinks(own), names)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(resolved) == 1
    found = {(r["src"], r["pos"]): (r["path"], r["ambiguous"]) for r in resolved.collect()}
    assert found == {("d/a.md", 0): ("b", False), ("d/a.md", 1): ("b.md", False), ("d/a.md", 2): (None, False), ("d/a.md", 3): ("e/c.md", True), ("b", 0): (None, False), ("f/c.md", 0): ("d/a.md", False)}
    done = links.rewrite_wikilinks(own, names)
    assert joins(done) == 2
    assert {r["path"]: r["rendered"] for r in done.collect()} == dict.fromkeys(texts) | {"d/a.md": "[b](b) and [x](b.md), ~[[b]] [[none]] [y|z](e/c.md)", "f/c.md": "[a](d/a.md)"}


def test_only_notes_with_a_view_meet_the_views(spark):
    text = '# x\n```base\nviews:\n  - type: list\n    order:\n      - file.path\n```\nend'
    own = spark.createDataFrame([("a.md", text), ("b.md", "plain"), ("c.md", None)], "path string, raw string").withColumn("props", bag(path=string(F.col("path"))).cast(PROPS))
    done = render_blocks(own)
    assert {r["path"]: r["rendered"] for r in done.collect()} == {"a.md": "# x\n - a.md\n - b.md\n - c.md\n\nend", "b.md": None, "c.md": None}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and plan.count("Union") == 1


def test_blocks_that_differ_in_quoted_texts_are_read_as_yaml_once(monkeypatch):
    read, known = [], frontmatter.yaml_to_json
    monkeypatch.setattr(frontmatter, "yaml_to_json", lambda b: read.append(b) or known(b))
    monkeypatch.setattr(frontmatter, "_forms", {})
    form = '\ntitle: "{}"\ntags:\n- "{}"\n- "x"\naliases: ["{}", ""]\nsize: 5\ntitle: "{}"\n'
    blocks = [form.format(*texts) for texts in (("a", "b", "c", "d"), ("@1@", "k: v", " #z", "- é"), ("null", "1", "[", "|"))]
    assert [frontmatter.block_to_json(b) for b in blocks] == [known(b) for b in blocks]
    assert len(read) == 1
    # Other blocks are read whole.
    odd = [None, "", "\n", 'a: "\\n"', 'a: |\n  b: "c"\n', 'a: "b\n- "c"\n', "a: 'x'\n", 'a: "x" # y\n', 'a: 1\n- "b"\n', '- "a"\n', 'a: "\x85"\n', 'a: "b": c\n', 'yes: no\na:\n- "1"\n']
    assert [frontmatter.block_to_json(b) for b in odd] == [known(b) for b in odd]


def test_views_that_ask_for_a_value_are_looked_up_by_it(spark, monkeypatch):
    tags = {"a.md": ["x", "t1", "t1"], "b.md": ["t2", None, "x", "t1"], "c.md": ["t2"], "d.md": None, "e.md": "t1", "f.md": [], "g.md": ["y", "t3", "x"]}
    rows = spark.createDataFrame([(p, t if isinstance(t, list) else None, t if isinstance(t, str) else None) for p, t in tags.items()], "path string, tags array<string>, kind string")
    own = rows.select("path", bag(tags=strings(F.col("tags")), kind=string(F.col("kind")), path=string(F.col("path"))).alias("props"))
    view = lambda *tests: views.from_base("views:\n  - type: list\n    filters:\n      and:\n" + "".join(f"        - '{t}'\n" for t in tests) + "    order: [path]\n")
    tag = 'file.tags.containsAny("{}")'.format
    many = {i: view(tag(f"t{i}"), tag("x")) for i in range(40)} | {40: view(tag("x")), 41: view(tag("t1"), '!file.tags.containsAny("y")'), 42: view('kind == "t1"'), 43: view(tag("t2"), tag("t1"))}
    ran, in_order = [], views.in_order
    monkeypatch.setattr(views, "in_order", lambda found, *rest: ran.append(found._jdf.queryExecution().optimizedPlan().toString()) or in_order(found, *rest))
    shown = lambda of: {r["view"]: [line[3:] for line in r["text"].splitlines()] for r in views.rendered(own, of).collect()}
    wanted = dict.fromkeys(range(40), []) | {1: ["a.md", "b.md"], 2: ["b.md"], 3: ["g.md"], 40: ["a.md", "b.md", "g.md"], 41: ["a.md", "b.md"], 42: ["e.md"], 43: ["b.md"]}
    assert shown(many) == wanted
    # Among views without such a test, too.
    assert shown(many | {44: view('not hasPropertyValue(file, "tags", "x")'), 45: views.View("list", order=[('"v"', "")])}) == wanted | {44: ["c.md", "d.md", "e.md", "f.md"], 45: ["v"] * 7}
    # The tests of a note do not follow the number of views.
    ran.clear()
    assert shown({i: many[i] for i in range(2)}) == {0: [], 1: wanted[1]} and shown({i: many[i] for i in range(40)}) == {i: wanted[i] for i in range(40)}
    assert [plan.count("array_contains") for plan in ran] == [ran[0].count("array_contains")] * 2


def test_rounds_write_and_look_up_what_texts_need(spark, monkeypatch):
    written, known = [], pipeline.materialize
    monkeypatch.setattr(pipeline, "materialize", lambda df, by=None: written.append(made := known(df, by)) or made)
    block = "```base\nviews:\n  - type: list\n    filters:\n      and:\n        - file.tags.containsAny(\"{}\")\n    order: [{}]\n```".format
    texts = {"top.md": f"{block('mid', 'inner')}\n[[n7]] [[other]] [[none]]", "plain.md": "[x](y.md)"}
    silent = [(f"d/n{i}.md", None, ["leaf"] if i < 2 else ["mid"] if i == 2 else [], block("leaf", "inner") if i == 2 else f"[[n{i}.md]]", ["other"] if i > 3 else None) for i in range(50)]
    rows = spark.createDataFrame([(p, t, [], None, None) for p, t in texts.items()] + silent, "path string, raw string, tags array<string>, inner string, aliases array<string>")
    props = bag(tags=strings(F.col("tags")), inner=string(F.col("inner")), aliases=strings(F.col("aliases"))).cast(PROPS)
    own = rows.select("path", F.lit("md").alias("ext"), "raw", F.lit("old").alias("rendered"), props.alias("props"))
    done = {r["path"]: r for r in pipeline.update(own, rounds=3).collect()}
    assert pipeline.update(own, rounds=3).columns == own.columns
    shown = " -  - [n0.md](d/n0.md)\n - [n1.md](d/n1.md)\n\n\n[n7](d/n7.md) [other](d/n10.md) [[none]]"
    assert {p: r["rendered"] for p, r in done.items()} == dict.fromkeys(done) | {"top.md": shown} and len(done) == 52
    assert done["top.md"]["props"]["links"]["list"] == ["d/n0.md", "d/n1.md", "d/n7.md", "d/n10.md"]
    assert done["plain.md"]["props"]["links"]["list"] == ["y.md"] and done["d/n9.md"]["raw"] is None
    before = {r["path"]: r["props"] for r in own.collect()}
    assert all(done[p]["props"] == before[p] for p in before if p.startswith("d/"))
    # Neither the notes without text nor their names are written.
    assert max(df.count() for df in written) <= 5
