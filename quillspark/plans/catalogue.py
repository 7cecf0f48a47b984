"""Registered queries over the notes, and the same queries for DuckDB."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export, graph, links, views
from ..operators.search import graph_listing, listing, search
from ..operators.store import NoteStore
from ..schema import PROPS, as_list, bag, prop, string, strings
from ..shared import materialize, shared_dir
from ..sources.tables import NOTES_SQL, as_markdown, notes
from ..sources.vault import notes_from_files, read_vault
from .pipeline import changes, render_blocks, update

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: name -> (query string, SQL condition over the notes)
SEARCHES = {
    "search_all": ("", "true"),
    "search_tag_and_path": ("tags=part&filePath=part/1*", "list_contains(tags, 'part') AND starts_with(path, 'part/1')"),
    "search_list_eq": ("tags=PROMO", "list_contains(tags, 'PROMO')"),
    "search_and_same_key": ("tags=PROMO&tags=Brand%2313", "list_contains(tags, 'PROMO') AND list_contains(tags, 'Brand#13')"),
    "search_string_eq": ("title=cold+widget", "title = 'cold widget'"),
    "search_prefix": ("filePath=part/1*", "starts_with(path, 'part/1')"),
    "search_suffix": ("filePath=*7.md", "ends_with(path, '7.md')"),
    "search_star_both_ends": ("title=*ring*", "starts_with(title, '*ring')"),
    "search_star_alone": ("title=*", "title IS NOT NULL"),
    "search_list_prefix": ("tags=Brand%232*", "len(list_filter(tags, lambda x: starts_with(x, 'Brand#2'))) > 0"),
    "search_list_suffix": ("tags=*MO", "len(list_filter(tags, lambda x: ends_with(x, 'MO'))) > 0"),
    "search_list_gt_is_suffix": ("tags=>MO", "len(list_filter(tags, lambda x: ends_with(x, 'MO'))) > 0"),
    "search_list_lt_is_suffix": ("tags=<MO", "len(list_filter(tags, lambda x: ends_with(x, 'MO'))) > 0"),
    "search_int_eq": ("size=10", "size = 10"),
    "search_int_gt": ("size=>40", "size > 40"),
    "search_int_lt": ("size=<5", "size < 5"),
    "search_int_not_a_number": ("size=ten", "false"),
    "search_string_gt": ("keytext=>100", "TRY_CAST(keytext AS INTEGER) > 100"),
    "search_string_lt_false": ("keytext=<100", "false"),
    "search_bool": ("inStock=true", "instock"),
    "search_bool_other_text": ("inStock=maybe", "NOT instock"),
    "search_double_never": ("price=900", "false"),
    "search_presence": ("title=", "title IS NOT NULL"),
    "search_presence_bare_key": ("acctbal", "acctbal IS NOT NULL"),
    "search_absence_quirk": ("!title=", "title IS NULL OR title <> ''"),
    "search_absence_quirk_bool": ("!inStock=", "instock IS NULL OR instock"),
    "search_exclude": ("!tags=PROMO", "NOT list_contains(tags, 'PROMO')"),
    "search_mixed": ("filePath=part/*&!tags=PROMO&!tags=ECONOMY", "starts_with(path, 'part/') AND NOT list_contains(tags, 'PROMO') AND NOT list_contains(tags, 'ECONOMY')"),
    "search_absent_key_never": ("colour=red", "false"),
}


def _search(query: str) -> Query:
    return lambda spark, sf_dir: search(notes(spark, sf_dir), query).select("path", prop("title")["str"].alias("title"))


for _name, (_query, _condition) in SEARCHES.items():
    QUERIES[_name] = _search(_query)
    ORACLES[_name] = f"{NOTES_SQL} SELECT path, title FROM notes WHERE {_condition}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL after the notes' definition."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"{NOTES_SQL}{'' if sql.startswith(',') else ' '}{sql}"
        return f

    return put


@query("search_intended_less", "SELECT path FROM notes WHERE TRY_CAST(keytext AS INTEGER) < 100")
def _intended(spark, sf_dir):
    return search(notes(spark, sf_dir), "keytext=<100", fixed_semantics=True).select("path")


@query("search_intended_absence", "SELECT path FROM notes WHERE title IS NULL")
def _absent(spark, sf_dir):
    return search(notes(spark, sf_dir), "!title=", fixed_semantics=True).select("path")


@query("project_graph", "SELECT path, array_to_string(tags, ' ') AS tags, array_to_string(links, ' ') AS links, CAST(2 + (links IS NOT NULL)::INTEGER AS INTEGER) AS n_properties FROM notes WHERE list_contains(tags, 'supplier')")
def _project_graph(spark, sf_dir):
    found = graph_listing(notes(spark, sf_dir), "tags=supplier")
    return found.select("path", F.array_join(as_list("tags"), " ").alias("tags"), F.array_join(as_list("links"), " ").alias("links"), F.size("props").alias("n_properties"))


GRAPH = ("filePath", "tags", "links")
#: The properties that a note's Markdown is made of.
TEXT_KEYS = ("title", "tags", "size", "inStock", "links")


def stored(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] | None = GRAPH) -> DataFrame:
    """The notes as a written table, for queries that read them several times."""
    return materialize(notes(spark, sf_dir, keys))


@query(
    "graph_neighbourhood",
    """, s AS (SELECT * FROM notes WHERE starts_with(path, 'supplier/1')), l AS (SELECT DISTINCT unnest(links) AS path FROM s),
near AS (SELECT path FROM s UNION SELECT path FROM notes WHERE path IN (SELECT path FROM l)),
t AS (SELECT DISTINCT unnest(tags) AS tag FROM notes WHERE path IN (SELECT path FROM near)),
w AS (SELECT path FROM (SELECT path, unnest(tags) AS tag FROM notes) WHERE tag IN (SELECT tag FROM t))
SELECT path, array_to_string(tags, ' ') AS tags, array_to_string(links, ' ') AS links FROM notes WHERE path IN (SELECT path FROM near UNION SELECT path FROM w)""",
)
def _neighbourhood(spark, sf_dir):
    return graph.neighbourhood(stored(spark, sf_dir), "filePath=supplier/1*").select("path", F.array_join(prop("tags")["list"], " ").alias("tags"), F.array_join(prop("links")["list"], " ").alias("links"))


@query("graph_backlink_counts", "SELECT l.dst AS path, count(DISTINCT src) AS n FROM (SELECT path AS src, unnest(links) AS dst FROM notes) l JOIN notes n ON n.path = l.dst GROUP BY 1")
def _backlinks(spark, sf_dir):
    return graph.backlink_counts(stored(spark, sf_dir))


@query("graph_backlinks", "SELECT l.dst AS path, array_to_string(list_sort(list(DISTINCT src)), ' ') AS backlinks FROM (SELECT path AS src, unnest(links) AS dst FROM notes) l JOIN notes n ON n.path = l.dst WHERE starts_with(l.dst, 'nation/') GROUP BY 1")
def _backlink_lists(spark, sf_dir):
    return graph.backlinks(stored(spark, sf_dir)).where(F.col("path").startswith("nation/")).select("path", F.array_join("backlinks", " ").alias("backlinks"))


@query("graph_outgoing", "SELECT path FROM notes WHERE path IN (SELECT unnest(links) FROM notes WHERE path = 'order/1.md')")
def _outgoing(spark, sf_dir):
    return graph.outgoing(stored(spark, sf_dir), "order/1.md").select("path")


@query(
    "graph_within_three_links",
    """, e AS (SELECT DISTINCT path AS src, unnest(links) AS dst FROM notes), d0 AS (SELECT path FROM notes WHERE starts_with(path, 'order/1')),
d1 AS (SELECT DISTINCT dst AS path FROM e JOIN d0 ON src = d0.path WHERE dst IN (SELECT path FROM notes)), d2 AS (SELECT DISTINCT dst AS path FROM e JOIN d1 ON src = d1.path), d3 AS (SELECT DISTINCT dst AS path FROM e JOIN d2 ON src = d2.path)
SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT path, 0 AS depth FROM d0 UNION ALL SELECT path, 1 FROM d1 UNION ALL SELECT path, 2 FROM d2 UNION ALL SELECT path, 3 FROM d3) GROUP BY path""",
)
def _within(spark, sf_dir):
    return graph.within(stored(spark, sf_dir), "filePath=order/1*", 3)


def parsed(spark: SparkSession, sf_dir: str, which: str | None = None) -> DataFrame:
    """The notes (those whose paths match ``which``) written as Markdown and read again by the parsers."""
    own = notes(spark, sf_dir, TEXT_KEYS, dealt=True)
    return materialize(notes_from_files(as_markdown(own.where(F.col("path").rlike(which)) if which else own)))


@query("frontmatter_types", "SELECT 'title' AS key, 'string' AS kind, count(*) AS n FROM notes WHERE title IS NOT NULL UNION ALL SELECT 'aliases', 'list', count(*) FROM notes WHERE title IS NOT NULL UNION ALL SELECT 'tags', 'list', count(*) FROM notes UNION ALL SELECT 'size', 'int', count(*) FROM notes WHERE size IS NOT NULL UNION ALL SELECT 'inStock', 'bool', count(*) FROM notes WHERE instock IS NOT NULL UNION ALL SELECT 'links', 'list', count(*) FROM notes WHERE links IS NOT NULL UNION ALL SELECT 'filePath', 'string', count(*) FROM notes")
def _types(spark, sf_dir):
    return parsed(spark, sf_dir).select(F.explode("props").alias("key", "v")).groupBy("key", F.col("v.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("frontmatter_values", "SELECT path, title, array_to_string(tags, '|') AS tags, CAST(size AS VARCHAR) AS size, CAST(instock AS VARCHAR) AS instock FROM notes")
def _values(spark, sf_dir):
    return parsed(spark, sf_dir).select("path", prop("title")["str"].alias("title"), F.array_join(as_list("tags"), "|").alias("tags"), prop("size")["int"].cast("string").alias("size"), prop("inStock")["bool"].cast("string").alias("instock"))


@query("links_extract", "SELECT path AS src, generate_subscripts(links, 1) - 1 AS pos, unnest(links) AS dst FROM notes")
def _links(spark, sf_dir):
    return graph.edges(parsed(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


def exported(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder that the parts are exported to as Markdown and the nations as plain text, and the report."""
    folder = urlparse(shared_dir(spark)).path  # a path that all tasks can reach
    chosen = parsed(spark, sf_dir, "^(part|nation)/").withColumn("rendered", F.col("raw"))
    named = chosen.withColumn("path", F.when(F.col("path").startswith("nation/"), F.regexp_replace("path", r"\.md$", ".txt")).otherwise(F.col("path")))
    return folder, export.export(named, f"{folder}/none", f"{folder}/out")


_EXPORTED = ", e AS (SELECT CASE WHEN starts_with(path, 'nation/') THEN regexp_replace(path, '\\.md$', '.txt') ELSE path END AS path, title, tags, size FROM notes WHERE starts_with(path, 'part/') OR starts_with(path, 'nation/'))"


@query("export_and_copy", f"{_EXPORTED} SELECT unnest(['write', 'copy', 'copy again']) AS step, path, unnest(['written', 'copied', 'kept']) AS done FROM e")
def _export_and_copy(spark, sf_dir):
    """Exported as Markdown, the folder read and its files copied to another one, and once more: what was done with each."""
    folder, report = exported(spark, sf_dir)
    read = materialize(read_vault(spark, f"{folder}/out"))
    copy = lambda: export.export(read, f"{folder}/out", f"{folder}/copies", kind="copy")
    steps = [report.select(F.lit("write").alias("step"), "path", "done")]
    steps += [copy().select(F.lit(step).alias("step"), "path", "done") for step in ("copy", "copy again")]
    return reduce(DataFrame.union, steps)


@query("folder_read", f"{_EXPORTED} SELECT path, string_split(path, '.')[-1] AS ext, CASE WHEN starts_with(path, 'part/') THEN title END AS title, CASE WHEN starts_with(path, 'part/') THEN array_to_string(tags, '|') END AS tags, CASE WHEN starts_with(path, 'part/') THEN CAST(size AS VARCHAR) END AS size FROM e")
def _folder_read(spark, sf_dir):
    """A folder of Markdown and other files listed, dispatched by extension and parsed."""
    folder, _ = exported(spark, sf_dir)
    return read_vault(spark, f"{folder}/out").select("path", "ext", prop("title")["str"].alias("title"), F.array_join(prop("tags")["list"], "|").alias("tags"), prop("size")["int"].cast("string").alias("size"))


_NAMES = """, names AS (SELECT DISTINCT name, path FROM (SELECT string_split(path, '/')[-1] AS name, path FROM notes UNION ALL SELECT title, path FROM notes WHERE title IS NOT NULL)),
dictionary AS (SELECT name, min(path) AS path, count(*) AS candidates FROM names GROUP BY name)"""


@query("name_dictionary", f"{_NAMES} SELECT name, path, candidates FROM dictionary")
def _names(spark, sf_dir):
    return links.name_dictionary(parsed(spark, sf_dir))


@query("ambiguous_names", f"{_NAMES} SELECT name, candidates FROM dictionary WHERE candidates > 1")
def _ambiguous(spark, sf_dir):
    return links.name_dictionary(parsed(spark, sf_dir)).where("candidates > 1").select("name", "candidates")


_TOKENS = """, token AS (SELECT path AS src, string_split(unnest(links), '/')[-1] AS base FROM notes WHERE links IS NOT NULL),
tokens AS (SELECT src, 0 AS pos, base AS target FROM token UNION ALL SELECT src, 1, regexp_replace(base, '\\.md$', '') FROM token
UNION ALL SELECT path, CASE WHEN links IS NULL THEN 0 ELSE 2 END, 'no such note' FROM notes)"""


@query(
    "wikilink_resolve",
    f"{_NAMES}{_TOKENS} SELECT t.src, CAST(t.pos AS INTEGER) AS pos, t.target, coalesce(a.path, b.path) AS path FROM tokens t LEFT JOIN dictionary a ON a.name = t.target LEFT JOIN dictionary b ON b.name = t.target || '.md'",
)
def _resolve(spark, sf_dir):
    own = parsed(spark, sf_dir)
    return links.resolve(links.wikilinks(own), links.name_dictionary(own)).select("src", "pos", "target", "path")


@query(
    "wikilink_rewrite",
    f"""{_NAMES}, l AS (SELECT path AS src, links[1] AS link, string_split(links[1], '/')[-1] AS base FROM notes WHERE links IS NOT NULL),
r AS (SELECT src, link, base, a.path AS p1, coalesce(c.path, b.path) AS p2 FROM l LEFT JOIN dictionary a ON a.name = base LEFT JOIN dictionary b ON b.name = base LEFT JOIN dictionary c ON c.name = regexp_replace(base, '\\.md$', ''))
SELECT src AS path, 'see [it](' || link || ') and again [it](' || link || ')' || chr(10) || 'wiki [' || base || '](' || p1 || ') and [label](' || p2 || ') but ~[[' || base || ']]' || chr(10) || 'web [site](https://example.org/a) and [[no such note]]' || chr(10) AS body FROM r WHERE p1 IS NOT NULL OR p2 IS NOT NULL""",
)
def _rewrite(spark, sf_dir):
    own = parsed(spark, sf_dir)
    done = links.rewrite_wikilinks(own, links.name_dictionary(own)).where("rendered is not null")
    return done.select("path", F.regexp_extract("rendered", r"(?s)\A---\n.*?\n---\n(.*)", 1).alias("body"))


def _view(filters, order=None, sort=None, formulas=None, kind="table") -> views.View:
    return views.View(kind, filters, order, sort or [], formulas or {})


PRICED = 'getPropertyValue(file, "price", 0)'
FILTERS = {
    "view_filter_and": ({"and": ['hasPropertyValue(file, "tags", "PROMO")', 'not hasPropertyValue(file, "tags", "Brand#13")']}, "list_contains(tags, 'PROMO') AND NOT list_contains(tags, 'Brand#13')"),
    "view_filter_or": ({"or": ['hasPropertyValue(file, "tags", "PROMO")', 'hasPropertyValue(file, "title", "cold widget")']}, "list_contains(tags, 'PROMO') OR coalesce(title = 'cold widget', false)"),
    "view_filter_nand": ({"not": ['hasPropertyValue(file, "tags", "part")', 'hasProperty(file, "size")']}, "NOT (list_contains(tags, 'part') AND size IS NOT NULL)"),
    "view_filter_nested": ({"and": ['hasProperty(file, "size")', {"or": ['hasPropertyValue(file, "tags", "PROMO")', {"not": ['getPropertyValue(file, "size", 0) > 10']}]}]}, "size IS NOT NULL AND (list_contains(tags, 'PROMO') OR NOT (size > 10))"),
    "view_filter_number": ({"and": ['getPropertyValue(file, "size", 0) * 2 >= 60 and hasPropertyValue(file, "inStock", true)']}, "coalesce(size, 0) * 2 >= 60 AND instock"),
    "view_filter_empty_or": ({"or": []}, "false"),
}


def _filtered(tree) -> Query:
    return lambda spark, sf_dir: views.selected(notes(spark, sf_dir), _view(tree)).select("path")


for _name, (_tree, _condition) in FILTERS.items():
    QUERIES[_name] = _filtered(_tree)
    ORACLES[_name] = f"{NOTES_SQL} SELECT path FROM notes WHERE {_condition}"


def number_sql(x: str) -> str:
    return f"CASE WHEN ({x}) = floor({x}) THEN CAST(CAST(({x}) AS BIGINT) AS VARCHAR) ELSE CAST(({x}) AS VARCHAR) END"


@query("view_formula", f"SELECT path, row_number() OVER (ORDER BY path) AS pos, {number_sql('price * 10')} AS c0, '$' || CAST(price AS VARCHAR) AS c1, CAST(price * 10 AS VARCHAR) AS c2 FROM notes WHERE price IS NOT NULL")
def _formula(spark, sf_dir):
    view = _view({"and": ['hasProperty(file, "price")']}, [("ppu(file)", "PPU"), ("shown(file)", "Price"), ("toFixed(ppu(file), 0)", "Fixed")], formulas={"ppu": f"return {PRICED} * 10", "shown": f'return string.format("$%.2f", {PRICED})'})
    return views.cells(notes(spark, sf_dir), view).select("path", "pos", "c0", "c1", "c2")


@query("view_sort_desc", "SELECT path, row_number() OVER (ORDER BY price DESC NULLS LAST, path) AS pos FROM notes WHERE list_contains(tags, 'part')")
def _sorted(spark, sf_dir):
    view = _view({"and": ['hasPropertyValue(file, "tags", "part")']}, sort=[{"property": "price", "direction": "desc"}])
    return views.cells(notes(spark, sf_dir), view).select("path", "pos")


@query("view_tags_column", "SELECT path, row_number() OVER (ORDER BY path) AS pos, array_to_string(list_transform(tags, lambda x: '#' || x), ' ') AS c0 FROM notes WHERE list_contains(tags, 'part')")
def _tag_cells(spark, sf_dir):
    view = views.from_base("views:\n  - type: table\n    filters:\n      and:\n        - file.tags.containsAny(\"part\")\n    order:\n      - file.tags\n")
    return views.cells(notes(spark, sf_dir), view).select("path", "pos", "c0")


@query("view_table_markdown", "SELECT '| Path | Title |' || chr(10) || '|---|---|' || chr(10) || coalesce(string_agg('| [[' || path || ']] | ' || title || ' |' || chr(10), '' ORDER BY path), '') AS text FROM notes WHERE list_contains(tags, 'nation')")
def _table(spark, sf_dir):
    view = _view({"and": ['hasPropertyValue(file, "tags", "nation")']}, [('"[[" .. getPropertyValue(file, "filePath") .. "]]"', "Path"), ('getPropertyValue(file, "title", "")', "Title")])
    return views.render(notes(spark, sf_dir), view)


@query("view_list_markdown", "SELECT coalesce(string_agg(' - ' || path || chr(10), '' ORDER BY path), '') AS text FROM notes WHERE list_contains(tags, 'region')")
def _list(spark, sf_dir):
    view = _view({"and": ['hasPropertyValue(file, "tags", "region")']}, [('getPropertyValue(file, "filePath")', "Path")], kind="list")
    return views.render(notes(spark, sf_dir), view)


BASE = """
views:
  - type: table
    name: Parts
    filters:
      and:
        - file.tags.containsAny("PROMO")
        - '!title == "cold widget"'
    order:
      - file.name
      - title
      - size
    sort:
      - property: size
        direction: ASC
    limit: 3
"""


@query("base_convert_and_run", "SELECT path, row_number() OVER (ORDER BY size NULLS LAST, path) AS pos, '[[' || path || ']]' AS c0, coalesce(title, '') AS c1, coalesce(CAST(size AS VARCHAR), '') AS c2 FROM notes WHERE list_contains(tags, 'PROMO') AND coalesce(title <> 'cold widget', true)")
def _base(spark, sf_dir):
    return views.cells(notes(spark, sf_dir), views.from_base(BASE))


@query("base_limit", "SELECT path, row_number() OVER (ORDER BY size NULLS LAST, path) AS pos FROM notes WHERE list_contains(tags, 'PROMO') AND coalesce(title <> 'cold widget', true) ORDER BY pos LIMIT 3")
def _limited(spark, sf_dir):
    return views.cells(notes(spark, sf_dir), views.from_base(BASE, extended=True), honor_limit=True).select("path", "pos")


EXTENDED = """
formulas:
  big: 'return getPropertyValue(file, "size", 0) >= 45'
views:
  - type: list
    filters:
      or:
        - title == "cold widget"
        - big(file)
    order:
      - title
"""


@query("base_extended", "SELECT path, row_number() OVER (ORDER BY path) AS pos, coalesce(title, '') AS c0 FROM notes WHERE title = 'cold widget' OR size >= 45")
def _extended(spark, sf_dir):
    return views.cells(notes(spark, sf_dir), views.from_base(EXTENDED, extended=True))


def block(tags: list, order: str, sort: str = "") -> Column:
    """A fenced view that lists a property of the notes with all tags."""
    tests = [x for t in tags for x in (F.lit('        - file.tags.containsAny("'), t if isinstance(t, Column) else F.lit(t), F.lit('")\n'))]
    return F.concat(F.lit("```base\nviews:\n  - type: list\n    filters:\n      and:\n"), *tests, F.lit(f"    order:\n      - {order}\n{sort}```"))


def with_hubs(own: DataFrame, text: Column, tag: str) -> DataFrame:
    """The notes, and a further note ``hub/...`` with a text of its own for each note with the tag."""
    hubs = search(own, f"tags={tag}").withColumn("title", prop("title")["str"]).withColumn("path", F.concat(F.lit("hub/"), "title", F.lit(".md")))
    made = hubs.select("path", "ext", text.alias("raw"), "rendered", bag(filePath=string(F.col("path")), tags=strings(F.array(F.lit("hub")))).cast(PROPS).alias("props"))
    return own.withColumn("props", F.col("props").cast(PROPS)).unionByName(made)


@query("views_in_notes", """, hub AS (SELECT 'hub/' || title || '.md' AS path, title FROM notes WHERE list_contains(tags, 'nation'))
SELECT h.path, '# ' || h.title || chr(10) || coalesce(string_agg(' - ' || n.title || chr(10), '' ORDER BY n.acctbal DESC NULLS LAST, n.path), '') || chr(10) || 'end' AS text FROM hub h LEFT JOIN notes n ON list_contains(n.tags, h.title) AND list_contains(n.tags, 'supplier') GROUP BY h.path, h.title""")
def _views_in_notes(spark, sf_dir):
    text = F.concat(F.lit("# "), "title", F.lit("\n"), block([F.col("title"), "supplier"], "title", "    sort:\n      - property: acctbal\n        direction: DESC\n"), F.lit("\nend"))
    own = with_hubs(notes(spark, sf_dir, ("filePath", "title", "tags", "acctbal")), text, "nation")
    return render_blocks(own).where(F.col("path").startswith("hub/")).select("path", F.col("rendered").alias("text"))


def _rounds(rounds: int) -> Query:
    """Hubs list the regions' views, those the nations' views, and those the region: each round renders one level."""

    def run(spark, sf_dir):
        own = with_hubs(notes(spark, sf_dir, ("filePath", "title", "tags")), F.concat(F.lit("# "), "title", F.lit("\n"), block(["region"], "inner"), F.lit("\nend")), "nation")
        region = F.element_at(as_list("tags"), 2)
        kind = F.element_at(as_list("tags"), 1)
        inner = F.when(kind == "region", block([region, "nation"], "inner")).when(kind == "nation", block([region, "region"], "title"))
        # A plain map, so that a lookup of a key becomes the tables' own column.
        nested = own.withColumn("props", bag(filePath=prop("filePath"), title=prop("title"), tags=prop("tags"), inner=string(inner)))
        return update(nested, rounds).where(F.col("path").startswith("hub/")).select("path", F.col("rendered").alias("text"))

    return run


_INNER = "'```base' || chr(10) || 'views:' || chr(10) || '  - type: list' || chr(10) || '    filters:' || chr(10) || '      and:' || chr(10) || '        - file.tags.containsAny(\"' || tags[2] || '\")' || chr(10) || '        - file.tags.containsAny(\"region\")' || chr(10) || '    order:' || chr(10) || '      - title' || chr(10) || '```'"
for _name, _count, _shown in (("update_two_rounds", 2, _INNER), ("update_three_rounds", 3, "' - ' || tags[2] || chr(10)")):
    query(_name, f"""SELECT 'hub/' || h.title || '.md' AS path, '# ' || h.title || chr(10) || b.body || chr(10) || 'end' AS text FROM notes h,
(SELECT string_agg(' - ' || coalesce(lines, '') || chr(10), '' ORDER BY path) AS body FROM (SELECT r.path, (SELECT string_agg(' - ' || {_shown} || chr(10), '' ORDER BY n.path) FROM notes n WHERE list_contains(n.tags, 'nation') AND list_contains(n.tags, r.title)) AS lines FROM notes r WHERE list_contains(r.tags, 'region'))) b
WHERE list_contains(h.tags, 'nation')""")(_rounds(_count))


#: name -> (filter, SQL condition over the notes)
CONDITIONS = {
    "expression_truth": ('not file:get("inStock")', "NOT coalesce(instock, false)"),
    "expression_texts_equal": ('file:get("title") == file:get("keytext") or file:get("filePath") == "part/" .. file:get("keytext") .. ".md"', "title IS NOT DISTINCT FROM keytext OR keytext IS NOT NULL"),
    "expression_not_nil": ('file:get("price") ~= nil and not (file:get("size") == nil)', "price IS NOT NULL AND size IS NOT NULL"),
    "expression_wrong_kinds": ('file:get("title") > 3 or true', "false"),
    "expression_bare_key": ('file:get("acctbal")', "acctbal IS NOT NULL"),
}

for _name, (_filter, _condition) in CONDITIONS.items():
    QUERIES[_name] = _filtered(_filter)
    ORACLES[_name] = f"{NOTES_SQL} SELECT path FROM notes WHERE {_condition}"


@query("expression_cells", "SELECT path, coalesce(title, 'none') AS c0, CASE WHEN instock THEN 'yes' ELSE 'no' END AS c1, 'inf' AS c2, CAST((-size % 7 + 7) % 7 AS VARCHAR) AS c3, CAST(CAST(pow(2, pow(size % 4, 2)) AS BIGINT) AS VARCHAR) AS c4, 'no. ' || keytext || ' of ' || CAST(size AS VARCHAR) AS c5 FROM notes WHERE size IS NOT NULL")
def _cells(spark, sf_dir):
    texts = ['file:get("title") or "none"', 'file:get("inStock") and "yes" or "no"', 'file:get("size") / 0', '-file:get("size") % 7', '2 ^ (file:get("size") % 4) ^ 2', 'string.format("no. %s of %d", file:get("keytext"), file:get("size"))']
    view = _view({"and": ['hasProperty(file, "size")']}, [(t, "") for t in texts])
    return views.cells(notes(spark, sf_dir), view).drop("pos")


#: formula name -> (body, SQL of its text over the notes)
FORMULAS = {
    "class": ('local n = getPropertyValue(file, "size", 0) if n > 40 then return "large" elseif n > 10 then return "middle" end return "small " .. n', "CASE WHEN size > 40 THEN 'large' WHEN size > 10 THEN 'middle' ELSE 'small ' || CAST(size AS VARCHAR) END"),
    "linked": ('return table.concat((function() local t = {}; local all = (getPropertyValue(file, "tags") or {}):toArray(); for i=1, #all do local v = all[i]; table.insert(t, "[" .. v .. "](/tags/" .. v .. ")") end; return t end)(), ", ")', "array_to_string(list_transform(tags, lambda x: '[' || x || '](/tags/' || x || ')'), ', ')"),
    "chosen": ('local t = {} for i, x in ipairs(file:get("tags")) do if string.find(x, "^%u") and i > 1 then t[#t + 1] = x:lower() end end return #t .. ":" .. table.concat(t, "|")', "CAST(len(list_filter(tags[2:], lambda x: regexp_matches(x, '^[A-Z]'))) AS VARCHAR) || ':' || array_to_string(list_transform(list_filter(tags[2:], lambda x: regexp_matches(x, '^[A-Z]')), lambda x: lower(x)), '|')"),
    "numbered": ('local s = "" local n = 0 for i, x in ipairs(file:get("tags")) do n = n + #x s = s .. i .. x:sub(1, 1) end return s .. n', "array_to_string(list_transform(range(1, len(tags) + 1), lambda i: CAST(i AS VARCHAR) || tags[i][1:1]), '') || CAST(list_sum(list_transform(tags, lambda x: length(x))) AS VARCHAR)"),
    "failing": ('local a = 0 for i, x in ipairs(file:get("tags")) do if i == 3 and string.sub(x, -1) == "5" then a = a + x end end return "kept"', "CASE WHEN ends_with(tags[3], '5') THEN '' ELSE 'kept' END"),
}


@query("formula_bodies", f"SELECT path, row_number() OVER (ORDER BY path) AS pos, {', '.join(f'{sql} AS c{i}' for i, (_, sql) in enumerate(FORMULAS.values()))} FROM notes WHERE size IS NOT NULL")
def _bodies(spark, sf_dir):
    names = {f"f_{name}": body for name, (body, _) in FORMULAS.items()}
    view = _view({"and": ['hasProperty(file, "size")']}, [(f"{name}(file)", "") for name in names], formulas=names)
    return views.cells(notes(spark, sf_dir, dealt=True), view)


#: (cell, its SQL over the notes)
TEXTS = (
    ('string.match(getPropertyValue(file, "title", ""), "^%a+")', "coalesce(nullif(regexp_extract(title, '^[A-Za-z]+'), ''), 'nil')"),
    ('string.gsub(file:get("filePath"), "(%w+)/(%w+)%.md", "%2 of %1")', "regexp_replace(path, '([0-9A-Za-z]+)/([0-9A-Za-z]+)\\.md', '\\2 of \\1', 'g')"),
    ('string.find(file:get("title"), " ", 1, true)', "coalesce(CAST(nullif(instr(title, ' '), 0) AS VARCHAR), 'nil')"),
    ('string.find(file:get("title"), "[aeiou]%l")', "CASE WHEN regexp_matches(title, '[aeiou][a-z]') THEN CAST(length(regexp_extract(title, '^((?s:.*?))[aeiou][a-z]', 1)) + 1 AS VARCHAR) ELSE 'nil' END"),
    ('string.sub(file:get("title"), -4, -2)', "CASE WHEN length(title) >= 4 THEN title[length(title) - 3:length(title) - 1] ELSE title[1:length(title) - 1] END"),
    ('string.rep(string.sub(file:get("keytext"), 1, 1), 3, "-")', "concat_ws('-', keytext[1:1], keytext[1:1], keytext[1:1])"),
    ('file:get("title"):upper():reverse()', "reverse(upper(title))"),
    ('math.max(file:get("size"), 25) - math.min(file:get("size"), 25)', "CAST(abs(size - 25) AS VARCHAR)"),
)


@query("expression_text_functions", f"SELECT path, row_number() OVER (ORDER BY path) AS pos, {', '.join(f'{sql} AS c{i}' for i, (_, sql) in enumerate(TEXTS))} FROM notes WHERE size IS NOT NULL AND title IS NOT NULL")
def _text_functions(spark, sf_dir):
    view = _view({"and": ['hasProperty(file, "size")', 'hasProperty(file, "title")']}, [(t, "") for t, _ in TEXTS])
    return views.cells(notes(spark, sf_dir, dealt=True), view)


def store(spark: SparkSession, sf_dir: str) -> NoteStore:
    """A store of the parts and nations; a nation's title is changed after it was saved."""
    made = NoteStore(spark, shared_dir(spark))
    made.init()
    own = stored(spark, sf_dir, ("filePath", "title", "tags", "links"))
    made.save(search(own, "tags=part"))
    nations = search(own, "tags=nation")
    made.save(nations)
    made.update(nations.withColumn("props", F.map_concat(F.map_filter("props", lambda k, v: k != "title"), bag(title=string(F.concat(prop("title")["str"], F.lit("!")))).cast(PROPS))))
    return made


@query("store_find_by_tag", "SELECT md5(path) AS id, path FROM notes WHERE list_contains(tags, 'PROMO')")
def _by_tag(spark, sf_dir):
    made = store(spark, sf_dir)
    return made.find_by_tag("PROMO").select(F.md5(F.col("path").cast("binary")).alias("id"), "path")


@query("store_find_by_id", "SELECT path FROM notes WHERE md5(path) = md5('part/7.md')")
def _by_id(spark, sf_dir):
    return store(spark, sf_dir).find_by_id(hashlib.md5(b"part/7.md").hexdigest()).select("path")


@query("store_notes", "SELECT path, CASE WHEN list_contains(tags, 'nation') THEN title || '!' ELSE title END AS title, array_to_string(tags, ' ') AS tags FROM notes WHERE list_contains(tags, 'nation') OR list_contains(tags, 'part')")
def _stored_notes(spark, sf_dir):
    return store(spark, sf_dir).notes().select("path", prop("title")["str"].alias("title"), F.array_join(as_list("tags"), " ").alias("tags"))


@query("store_backlinks", "SELECT path FROM notes WHERE list_contains(tags, 'nation') AND list_contains(links, 'region/ASIA.md')")
def _store_backlinks(spark, sf_dir):
    return store(spark, sf_dir).find_backlinks("region/ASIA.md").select("path")


@query("store_search", "SELECT path FROM notes WHERE list_contains(tags, 'part') AND list_contains(tags, 'PROMO') AND NOT (title = 'cold widget')")
def _store_search(spark, sf_dir):
    return store(spark, sf_dir).search({"tags": "PROMO"}, {"title": "cold widget"}).select("path")


@query("store_find_by_path", "SELECT path, title FROM notes WHERE path = 'part/11.md'")
def _by_path(spark, sf_dir):
    return store(spark, sf_dir).find_by_path("part/11.md").select("path", F.get_json_object("properties_json", "$.title.str").alias("title"))


@query("store_search_columns", "SELECT path, title FROM notes WHERE list_contains(tags, 'part') AND starts_with(path, 'part/1') AND title > '' AND ends_with(title, 'widget')")
def _column_search(spark, sf_dir):
    return store(spark, sf_dir).search("filePath=part/1*&title=*widget&title=").select("path", prop("title")["str"].alias("title"))


@query("store_tag_counts", "SELECT tag AS term, count(*) AS n FROM (SELECT DISTINCT path, unnest(tags) AS tag FROM notes WHERE list_contains(tags, 'nation') OR list_contains(tags, 'part')) GROUP BY 1")
def _tag_counts(spark, sf_dir):
    return store(spark, sf_dir).counts("tag")


@query("store_tags_without_link", "SELECT path FROM notes WHERE list_contains(tags, 'nation') AND NOT list_contains(links, 'region/ASIA.md')")
def _tag_not_link(spark, sf_dir):
    return store(spark, sf_dir).search({"tags": "nation"}, {"links": "region/ASIA.md"}).select("path")


@query("store_after_changes", "SELECT path, CASE WHEN list_contains(tags, 'nation') THEN title || '!' WHEN list_contains(tags, 'region') THEN title || '?' ELSE title END AS title FROM notes WHERE list_contains(tags, 'nation') OR list_contains(tags, 'region') OR (list_contains(tags, 'part') AND NOT list_contains(tags, 'PROMO'))")
def _changed_store(spark, sf_dir):
    made = store(spark, sf_dir)
    own = stored(spark, sf_dir, ("filePath", "title", "tags", "links"))
    regions = search(own, "tags=region").withColumn("props", F.map_concat(F.map_filter("props", lambda k, v: k != "title"), bag(title=string(F.concat(prop("title")["str"], F.lit("?")))).cast(PROPS)))
    made.apply(regions, search(own, "tags=PROMO").select("path"), batch=("changes", 0))
    made.apply(search(own, "tags=order"), batch=("changes", 0))  # the same batch again
    return made.notes().select("path", prop("title")["str"].alias("title"))


@query("listing", "SELECT path, CAST(2 + (title IS NOT NULL)::INTEGER + (links IS NOT NULL)::INTEGER + (acctbal IS NOT NULL)::INTEGER AS INTEGER) AS n_properties FROM notes WHERE list_contains(tags, 'customer')")
def _listing(spark, sf_dir):
    return listing(notes(spark, sf_dir), "tags=customer").select("path", F.size("props").alias("n_properties"))


@query("links_refreshed", f"""{_NAMES}, l AS (SELECT path, links[1] AS link, string_split(links[1], '/')[-1] AS base FROM notes WHERE links IS NOT NULL),
r AS (SELECT l.path, link, a.path AS p1, coalesce(c.path, b.path) AS p2 FROM l LEFT JOIN dictionary a ON a.name = base LEFT JOIN dictionary b ON b.name = base LEFT JOIN dictionary c ON c.name = regexp_replace(base, '\\.md$', ''))
SELECT path, array_to_string(list_filter([link, CASE WHEN p1 <> link THEN p1 END, CASE WHEN p2 <> link AND p2 IS DISTINCT FROM p1 THEN p2 END], lambda x: x IS NOT NULL), ' ') AS links FROM r""")
def _refreshed(spark, sf_dir):
    own = parsed(spark, sf_dir)
    # Written, as a test of the links would look for them again.
    done = materialize(links.refresh_links(links.rewrite_wikilinks(own, links.name_dictionary(own))))
    return done.where(F.size(as_list("links")) > 0).select("path", F.array_join(as_list("links"), " ").alias("links"))


@query("round_changes", f"""{_NAMES}, l AS (SELECT path, links[1] AS link, string_split(links[1], '/')[-1] AS base FROM notes WHERE links IS NOT NULL),
r AS (SELECT l.path, link, a.path AS p1, coalesce(c.path, b.path) AS p2 FROM l LEFT JOIN dictionary a ON a.name = base LEFT JOIN dictionary b ON b.name = base LEFT JOIN dictionary c ON c.name = regexp_replace(base, '\\.md$', ''))
SELECT path, array_to_string(list_filter([CASE WHEN p1 <> link THEN p1 END, CASE WHEN p2 <> link AND p2 IS DISTINCT FROM p1 THEN p2 END], lambda x: x IS NOT NULL), ' ') AS added, true AS rewritten FROM r WHERE p1 IS NOT NULL OR p2 IS NOT NULL""")
def _changes(spark, sf_dir):
    own = parsed(spark, sf_dir)
    return changes(own, update(own)).select("path", F.array_join("added", " ").alias("added"), "rewritten")


@query("event_property_json", None)
def _events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


ORACLES["event_property_json"] = "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1"


@query("json_result_size", "SELECT count(*) AS result_size FROM notes WHERE list_contains(tags, 'PROMO')")
def _json(spark, sf_dir):
    return export.result_size(search(notes(spark, sf_dir), "tags=PROMO")).select(F.col("resultSize").alias("result_size"))


@query("json_result_text", """SELECT '{"resultSize":' || count(*) || ',"files":[' || string_agg(json, ',' ORDER BY json) || ']}' AS json FROM (SELECT '{' || array_to_string(list_sort(['"filePath":"' || path || '"', '"title":"' || title || '"', '"tags":["' || array_to_string(tags, '","') || '"]']), ',') || '}' AS json FROM notes WHERE list_contains(tags, 'region'))""")
def _json_text(spark, sf_dir):
    return export.json_result(search(notes(spark, sf_dir), "tags=region")).select("json")


@query("json_rows", """SELECT path, '{' || array_to_string(list_sort(list_filter(['"filePath":"' || path || '"', '"title":"' || title || '"', '"tags":["' || array_to_string(tags, '","') || '"]', '"links":["' || array_to_string(links, '","') || '"]', '"acctbal":' || CAST(acctbal AS VARCHAR)], lambda x: x IS NOT NULL)), ',') || '}' AS json FROM notes WHERE list_contains(tags, 'nation')""")
def _json_rows(spark, sf_dir):
    return export.json_rows(search(notes(spark, sf_dir), "tags=nation"))


@query("export_plan", "SELECT path, CASE WHEN list_contains(tags, 'BUILDING') THEN 'write' ELSE 'copy' END AS action, path AS destination FROM notes WHERE list_contains(tags, 'customer') UNION ALL SELECT 'img/logo.png', 'copy', 'img/logo.png' FROM (SELECT count(*) AS n FROM notes WHERE list_contains(tags, 'customer')) WHERE n > 0")
def _export(spark, sf_dir):
    own = notes(spark, sf_dir, ("filePath", "tags"))
    rewritten = F.when(F.array_contains(as_list("tags"), "BUILDING"), F.lit("text"))
    # A plain map constructor again, so that a test of a tag is one of the tables' own columns.
    pictured = bag(filePath=string(F.col("path")), tags=strings(as_list("tags")), links=strings(F.array(F.lit("img/logo.png|80"), F.col("path"))))
    return export.export_plan(own.withColumn("rendered", rewritten).withColumn("props", pictured), "tags=customer")
