"""The stages from raw notes to final text and links.

raw text -> properties -> embedded views rendered -> wikilinks rewritten -> links renewed.
Views see the properties of the stage before. Equal view blocks are rendered once, however many
notes embed them, and all different ones together; a block that cannot be read or compiled is
logged and becomes empty, and does not touch the others.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import UnsupportedExpression
from ..operators.links import name_dictionary, refresh_links, rewrite_wikilinks, sought, wikilinks
from ..operators.views import View, filter_condition, from_base, head, line, rendered
from ..schema import as_list
from ..shared import materialize

# Fixed value: a fenced block that holds a view of the base dialect.
BLOCK = r"(?s)```base(.*?)```"
#: Views that are evaluated in one scan of the notes; each adds its filter and line to the scan's plan.
AT_ONCE = 200
FAILURES = (UnsupportedExpression, PySparkException, ValueError, AttributeError, KeyError, TypeError, RecursionError)
log = logging.getLogger(__name__)


def compiled(notes: DataFrame, text: str) -> View | None:
    """The view that a block describes, if it can be compiled over the notes."""
    try:
        view = from_base(text)
        if head(view) is not None:
            notes.select(line(view), filter_condition(view.filters, view.formulas) if view.filters else F.lit(True))
    except FAILURES as e:
        log.warning("a view was left out: %s", e)
        return None
    return view


def rendered_blocks(notes: DataFrame, texts: list[str]) -> DataFrame | None:
    """(block, view) of those view texts that can be rendered, from one scan for each ``AT_ONCE`` of them."""
    views = [(text, view) for text in texts if (view := compiled(notes, text)) is not None]
    made = []
    for first in range(0, len(views), AT_ONCE):
        part = dict(enumerate(views[first : first + AT_ONCE]))
        names = notes.sparkSession.createDataFrame([(i, text) for i, (text, _) in part.items()], "view int, block string")
        made.append(rendered(notes, {i: view for i, (_, view) in part.items()}).join(names, "view").select("block", F.col("text").alias("view")))
    return reduce(DataFrame.union, made) if made else None


def render_blocks(notes: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """Add ``rendered``: the text with its view blocks replaced by the views; null without views.

    The views show ``everything``, or the notes themselves. A block that fails becomes empty; a text
    in which all fail stays as it is. The driver compiles the different blocks, as they are code; their
    rows never reach it.
    """
    found = F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit(BLOCK), F.lit(1))
    with_blocks = notes.where(F.col("raw").contains("```base"))
    texts = [r["block"] for r in with_blocks.select(F.explode(found).alias("block")).distinct().orderBy("block").collect()]
    views = rendered_blocks(notes if everything is None else everything, texts)
    if views is None:
        return notes.withColumn("rendered", F.lit(None).cast("string"))
    tokens = with_blocks.select("path", F.posexplode(found).alias("pos", "block"))
    placed = tokens.join(views, "block", "left").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("view", F.lit("")).alias("view")))).alias("items"), F.max(F.col("view").isNotNull()).alias("hit"))
    pieces = F.zip_with(F.split("raw", BLOCK, -1), F.concat(F.col("items")["view"], F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    shown = with_blocks.drop("rendered").join(placed, "path", "left").withColumn("rendered", F.when(F.coalesce("hit", F.lit(False)), F.array_join(pieces, ""))).drop("items", "hit")
    # Notes without a view block stay out of the join.
    others = notes.drop("rendered").where(~F.coalesce(F.col("raw").contains("```base"), F.lit(False)))
    return shown.unionByName(others.withColumn("rendered", F.lit(None).cast("string")))


def update(notes: DataFrame, rounds: int = 1) -> DataFrame:
    """All stages: views, wikilinks, links.

    Each further round works on the notes that the one before rewrote, and ends early when there are
    none. A note that was not rewritten has the same text, and names do not change, so it has nothing
    to gain; its text is not read again. Views see the properties as the round before left them.
    A note without text has nothing to render, rewrite or find links in: it stays as it is, and is not written.
    """
    if rounds <= 1:
        return materialize(_round(notes, name_dictionary(notes)))  # a test of the links would look for them again
    texts, silent = notes.where("raw is not null"), notes.where("raw is null").withColumn("rendered", F.lit(None).cast("string"))
    seen = silent.select("path", "props")
    first = materialize(_round_of_few(texts, notes, notes.select("path", "props")).withColumn("__new", F.col("rendered").isNotNull()), by="__new")
    work, layers = worklist(first), []
    for n in range(1, rounds):
        if work.isEmpty():
            break
        again = _round_of_few(work, notes, latest(first, layers).select("path", "props").unionByName(seen))
        changed = F.col("rendered").isNotNull() & (F.col("rendered") != F.col("raw"))
        layer = materialize(again.withColumns({"__new": changed, "__round": F.lit(n)}), by="__new")
        layers.append(layer.where("__new").select("path", "rendered", "props", "__round"))
        work = worklist(layer)
    return latest(first, layers).select(*notes.columns).unionByName(silent.select(*notes.columns))


def worklist(done: DataFrame) -> DataFrame:
    """The notes that a round rewrote, to be worked on again: only their files are read."""
    return done.where("__new").select("path", "ext", F.col("rendered").alias("raw"), F.lit(None).cast("string").alias("rendered"), "props")


def latest(first: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """The notes with the text and properties of the last round that rewrote them.

    Only notes that the first round rewrote can be in later ones; the others stay out of the join.
    """
    if not layers:
        return first
    last = reduce(DataFrame.union, layers).groupBy("path").agg(F.max_by(F.struct("rendered", "props"), "__round").alias("__last"))
    again = first.where("__new").join(last, "path", "left").withColumns({"rendered": F.coalesce("__last.rendered", "rendered"), "props": F.coalesce("__last.props", "props")}).drop("__last")
    return again.unionByName(first.where("not __new"))


def _round(notes: DataFrame, names: DataFrame) -> DataFrame:
    return _linked(_viewed(notes), names).select(*notes.columns)


def _round_of_few(work: DataFrame, notes: DataFrame, everything: DataFrame) -> DataFrame:
    """A round over some of the notes, whose views show everything.

    Only the names that their wikilinks ask for are looked up among all notes, which may be many more.
    """
    viewed = materialize(_viewed(work, everything))  # so that views are joined once and not for each use of the texts
    asked = materialize(wikilinks(viewed, "__text").select(sought(F.col("target")).alias("name")).distinct())
    return _linked(viewed, name_dictionary(notes, asked)).select(*work.columns)


def _viewed(notes: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    return render_blocks(notes.drop("rendered"), everything).withColumnRenamed("rendered", "__viewed").withColumn("__text", F.coalesce("__viewed", "raw"))


def _linked(viewed: DataFrame, names: DataFrame) -> DataFrame:
    linked = rewrite_wikilinks(viewed, names, "__text")
    return refresh_links(linked.withColumn("rendered", F.coalesce("rendered", "__viewed")).drop("__viewed", "__text"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, added, rewritten): the links that a round added to a note, and whether its text changed.

    Only notes with either are returned: they, and the notes that they link to, are the next
    round's work.
    """
    old = before.select("path", as_list("links").alias("__links"), F.col("rendered").alias("__text"))
    both = after.join(old, "path")
    added = F.array_except(as_list("links"), F.col("__links"))
    rewritten = ~F.col("rendered").eqNullSafe(F.col("__text"))
    return both.select("path", added.alias("added"), rewritten.alias("rewritten")).where((F.size("added") > 0) | F.col("rewritten"))
