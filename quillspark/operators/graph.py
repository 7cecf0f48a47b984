"""Links and tags between notes: edges, neighbourhoods, backlinks, reachability.

Every step is an equi-join or a partial aggregation. A tag or target that many notes share
is one key of a semi join, whose other side is made distinct first; adaptive execution
splits the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import as_list, prop
from ..shared import materialize
from .search import GRAPH_KEYS, project, search


#: Tags that are patterns, with ``compat_tag_query``; each is tested on every tag.
MAX_ODD = 1000


def edges(notes: DataFrame) -> DataFrame:
    """(src, pos, dst) for every link of every note."""
    return notes.select(F.col("path").alias("src"), F.posexplode(as_list("links")).alias("pos", "dst"))


def tags(notes: DataFrame) -> DataFrame:
    """(path, tag) for every tag of every note, a scalar being one tag."""
    return notes.select("path", F.explode(as_list("tags")).alias("tag"))


def neighbourhood(notes: DataFrame, query: str, compat_tag_query: bool = False, **options) -> DataFrame:
    """Matching notes, notes they link to, and all notes that share a tag with any of these.

    With ``compat_tag_query`` each tag is read as the value of a query ``tags=<tag>``: a tag
    that begins or ends with a star, or begins with ``<`` or ``>``, then reaches all notes that
    such a query finds.
    """
    found = search(notes, query, **options)
    targets = found.select(F.explode(F.concat(as_list("links"), as_list("backlinks"))).alias("dst"))
    targets = targets.select(F.explode(F.array("dst", F.concat(F.lit("/"), "dst"))).alias("path")).distinct()
    near = notes.select("path").join(targets, "path", "left_semi").union(found.select("path")).distinct()
    every = tags(notes)
    shared = every.join(near, "path", "left_semi").select("tag").distinct()
    reached = every.join(shared, "tag", "left_semi").select("path").union(near).distinct()
    if compat_tag_query:
        # Tags that a query reads as a pattern are few; the others are handled by the equal join.
        odd = shared.where(F.col("tag").rlike(r"^[*<>]|\*$"))
        tests = F.when(F.col("odd").endswith("*"), F.col("tag").startswith(F.expr("substring(odd, 1, length(odd) - 1)"))).otherwise(F.col("tag").endswith(F.expr("substring(odd, 2)")))
        held = odd.agg(F.collect_set("tag").alias("all")).select(F.slice("all", 1, MAX_ODD).alias("all"), F.size("all").alias("n")).first()
        if held["n"] > MAX_ODD:
            raise ValueError(f"{held['n']} tags are patterns; at most {MAX_ODD} can be looked up at once")
        patterns = F.array(*[F.lit(t) for t in held["all"]]).cast("array<string>")
        lists = prop("tags")["kind"] == "list"
        wide = every.join(notes.where(lists).select("path"), "path", "left_semi").withColumn("odd", F.explode(patterns)).where(tests).select("path")
        reached = reached.union(wide).distinct()
    return project(notes.join(reached, "path", "left_semi"), include=GRAPH_KEYS)


def backlinks(notes: DataFrame) -> DataFrame:
    """(path, backlinks) for each note that others link to, in order of path."""
    linked = edges(notes).select("src", F.col("dst").alias("path")).distinct().join(notes.select("path"), "path", "left_semi")
    return linked.groupBy("path").agg(F.sort_array(F.collect_set("src")).alias("backlinks"))


def backlink_counts(notes: DataFrame) -> DataFrame:
    """(path, n): how many notes link to each linked note; nothing is collected."""
    linked = edges(notes).select("src", F.col("dst").alias("path")).distinct().join(notes.select("path"), "path", "left_semi")
    return linked.groupBy("path").agg(F.count("*").alias("n"))


def outgoing(notes: DataFrame, path: str) -> DataFrame:
    """The notes that one note links to."""
    own = edges(notes.where(F.col("path") == path)).select(F.col("dst").alias("path")).distinct()
    return notes.join(own, "path", "left_semi")


def within(notes: DataFrame, query: str, depth: int) -> DataFrame:
    """(path, depth): notes at most ``depth`` links away from the matches, with the least depth."""
    steps = materialize(edges(notes).select("src", "dst").join(notes.select(F.col("path").alias("dst")), "dst", "left_semi").distinct())
    front = materialize(search(notes, query).select("path", F.lit(0).alias("depth")))
    reached = front
    for d in range(1, depth + 1):
        step = steps.join(front.select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct()
        # Written for each hop, so that the plan does not grow with the depth.
        front = materialize(step.join(reached.select("path"), "path", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        reached = reached.union(front)
    return reached
