"""Results as JSON and as files.

The export plan is a DataFrame of file operations; ``export`` carries it out in tasks, one
file at a time. A dry run returns the plan only.
"""

from __future__ import annotations

import errno
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, spread
from ..sources.vault import list_names
from .links import IMAGE, linked_images
from .search import search


def json_rows(notes: DataFrame) -> DataFrame:
    """Each note's properties as JSON with plain values; nulls are left out."""
    value = lambda v: F.when(v["kind"] == "list", F.to_json(v["list"])).when(v["kind"] == "string", F.regexp_extract(F.to_json(F.struct(v["str"].alias("x"))), r"^\{\"x\":(.*)\}$", 1)).when(v["kind"] == "int", v["int"].cast("string")).when(v["kind"] == "double", v["num"].cast("string")).when(v["kind"] == "bool", v["bool"].cast("string")).otherwise(v["json"])
    quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    fields = F.transform(F.map_entries(F.map_filter("props", lambda k, v: v["kind"] != "null")), lambda e: F.concat(quoted(e["key"]), F.lit(":"), value(e["value"])))
    return notes.select("path", F.concat(F.lit("{"), F.array_join(F.array_sort(fields), ","), F.lit("}")).alias("json"))


def result_size(notes: DataFrame) -> DataFrame:
    """One row: the number of results, counted without putting them together."""
    return json_rows(notes).select("json").distinct().agg(F.count("*").alias("resultSize"))


def json_result(notes: DataFrame) -> DataFrame:
    """One row: the number of results and all of them as a JSON text, for results that a client reads whole."""
    rows = json_rows(notes).select("json").distinct()
    return rows.agg(F.count("*").alias("resultSize"), F.concat(F.lit('{"resultSize":'), F.count("*").cast("string"), F.lit(',"files":['), F.array_join(F.sort_array(F.collect_list("json")), ","), F.lit("]}")).alias("json"))


def export_plan(notes: DataFrame, query: str = "", kind: str = "markdown") -> DataFrame:
    """(path, action, destination): images that notes link to are copied, then the notes.

    ``markdown`` writes a rewritten note's text and copies others; ``copy`` copies all.
    """
    return _plan(notes, query, kind).drop("text")


def _plan(notes: DataFrame, query: str, kind: str) -> DataFrame:
    """The plan, with the texts that are to be written."""
    if kind not in ("markdown", "copy"):
        raise ValueError("kind must be markdown or copy")
    found = search(notes, query)
    writes = F.col("rendered").isNotNull() & F.lit(kind == "markdown")
    # Written once: images, notes, their texts and what is among both are all made of it.
    rows = materialize(found.select("path", F.when(writes, "write").otherwise("copy").alias("action"), F.when(writes, F.col("rendered")).alias("text"), linked_images().alias("images")))
    images = rows.select(F.explode("images").alias("path")).distinct()
    # The notes that are images themselves, so that the images meet no others.
    among = rows.select("path").where(F.col("path").rlike(IMAGE))
    copied = images.join(among, "path", "left_anti").select("path", F.lit("copy").alias("action"), F.col("path").alias("destination"), F.lit(None).cast("string").alias("text"))
    return rows.select("path", "action", F.col("path").alias("destination"), "text").unionByName(copied)


def carry_out(rows: list[tuple], vault: str, out: str) -> list[str]:
    """What was done with each (path, action, destination, text, kept).

    A file is written in a folder of the work's own and then put in its place, so that it is whole or
    absent at any time, and doing the work again, or twice at once, ends and reports alike. Tasks that fill one
    folder wait for each other there, so a place is not looked at before it is found taken.
    """
    done, top, folders, made = [], os.path.realpath(out) + os.sep, {}, set()
    work = os.path.join(out, f".{uuid.uuid4().hex}.part")
    own = os.path.join(work, "file")

    def inside(target: str) -> bool:
        """Whether the place is below the folder, links to folders followed; a folder is looked at once."""
        folder, name = os.path.split(target)
        if name in ("", ".", ".."):
            return os.path.realpath(target).startswith(top)
        if folder not in folders:
            folders[folder] = os.path.realpath(folder)
        return os.path.join(folders[folder], name).startswith(top)

    def leads_out(target: str) -> bool:
        return os.path.islink(target) and not os.path.realpath(target).startswith(top)

    try:
        for path, action, to, text, kept in rows:
            target, source = os.path.join(out, to), os.path.join(vault, path)
            there = action == "write" or os.path.exists(source)
            if not inside(target):
                done.append("outside")
            elif not there or (kept and action != "write"):
                done.append("outside" if leads_out(target) else "kept" if there else "missing")
            else:
                for folder in (work, os.path.dirname(target)):
                    if folder not in made:
                        os.makedirs(folder, exist_ok=True)
                        made.add(folder)
                if action == "write":
                    with open(own, "wb") as f:
                        f.write(text.encode())
                else:
                    shutil.copyfile(source, own)
                done.append("outside" if not put(own, target, leads_out) else "written" if action == "write" else "copied")
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return done


def put(own: str, target: str, leads_out: Callable[[str], bool]) -> bool:
    """Move a file to its place, whole: by a link if the place is free, else by a new name, which replaces what is
    there; false if that is a link that leads out."""
    try:
        os.link(own, target)
    except OSError:  # taken, or there are no such links here
        if leads_out(target):
            return False
        try:
            os.replace(own, target)
        except OSError as e:
            if e.errno != errno.EXDEV:
                raise
            # The place is on another file system.
            beside = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.part")
            try:
                shutil.copyfile(own, beside)
                os.replace(beside, target)
            finally:
                with suppress(FileNotFoundError):
                    os.unlink(beside)
    # Gone, if it has a new name; what comes next must not be written into it.
    with suppress(FileNotFoundError):
        os.unlink(own)
    return True


def export(notes: DataFrame, vault: str, out: str, query: str = "", kind: str = "markdown", dry_run: bool = False) -> DataFrame:
    """Carry the plan out between two folders that all tasks can reach; returns the plan with what was done.

    Files to be copied that were there before the export began are kept. The work is done once, before
    this returns.
    """
    plan = _plan(notes, query, kind)
    if dry_run:
        return plan.drop("text").withColumn("done", F.lit("dry run"))
    # Listed before anything is written: a task that runs again must not find its own files.
    there = list_names(notes.sparkSession, out).select(F.col("path").alias("destination"), F.lit(True).alias("kept"))
    asked = plan.join(there, "destination", "left").select("path", "action", "destination", "text", F.coalesce("kept", F.lit(False)).alias("kept"))

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = carry_out(list(zip(*(c.to_pylist() for c in b.columns), strict=True)), vault, out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(done, pa.string())], names=["path", "action", "destination", "done"])

    # A file is dear beside its name, and the plan's files hold many names.
    return materialize(spread(asked).mapInArrow(act, "path string, action string, destination string, done string"))
