"""A folder of notes as a DataFrame: path, ext, raw, rendered, props.

Files whose name ends in ``.md`` (any case) are Markdown: their front matter gives the
properties. Markdown without usable front matter is left out unless
``require_front_matter`` is off; other files carry their path only.
"""

from __future__ import annotations

import errno
import os
from collections.abc import Iterator
from datetime import datetime
from functools import reduce
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.frontmatter import BLOCK, front_matter_json
from ..operators.links import with_links
from ..operators.store import NoteStore
from ..schema import PROPS, bag, string
from ..shared import discard, materialize


#: Files that a task reads, and characters of text in a batch of them.
FILES, AT_ONCE = 20_000, 1 << 22


def notes_from_files(files: DataFrame, require_front_matter: bool = True) -> DataFrame:
    """Notes of (path, raw) rows, the path being relative to the vault."""
    markdown = F.lower("path").endswith(".md")
    rows = files.select("path", F.when(F.instr(F.element_at(F.split("path", "/"), -1), ".") > 0, F.element_at(F.split("path", r"\."), -1)).alias("ext"), F.when(markdown, F.col("raw")).alias("raw"))
    parsed = rows.withColumn("matter", F.when(F.col("raw").isNotNull(), front_matter_json(F.col("raw"))))
    if require_front_matter:
        parsed = parsed.where(F.col("raw").isNull() | F.col("matter").isNotNull())
    own = F.map_filter(F.coalesce(F.from_json("matter", PROPS), F.create_map().cast(PROPS)), lambda k, v: k != "filePath")
    notes = parsed.select("path", "ext", "raw", F.lit(None).cast("string").alias("rendered"), F.map_concat(own, bag(filePath=string(F.col("path"))).cast(PROPS)).alias("props"))
    return with_links(notes)


def load_errors(files: DataFrame) -> DataFrame:
    """(path, error) of the Markdown files that are left out, with the reason."""
    block = F.regexp_extract("raw", BLOCK, 1)
    why = F.when(~F.col("raw").rlike(BLOCK), "no front matter").when(~block.rlike(r"\S"), "empty front matter").otherwise("front matter is not a mapping")
    markdown = files.where(F.lower("path").endswith(".md") & F.col("raw").isNotNull())
    return markdown.withColumn("matter", front_matter_json(F.col("raw"))).where("matter is null").select("path", why.alias("error"))


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
    return fs, root.rstrip("/")


def _is_folder(entry: os.DirEntry) -> bool | None:
    """Whether the entry is a folder, links followed; null if it is no file either or leads nowhere."""
    try:
        return True if entry.is_dir() else False if entry.is_file() else None
    except OSError as e:
        if e.errno not in (errno.ELOOP, errno.ENOTDIR):
            raise
        return None


def _entries(folder: str, hidden: bool) -> Iterator[tuple[str, None, None, bool]]:
    """What is in a local folder, one after another, however many there are; nothing if it is missing.

    The folder tells which of them are folders, so none but links are looked at.
    """
    try:
        found = os.scandir(folder)
    except (FileNotFoundError, NotADirectoryError):
        return
    with found:
        for x in found:
            if (hidden or x.name[:1] not in (".", "_")) and (kind := _is_folder(x)) is not None:
                yield os.path.join(folder, x.name), None, None, kind


def _selected(fs: pafs.FileSystem, folder: str, hidden: bool) -> Iterator[tuple[str, int | None, datetime | None, bool]]:
    """The same of a folder elsewhere, with the length and time that its listing gives."""
    for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if (hidden or x.base_name[:1] not in (".", "_")) and x.type != pafs.FileType.NotFound:
            yield x.path, x.size if x.is_file else None, x.mtime, not x.is_file


def list_names(spark: SparkSession, folder: str, hidden: bool = True) -> DataFrame:
    """(path, length, modified) of every file below the folder, in any depth; the latter two are null in a local folder.

    Tasks list the folders level by level; what a level finds is written, and its folders are the next
    one's work, so the driver holds no names however large the vault is. A missing folder is empty.
    """
    fs, root = _file_system(folder)
    local = isinstance(fs, pafs.LocalFileSystem)
    schema = "path string, length long, modified timestamp, folder boolean"
    kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                place = f"{root}/{path}".rstrip("/") or "/"
                found = _entries(place, hidden) if local else _selected(fs, place, hidden)
                while part := list(islice(found, 10_000)):
                    paths, *others = zip(*part, strict=True)
                    columns = [[x[len(root) + 1 :] for x in paths], *others]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        levels.append(materialize(folders.mapInArrow(look, schema), by="folder"))
        folders = levels[-1].where("folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, [x.where("not folder").drop("folder") for x in levels])
        folders = folders.repartition("path")


def list_files(spark: SparkSession, folder: str, hidden: bool = True) -> DataFrame:
    """(path, length, modified) of every file below the folder, in any depth, as a written table; a missing folder is empty.

    One task lists a folder, however many files are in it; they are dealt over tasks to be looked at.
    """
    fs, root = _file_system(folder)
    names = list_names(spark, folder, hidden)
    if not isinstance(fs, pafs.LocalFileSystem):
        return materialize(names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            rows = [(p, x.size, x.mtime) for p, x in zip(paths, fs.get_file_info([f"{root}/{p}" for p in paths]), strict=True) if x.is_file]
            columns = zip(*rows, strict=True) if rows else [()] * 3
            kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "length", "modified"])

    return materialize(_dealt(names.select("path")).mapInArrow(look, names.schema))


def _dealt(files: DataFrame) -> DataFrame:
    """Files dealt over a number of tasks by their number: their names are small, and few tasks would get all."""
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // FILES))
    return files.repartition(tasks, "path")


def read_listed(files: DataFrame, folder: str) -> DataFrame:
    """The listed files (column ``path``) with ``raw``, the text of those that are Markdown; tasks read them one at a time."""
    fs, root = _file_system(folder)
    names = files.columns
    at = names.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, size = [], 0
            for i, path in enumerate(b.column(at).to_pylist(), 1):
                raw = None
                if path.lower().endswith(".md"):
                    with fs.open_input_stream(f"{root}/{path}") as f:
                        raw = f.read().decode("utf-8", "replace")
                texts.append(raw)
                size += len(raw or "")
                if i == b.num_rows or size > AT_ONCE:
                    yield pa.RecordBatch.from_arrays([*b.slice(i - len(texts), len(texts)).columns, pa.array(texts, pa.string())], names=[*names, "raw"])
                    texts, size = [], 0

    return _dealt(files).mapInArrow(read, StructType([*files.schema.fields, StructField("raw", StringType())]))


def hidden_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw) of the files that Spark's sources pass over: those with a name, or below a
    folder, that begins with a dot or an underscore."""
    return read_listed(list_names(spark, folder).where(F.col("path").rlike(r"(^|/)[._]")).select("path"), folder)


def read_files(spark: SparkSession, folder: str, hidden: bool = True) -> DataFrame:
    """(path, raw) of every file below the folder, in any depth; without ``hidden``, none with a name,
    or below a folder, that begins with a dot or an underscore.

    Listed and read by tasks: Spark's file sources list on the driver, count each small file as megabytes
    and give a task to a few of them.
    """
    fs, root = _file_system(folder)
    if fs.get_file_info(root or "/").type == pafs.FileType.NotFound:
        raise FileNotFoundError(folder)
    return read_listed(list_names(spark, folder, hidden).select("path"), folder)


def read_vault(spark: SparkSession, folder: str, require_front_matter: bool = True) -> DataFrame:
    """All notes of a folder."""
    return notes_from_files(read_files(spark, folder), require_front_matter)


def sync(store: NoteStore, folder: str, require_front_matter: bool = True) -> DataFrame:
    """Bring a store up to a folder: (path, what) of the files that are ``new``, ``changed`` or ``gone``.

    The listing that the store was brought to is kept with its version and compared with the folder's,
    by length and time of modification. Only new and changed files are read and parsed; notes of files
    that are gone, or that are notes no more, are removed. A renamed file is gone and new.
    """
    spark = store.spark
    listed = list_files(spark, folder)
    before = store.listing().select("path", F.struct("length", "modified").alias("was"))
    same = F.struct("length", "modified").eqNullSafe(F.col("was"))
    what = F.when(F.col("modified").isNull(), "gone").when(F.col("was").isNull(), "new").when(~same, "changed")
    moved = materialize(listed.join(before, "path", "full").select("path", "modified", what.alias("what")).where("what is not null"))
    if moved.isEmpty():
        discard(listed)
        return moved.select("path", "what")
    texts = materialize(read_listed(moved.where("what <> 'gone'").select("path", "modified"), folder))
    notes = materialize(notes_from_files(texts, require_front_matter).join(texts.select("path", "modified"), "path"))
    store.apply(notes, moved.select("path").join(notes.select("path"), "path", "left_anti"), listing=listed)
    discard(texts, notes, listed)
    return moved.select("path", "what")
