"""A vault folder as a stream: new Markdown files become notes as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import NoteStore
from ..shared import discard, materialize
from ..sources.vault import notes_from_files


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw, modified) of files that appear below the folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), r"^[a-z]+:/*", "/")
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    return files.select(F.substring(plain, F.length(root) + 2, F.length(plain)).alias("path"), F.decode("content", "UTF-8").alias("raw"), F.col("modificationTime").alias("modified"))


def note_stream(spark: SparkSession, folder: str, require_front_matter: bool = True) -> DataFrame:
    """Notes of files that appear below the folder."""
    return notes_from_files(file_stream(spark, folder).select("path", "raw"), require_front_matter)


def append_notes(notes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a Parquet folder, once for each file."""
    return notes.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_files(files: DataFrame, store: NoteStore, batch: tuple[str, int] | None = None, require_front_matter: bool = True) -> bool:
    """Put files (path, raw, modified) into a store: of one path the latest counts, also against a stored one.

    A file that is a note no more removes the note. A batch is applied once.
    """
    last = files.groupBy("path").agg(F.max(F.struct("modified", "raw")).alias("x")).select("path", "x.modified", "x.raw")
    known = store.modified().withColumnRenamed("modified", "was")
    last = materialize(last.join(known, "path", "left").where("was is null or modified >= was").drop("was"))
    notes = materialize(notes_from_files(last.select("path", "raw"), require_front_matter).join(last.select("path", "modified"), "path"))
    done = store.apply(notes, last.select("path").join(notes.select("path"), "path", "left_anti"), batch=batch)
    discard(notes, last)
    return done


def upsert_notes(spark: SparkSession, folder: str, store: NoteStore, checkpoint: str, name: str = "vault", deliveries: bool = False) -> StreamingQuery:
    """Merge files that appear below the folder into a store, each batch once.

    A file source takes up a path once. With ``deliveries`` the first folder of a path is the name of
    a delivery and the rest the note's path, so that changed files can come in a further delivery.
    """
    files = file_stream(spark, folder)
    if deliveries:
        files = files.withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))

    def merge(batch: DataFrame, number: int) -> None:
        merge_files(batch, NoteStore(batch.sparkSession, store.folder), (name, number))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
