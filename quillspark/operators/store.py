"""A persistent table of notes: buckets of Parquet, frequent properties as columns, a term index.

Below the store's folder:

* ``rows/write=W/bucket=B``: the notes of bucket B (by the md5 of their path), ordered by path, as
  write W left them. The properties that were frequent at the first write are typed columns
  (structs with a field for each kind), the others JSON.
* ``terms/write=W/slot=S``: which buckets of write W hold a tag or a link target, and in how many
  notes, ordered by term and with Bloom filters. However many notes share a tag, it has a row for each bucket.
* ``files-L``: the listing of a vault's files, if the store was brought to one.
* ``version-N``: the manifest of version N: the write that holds each bucket, the columns, the listing.

A change reads and writes the buckets that it touches, then names them in the next version by
one rename of a folder, which fails if another writer was first; a writer that stops before that
changes nothing. Earlier versions stay readable (``at``) until ``vacuum``. Finding by path, id, tag
or link reads the buckets in question only. What the driver holds of all this is the manifest:
a number for each bucket, so ``buckets`` bounds it; choose it so that one bucket suits one task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PROPS, VALUE, as_list, is_kind
from ..shared import discard, materialize, remove
from .search import parse, predicate

ROW = "id string, path string, created_at timestamp, updated_at timestamp, modified timestamp"
TERMS = "kind string, term string, n long, write string, slot int, bucket int"
#: Where the properties are that the index knows.
INDEXED = {"tag": "tags", "link": "links"}


@dataclass(frozen=True)
class Manifest:
    """What a version consists of."""

    number: int = 0
    n_buckets: int = 16
    n_slots: int = 16
    #: Bucket -> the write that holds its rows.
    writes: dict[int, str] = field(default_factory=dict)
    #: The promoted properties, in the order of their columns ``p0, p1, ...``; null before the first write.
    keys: list[str] | None = None
    #: Promoted property -> the kinds that it was ever stored with.
    kinds: dict[str, list[str]] = field(default_factory=dict)
    #: Stream -> the last batch of it that is in the store.
    batches: dict[str, int] = field(default_factory=dict)
    #: The folder with the listing of files that the notes were read from.
    files: str | None = None


def bucket_of(path: str, n_buckets: int) -> int:
    return int(hashlib.md5(path.encode()).hexdigest()[:7], 16) % n_buckets


def _bucket(path: Column, n_buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(path.cast("binary")), 1, 7), 16, 10).cast("long") % n_buckets).cast("int")


class NoteStore:
    """Save, update and find notes below one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, slots: int = 16, least_share: float = 0.01, most_columns: int = 64, version: int | None = None):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        self.buckets, self.slots, self.least_share, self.most_columns = buckets, slots, least_share, most_columns

    def at(self, version: int) -> NoteStore:
        """The store as an earlier version had it, for reading."""
        return NoteStore(self.spark, self.folder, version=version)

    # --- versions

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        path, fs = self._path(pattern)
        return [x.getPath().getName() for x in fs.globStatus(path) or ()]

    def versions(self) -> list[int]:
        return sorted(int(x[8:]) for x in self._names("version-*") if x[8:].isdigit())

    def manifest(self) -> Manifest:
        known = self.versions()
        number = known[-1] if self.version is None else self.version
        if number not in known:
            raise KeyError(f"there is no version {number}")
        found = json.loads(self.spark.read.text(f"{self.folder}/version-{number}").first()["value"])
        return Manifest(**found | {"writes": {int(k): v for k, v in found["writes"].items()}})

    def init(self) -> None:
        """Create an empty table, unless there is one."""
        if not self.versions():
            self._commit(Manifest(number=1, n_buckets=self.buckets, n_slots=self.slots))

    def _commit(self, made: Manifest) -> None:
        """Make the next version of its manifest; of several writers of one number the first wins."""
        if self.version is not None:
            raise ValueError("an earlier version is for reading")
        (own, fs), (to, _) = self._path(name := f"next-{uuid.uuid4().hex}"), self._path(f"version-{made.number}")
        self.spark.createDataFrame([(json.dumps(asdict(made)),)], "value string").coalesce(1).write.text(f"{self.folder}/{name}")
        lost = fs.exists(to) or not fs.rename(own, to)
        below, _ = self._path(f"version-{made.number}/{name}")
        if lost or fs.exists(below):  # where the name is taken, a rename moves the folder below it or fails
            fs.delete(below, True)
            fs.delete(own, True)
            raise RuntimeError("another writer changed the store; nothing was changed here")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last versions, and rows that no kept one has. No reader of older ones and no writer may be at work."""
        known = self.versions()
        for number in known[: -max(1, keep)]:
            remove(self.spark, f"{self.folder}/version-{number}")
        used = {f"write={w}" for number in known[-max(1, keep) :] for w in self.at(number).manifest().writes.values()}
        for kind in ("rows", "terms"):
            for name in set(self._names(f"{kind}/write=*")) - used:
                remove(self.spark, f"{self.folder}/{kind}/{name}")
        files = {self.at(number).manifest().files for number in known[-max(1, keep) :]}
        for name in {*self._names("next-*"), *self._names("files-*")} - files:
            remove(self.spark, f"{self.folder}/{name}")

    # --- rows

    def _read(self, state: Manifest, buckets: Iterable[int] | None = None) -> DataFrame:
        """The stored rows of some buckets, or of all."""
        columns = "".join(f", p{i} {VALUE}" for i in range(len(state.keys or ())))
        schema = f"{ROW}{columns}, rest string, write string, bucket int"
        asked = state.writes.keys() if buckets is None else set(buckets) & state.writes.keys()
        paths = [f"{self.folder}/rows/write={state.writes[b]}/bucket={b}" for b in sorted(asked)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/rows").parquet(*paths)

    @staticmethod
    def _props(state: Manifest) -> Column:
        promoted = [F.struct(F.lit(key).alias("key"), F.col(f"p{i}").alias("value")) for i, key in enumerate(state.keys or ())]
        rest = F.coalesce(F.from_json("rest", PROPS), F.create_map().cast(PROPS))
        if not promoted:
            return rest
        return F.map_concat(F.map_from_entries(F.filter(F.array(*promoted), lambda e: e["value"]["kind"].isNotNull())), rest)

    @staticmethod
    def _value(state: Manifest) -> Callable[[str], Column]:
        """Where a property's value is: its column, or the JSON of the others, of which only that key is read."""
        at = {key: f"p{i}" for i, key in enumerate(state.keys or ())}
        return lambda key: F.col(at[key]) if key in at else F.from_json("rest", PROPS)[key]

    def _rows(self, notes: DataFrame, state: Manifest) -> DataFrame:
        """Notes as rows, without promoted columns yet. Of repeated paths, the properties that come first as text stand."""
        now, n = F.current_timestamp(), state.n_buckets
        modified = F.col("modified") if "modified" in notes.columns else F.lit(None).cast("timestamp").alias("modified")
        own = notes.where("path is not null").select("path", F.map_filter("props", lambda k, v: v["kind"].isNotNull()).cast(PROPS).alias("props"), modified)
        one = own.groupBy("path").agg(F.min(F.struct(F.to_json("props").alias("json"), "modified")).alias("x"))
        return one.select(F.md5(F.col("path").cast("binary")).alias("id"), "path", now.alias("created_at"), now.alias("updated_at"), "x.modified", F.from_json("x.json", PROPS).alias("props"), _bucket(F.col("path"), n).alias("bucket"))

    def _frequent(self, rows: DataFrame) -> list[str]:
        """The properties that enough rows have, the most frequent first; at most ``most_columns``."""
        found = rows.select(F.explode(F.map_keys("props")).alias("key")).groupBy("key").count()
        least = self.least_share * rows.count()
        return [r["key"] for r in found.where(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(self.most_columns).collect()]

    @staticmethod
    def _shredded(rows: DataFrame, keys: list[str]) -> DataFrame:
        promoted = [F.col("props")[key].alias(f"p{i}") for i, key in enumerate(keys)]
        rest = F.map_filter("props", lambda k, v: ~k.isin(keys)) if keys else F.col("props")
        return rows.select("id", "path", "created_at", "updated_at", "modified", *promoted, F.to_json(rest).alias("rest"), "bucket")

    def _put(self, state: Manifest, put: DataFrame, gone: DataFrame | None = None, touched: set[int] | None = None) -> None:
        """The next version: ``put`` replaces or adds rows by path, ``gone`` (path, bucket) removes some."""
        if state.keys is None:
            state = replace(state, keys=self._frequent(put))
        new = self._shredded(put, state.keys)
        if touched is None:
            touched = {r["bucket"] for r in put.select("bucket").union(gone.select("bucket") if gone is not None else put.select("bucket").limit(0)).distinct().collect()}  # n_buckets rows at most
        old = self._read(state, touched).drop("write")
        # A row that stays known keeps the time of its creation.
        new = new.join(old.select("path", F.col("created_at").alias("__was")), "path", "left").withColumn("created_at", F.coalesce("__was", "created_at")).select(*old.columns)
        leaving = put.select("path") if gone is None else put.select("path").union(gone.select("path"))
        self._publish(state, touched, old.join(leaving, "path", "left_anti").unionByName(new))

    def _publish(self, state: Manifest, touched: set[int], rows: DataFrame) -> None:
        write = uuid.uuid4().hex
        rows.repartition("bucket").sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(f"{self.folder}/rows/write={write}")
        names = {int(x.split("=")[1]): write for x in self._names(f"rows/write={write}/bucket=*")}
        made = replace(state, number=state.number + 1, writes={b: w for b, w in state.writes.items() if b not in touched} | names)
        written = self._read(made, names)
        self._index(made, written).write.partitionBy("slot").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.folder}/terms/write={write}")
        seen = written.agg(*[F.collect_set(F.col(f"p{i}")["kind"]).alias(f"p{i}") for i in range(len(made.keys))] or [F.lit(0)]).first()
        kinds = {key: sorted({*state.kinds.get(key, ()), *seen[f"p{i}"]}) for i, key in enumerate(made.keys)}
        self._commit(replace(made, kinds=kinds))

    def _index(self, state: Manifest, rows: DataFrame) -> DataFrame:
        value = self._value(state)
        named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("term"))
        terms = [F.transform(F.array_distinct(as_list(key, value)), named(kind)) for kind, key in INDEXED.items()]
        found = rows.select("bucket", F.explode(F.concat(*terms)).alias("t")).where("t.term is not null")
        counted = found.groupBy("t.kind", "t.term", "bucket").agg(F.count("*").alias("n"))
        return counted.select("kind", "term", "n", "bucket", self._slot(F.col("kind"), F.col("term"), state).alias("slot")).repartition("slot").sortWithinPartitions("slot", "kind", "term", "bucket")

    @staticmethod
    def _slot(kind: Column, term: Column, state: Manifest) -> Column:
        return (F.crc32(F.concat(kind, F.lit(":"), term).cast("binary")) % state.n_slots).cast("int")

    # --- changes

    def save(self, notes: DataFrame) -> DataFrame:
        """Insert notes whose path is new, and return those; known paths are left as they are."""
        state = self.manifest()
        rows = materialize(self._rows(notes, state))
        asked = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # n_buckets rows at most
        new = materialize(rows.join(self._read(state, asked).select("path"), "path", "left_anti").select(*rows.columns))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        if touched:
            self._put(state, new, touched=touched)
        saved = new.select("id", "path", "created_at", "updated_at", F.to_json("props").alias("properties_json"))
        discard(rows)
        return saved

    def update(self, notes: DataFrame) -> None:
        """Replace properties; raises if a path is unknown."""
        state = self.manifest()
        rows = materialize(self._rows(notes, state))
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        unknown = not rows.join(self._read(state, touched).select("path"), "path", "left_anti").isEmpty()
        if not unknown and touched:
            self._put(state, rows, touched=touched)
        discard(rows)
        if unknown:
            raise KeyError("a note to update is not stored")

    def apply(self, put: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None, listing: DataFrame | None = None) -> bool:
        """Insert or replace ``put``, remove the paths of ``gone``; in one version.

        A ``batch`` (stream, number) is applied once: its number goes into the version, and one that
        is not above the last is passed over. A ``listing`` (path, length, modified) becomes the
        version's. Returns whether the changes were applied.
        """
        state = self.manifest()
        if batch:
            if state.batches.get(batch[0], -1) >= batch[1]:
                return False
            state = replace(state, batches=state.batches | {batch[0]: batch[1]})
        if listing is not None:
            state = replace(state, files=f"files-{uuid.uuid4().hex}")
            listing.select("path", "length", "modified").write.parquet(f"{self.folder}/{state.files}")
        rows = materialize(self._rows(put, state))
        left = None if gone is None else materialize(gone.select("path", _bucket(F.col("path"), state.n_buckets).alias("bucket")).where("path is not null").distinct().join(rows.select("path"), "path", "left_anti"))
        self._put(state, rows, left)
        discard(rows, *([left] if left is not None else []))
        return True

    def compact(self) -> None:
        """Write all buckets anew, with the columns that are frequent now."""
        state = self.manifest()
        rows = materialize(self._read(state).select("id", "path", "created_at", "updated_at", "modified", self._props(state).alias("props"), "bucket"))
        keys = self._frequent(rows)
        self._publish(replace(state, keys=keys, kinds={}), set(state.writes), self._shredded(rows, keys))
        discard(rows)

    # --- reading

    def _stored(self, state: Manifest, rows: DataFrame) -> DataFrame:
        return rows.select("id", "path", "created_at", "updated_at", F.to_json(self._props(state)).alias("properties_json"))

    def find_all(self) -> DataFrame:
        state = self.manifest()
        return self._stored(state, self._read(state))

    def find_by_path(self, path: str) -> DataFrame:
        state = self.manifest()
        return self._stored(state, self._read(state, [bucket_of(path, state.n_buckets)]).where(F.col("path") == path))

    def find_by_id(self, note_id: str) -> DataFrame:
        state = self.manifest()
        bucket = [int(note_id[:7], 16) % state.n_buckets] if all(c in "0123456789abcdef" for c in note_id[:7].ljust(1, "x")) else []
        return self._stored(state, self._read(state, bucket).where(F.col("id") == note_id))

    def listing(self) -> DataFrame:
        """(path, length, modified) of the files that the store was last brought to."""
        state, schema = self.manifest(), "path string, length long, modified timestamp"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{state.files}") if state.files else self.spark.createDataFrame([], schema)

    def modified(self) -> DataFrame:
        """(path, modified): when the file of each note was last changed, where that is known."""
        return self._read(self.manifest()).select("path", "modified")

    def notes(self) -> DataFrame:
        """Stored notes in the note model."""
        state = self.manifest()
        return self._read(state).select("path", self._props(state).alias("props"))

    def terms(self, state: Manifest | None = None) -> DataFrame:
        """The index: (kind, term, n, slot, bucket) of the buckets as they are now."""
        state = state or self.manifest()
        paths = [f"{self.folder}/terms/write={w}" for w in sorted(set(state.writes.values()))]
        if not paths:
            return self.spark.createDataFrame([], TERMS).drop("write")
        live = self.spark.createDataFrame([(w, b) for b, w in state.writes.items()], "write string, bucket int")  # n_buckets rows
        found = self.spark.read.schema(TERMS).option("basePath", f"{self.folder}/terms").parquet(*paths)
        return found.join(F.broadcast(live), ["write", "bucket"], "left_semi").select("kind", "term", "n", "slot", "bucket")

    def buckets_with(self, kind: str, term: str, state: Manifest | None = None) -> set[int]:
        """The buckets that hold notes with the tag or link target."""
        state = state or self.manifest()
        slot = self._slot(F.lit(kind), F.lit(term), state)
        at = self.terms(state).where((F.col("slot") == slot) & (F.col("kind") == kind) & (F.col("term") == term))
        return {r["bucket"] for r in at.select("bucket").collect()}  # n_buckets rows at most

    def counts(self, kind: str) -> DataFrame:
        """(term, n): how many notes hold each tag or link target; read from the index alone."""
        return self.terms().where(F.col("kind") == kind).groupBy("term").agg(F.sum("n").alias("n"))

    def _where(self, state: Manifest, buckets: Iterable[int] | None, condition: Column) -> DataFrame:
        return self._read(state, buckets).where(condition).select("path", self._props(state).alias("props"))

    def find_by_tag(self, tag: str) -> DataFrame:
        """Notes whose tag list holds the tag, or whose only tag it is."""
        state = self.manifest()
        v = self._value(state)("tags")
        held = is_kind(v, "list", "list", F.coalesce(F.array_contains(v["list"], tag), F.lit(False))) | is_kind(v, "string", "str", v["str"] == tag)
        return self._where(state, self.buckets_with("tag", tag, state), held)

    def find_backlinks(self, path: str) -> DataFrame:
        """Notes that link to a path."""
        state = self.manifest()
        return self._where(state, self.buckets_with("link", path, state), F.coalesce(F.array_contains(self._value(state)("links")["list"], path), F.lit(False)))

    def outgoing(self, path: str) -> DataFrame:
        """The stored notes that one note links to."""
        state = self.manifest()
        own = self._read(state, [bucket_of(path, state.n_buckets)]).where(F.col("path") == path)
        targets = own.select(F.explode(as_list("links", self._value(state))).alias("path")).distinct()
        asked = {r["b"] for r in targets.select(_bucket(F.col("path"), state.n_buckets).alias("b")).distinct().collect()}  # n_buckets rows at most
        return self._read(state, asked).select("path", self._props(state).alias("props")).join(targets, "path", "left_semi")

    def search(self, include: dict[str, str] | str | None = None, exclude: dict[str, str] | None = None, **options) -> DataFrame:
        """Stored notes that match all included pairs (or a query string) and none of the excluded, as queries match them.

        Tests of promoted properties are conditions on their columns, which reach the Parquet scan;
        a whole tag or link that must be there leaves only the buckets that the index names.
        """
        state = self.manifest()
        tests = parse(include) if isinstance(include, str) else {k: [v] for k, v in (include or {}).items()}
        tests = tests | {f"!{k}": [*tests.get(f"!{k}", []), v] for k, v in (exclude or {}).items()}
        buckets = None
        for kind, key in INDEXED.items():
            if set(state.kinds.get(key, ["int"])) <= {"list", "string", "null", "other"}:  # else a value may match what is no term
                for value in tests.get(key, []):
                    if value and value[0] not in "*<>" and value[-1] != "*":
                        found = self.buckets_with(kind, value, state)
                        buckets = found if buckets is None else buckets & found
        return self._where(state, buckets, predicate(tests, props=self._value(state), kinds=state.kinds, **options))
