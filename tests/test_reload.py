import errno
import os

from pyspark.sql import functions as F

from quillspark.operators import export
from quillspark.operators.store import NoteStore
from quillspark.schema import prop
from quillspark.sources.vault import _entries, hidden_files, list_files, read_vault, sync
from quillspark.streaming.ingest import file_stream, merge_files, upsert_notes


def put(folder, files, at=None):
    for name, raw in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(raw)
        if at:
            os.utime(folder / name, (at, at))


def note(title):
    return f"---\ntitle: {title}\ntags: [t]\n---\n[x](a.md)\n"


def titles(store):
    return {r["path"]: r["t"] for r in store.notes().select("path", prop("title")["str"].alias("t")).collect()}


def test_listing_of_nested_and_hidden_folders(spark, tmp_path):
    names = ["a.md", ".h.md", "d/.e/f.md", "_x/y/z/.w.md", "d/e/f/g/deep.txt", "d/e.f/ü ñ.md"]
    put(tmp_path, {n: note(n) for n in names})
    (tmp_path / "empty" / "folder").mkdir(parents=True)
    found = {r["path"]: r["length"] for r in list_files(spark, str(tmp_path)).collect()}
    assert found == {n: len(note(n).encode()) for n in names}
    assert sorted(r["path"] for r in list_files(spark, str(tmp_path), hidden=False).collect()) == sorted(n for n in names if not any(x[0] in "._" for x in n.split("/")))
    assert sorted(r["path"] for r in hidden_files(spark, str(tmp_path)).collect()) == [".h.md", "_x/y/z/.w.md", "d/.e/f.md"]
    assert list_files(spark, str(tmp_path / "none")).collect() == []


def test_reload_reads_what_changed(spark, tmp_path):
    folder, store = tmp_path / "vault", NoteStore(spark, f"{tmp_path}/s", buckets=4)
    put(folder, {"a.md": note("one"), "d/b.md": note("two"), "c.md": note("three"), "p.png": "x", "bare.md": "no front matter"}, at=1_000_000)
    store.init()
    moved = lambda: {r["path"]: r["what"] for r in sync(store, str(folder)).collect()}
    assert moved() == dict.fromkeys(["a.md", "d/b.md", "c.md", "p.png", "bare.md"], "new")
    first = {r["path"]: r["props"] for r in store.notes().collect()}
    assert first == {r["path"]: r["props"] for r in read_vault(spark, str(folder)).collect()} and sorted(first) == ["a.md", "c.md", "d/b.md", "p.png"]
    assert moved() == {}  # nothing is read again, what is no note included
    put(folder, {"a.md": note("ONE")}, at=2_000_000)  # of the same length
    put(folder, {"new.md": note("four")})
    (folder / "d/b.md").rename(folder / "renamed.md")
    put(folder, {"c.md": "no note any more"})
    assert moved() == {"a.md": "changed", "new.md": "new", "d/b.md": "gone", "renamed.md": "new", "c.md": "changed"}
    assert titles(store) == {"a.md": "ONE", "new.md": "four", "renamed.md": "two", "p.png": None}
    for f in folder.rglob("*"):
        if f.is_file():
            f.unlink()
    assert set(moved().values()) == {"gone"} and titles(store) == {}
    store.vacuum(1)
    assert moved() == {} and len(list((tmp_path / "s").glob("files-*"))) == 1


def test_a_stream_replaces_notes(spark, tmp_path):
    folder, store = tmp_path / "in", NoteStore(spark, f"{tmp_path}/s", buckets=2)
    folder.mkdir()
    store.init()
    run = lambda: upsert_notes(spark, str(folder), store, f"{tmp_path}/c", deliveries=True).awaitTermination(120)
    put(folder, {"1/a.md": note("one"), "1/b.md": note("two")}, at=1_000_000)
    put(folder, {"0/a.md": note("older")}, at=900_000)
    run()
    assert titles(store) == {"a.md": "one", "b.md": "two"}
    put(folder, {"2/a.md": note("newer"), "2/b.md": "no note any more"}, at=2_000_000)
    put(folder, {"3/c.md": note("three")}, at=2_000_000)
    run()
    assert titles(store) == {"a.md": "newer", "c.md": "three"}
    put(folder, {"4/a.md": note("late but old")}, at=1_500_000)
    run()
    assert titles(store) == {"a.md": "newer", "c.md": "three"}
    versions = store.versions()
    # The last batch again, as after a failure between the merge and the stream's own record.
    files = spark.createDataFrame([("a.md", note("again"))], "path string, raw string").withColumn("modified", F.current_timestamp())
    last = store.manifest().batches["vault"]
    assert not merge_files(files, store, ("vault", last)) and store.versions() == versions
    assert merge_files(files, store, ("vault", last + 1)) and titles(store)["a.md"] == "again"
    assert file_stream(spark, str(folder)).isStreaming


def test_an_exports_work_done_twice(spark, tmp_path):
    vault, out = tmp_path / "v", tmp_path / "o"
    put(vault, {"p.png": "image", "q.png": "other"})
    put(out, {"q.png": "was here"})
    rows = [("a.md", "write", "d/a.md", "text", False), ("p.png", "copy", "p.png", None, False), ("q.png", "copy", "q.png", None, True), ("none.png", "copy", "none.png", None, False), ("p.png", "copy", "../p.png", None, False)]
    once = export.carry_out(rows, str(vault), str(out))
    assert once == ["written", "copied", "kept", "missing", "outside"] == export.carry_out(rows, str(vault), str(out))
    assert {str(f.relative_to(out)): f.read_text() for f in out.rglob("*") if f.is_file()} == {"d/a.md": "text", "p.png": "image", "q.png": "was here"}


def test_an_export_keeps_what_was_there(spark, tmp_path):
    vault, out = tmp_path / "v", tmp_path / "o"
    put(vault, {"a.md": note("A"), "b.md": note("B"), "x.md": note("X")})
    put(out, {"b.md": "mine"})
    done = export.export(read_vault(spark, str(vault)), str(vault), str(out), kind="copy")
    want = {"a.md": "copied", "b.md": "kept", "x.md": "copied"}
    assert {r["path"]: r["done"] for r in done.collect()} == want == {r["path"]: r["done"] for r in done.collect()}
    assert (out / "b.md").read_text() == "mine" and (out / "a.md").read_text() == note("A")


def test_a_folder_is_not_looked_at_for_each_file_put_there(tmp_path, monkeypatch):
    vault, out = tmp_path / "v", tmp_path / "o"
    put(vault, {f"d/{i}.png": f"image {i}" for i in range(20)})
    rows = [(f"d/{i}.md", "write", f"d/{i}.md", f"text {i}", False) for i in range(20)] + [(f"d/{i}.png", "copy", f"d/{i}.png", None, False) for i in range(20)]
    looked, made = [], []
    for name, calls in (("lstat", looked), ("replace", looked), ("rename", looked), ("mkdir", made)):
        known = getattr(os, name)
        monkeypatch.setattr(os, name, lambda path, *a, known=known, calls=calls, **k: calls.append(os.fspath(path)) or known(path, *a, **k))
    assert export.carry_out(rows, str(vault), str(out)) == ["written"] * 20 + ["copied"] * 20
    assert not [p for p in looked if p.startswith(f"{out}/d/")] and len(made) <= 4
    monkeypatch.undo()
    assert {str(f.relative_to(out)): f.read_text() for f in out.rglob("*") if f.is_file()} == {r[0]: r[3] or (vault / r[0]).read_text() for r in rows}
    assert sorted(x.name for x in out.iterdir()) == ["d"]


def test_places_that_are_taken_or_know_no_links(tmp_path, monkeypatch):
    vault, out, far = tmp_path / "v", tmp_path / "o", tmp_path / "far"
    put(vault, {"p.png": "image"})
    put(out, {"old.md": "old", "in.md": "inner"})
    put(far, {"x.md": "far"})
    for name, to in (("to_in.md", out / "in.md"), ("to_far.md", far / "x.md"), ("to_none.png", far / "none.png"), ("dir", far)):
        (out / name).symlink_to(to)
    rows = [(n, "write", n, f"new {n}", False) for n in ("old.md", "to_in.md", "to_far.md", "dir/y.md", "free.md")]
    rows += [("p.png", "copy", "to_none.png", None, False), ("p.png", "copy", "to_far.md", None, True), ("none.png", "copy", "to_far.md", None, False), ("p.png", "copy", "free.png", None, False)]
    want = ["written", "written", "outside", "outside", "written", "outside", "outside", "outside", "copied"]

    def check():
        assert export.carry_out(rows, str(vault), str(out)) == want
        assert [(out / n).read_text() for n in ("old.md", "to_in.md", "in.md", "free.md", "free.png")] == ["new old.md", "new to_in.md", "inner", "new free.md", "image"]
        assert [f.name for f in far.iterdir()] == ["x.md"] and (far / "x.md").read_text() == "far" and not list(out.rglob("*.part"))

    check()

    def no_link(*_):
        raise OSError(errno.EPERM, "no links here")

    def one_folder(source, target, known=os.replace):
        if os.path.dirname(source) != os.path.dirname(target):
            raise OSError(errno.EXDEV, "another file system")
        known(source, target)

    monkeypatch.setattr(os, "link", no_link)
    check()
    monkeypatch.setattr(os, "replace", one_folder)
    check()


def test_what_is_no_file_is_left_out_of_a_listing(spark, tmp_path):
    put(tmp_path, {"a.md": "text", ".h/b.md": "x", "d/c.txt": "long text"}, at=1_000_000)
    os.mkfifo(tmp_path / "pipe")
    for name, to in (("l.md", "a.md"), ("ld", "d"), ("none.md", "nowhere"), ("loop", "loop"), ("through", "a.md/x")):
        (tmp_path / name).symlink_to(to)
    found = lambda hidden: sorted((os.path.basename(p), folder) for p, _, _, folder in _entries(str(tmp_path), hidden))
    assert found(False) == [("a.md", False), ("d", True), ("l.md", False), ("ld", True)] and found(True) == [(".h", True), *found(False)]
    assert list(_entries(f"{tmp_path}/none", True)) == list(_entries(f"{tmp_path}/a.md", True)) == []
    listed = {r["path"]: (r["length"], r["at"]) for r in list_files(spark, str(tmp_path)).withColumn("at", F.unix_timestamp("modified")).collect()}
    assert listed == {"a.md": (4, 1_000_000), "l.md": (4, 1_000_000), ".h/b.md": (1, 1_000_000), "d/c.txt": (9, 1_000_000), "ld/c.txt": (9, 1_000_000)}
