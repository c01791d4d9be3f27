import os
import shutil
import time
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from florilege.api import Engine
from florilege.cli import main
from florilege.schema import ChunkOptions
from florilege.sources import pdf
from florilege.sources.files import parse, scan_folder
from florilege.sources.store import CollectionStore, CorruptCollection, collection_id, import_json


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "policy.md").write_text("# Travel policy\n\nTrips must be approved by a manager before they are booked.")
    (root / "notes.txt").write_text("The quarterly numbers are due on Friday, says the finance team.")
    (root / "ignored.png").write_bytes(b"\x89PNG")
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "base"), ChunkOptions(100, 10))


def test_index_ask_and_reindex(engine, folder):
    first = engine.index(str(folder), "c")
    assert first.counts() == {"added": 2, "updated": 0, "unchanged": 0, "skipped": 1, "error": 0, "removed": 0}
    again = engine.index(str(folder), "c")
    assert again.counts()["unchanged"] == 2 and again.counts()["added"] == 0
    row = engine.ask("Who approves trips before they are booked?", "c", 3).first()
    assert row.answerable and row.citations[0].document_path.endswith("policy.md") and row.backend == "extractive-local"
    listed = engine.list_collections().first()
    assert (listed.name, listed.doc_count, listed.chunk_count, listed.root_path) == ("c", 2, 2, str(folder))
    assert "**Sources:**" in engine.export_session(engine.ask("Who approves trips before they are booked?", "c"), "c")


def test_edit_and_delete(engine, folder):
    (folder / "notes.txt").write_text("The launch code is ALPHA.")
    engine.index(str(folder), "c")
    (folder / "notes.txt").write_text("The launch code is BRAVO.")
    assert engine.index(str(folder), "c").counts()["updated"] == 1
    texts = " ".join(r.text for r in engine.load("c").chunks.collect())
    assert "BRAVO" in texts and "ALPHA" not in texts
    os.remove(folder / "notes.txt")
    assert engine.index(str(folder), "c").counts()["removed"] == 1
    assert engine.load("c").documents.count() == 1


def test_other_root_prunes_all_or_only_its_own(engine, folder, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.txt").write_text("something else entirely")
    engine.index(str(folder), "c")
    assert engine.index(str(other), "c", prune_root_only=True).counts()["removed"] == 0
    assert engine.load("c").documents.count() == 3
    assert engine.index(str(other), "c").counts()["removed"] == 2
    assert engine.list_collections().first().root_path == str(folder)


def test_unreadable_file_is_reported_and_pruned(spark, engine, folder):
    from florilege.operators.ingest import ingest

    engine.index(str(folder), "c")
    path = str(folder / "notes.txt")
    files = spark.createDataFrame([(path, None, "gone")], "path string, content binary, error string")
    result = ingest(engine.load("c"), files, ChunkOptions(100, 10))
    assert result.counts()["error"] == 1 and result.counts()["removed"] == 2


def test_failed_parse_keeps_the_old_version(spark, engine, folder, monkeypatch):
    from florilege.operators import ingest as module

    engine.index(str(folder), "c")
    parse_text = module.parse_text
    monkeypatch.setattr(module, "parse_text", lambda files: parse_text(files).withColumns({"text": F.lit(None).cast("string"), "error": F.lit("bad")}))
    files = spark.createDataFrame([(str(folder / "notes.txt"), bytearray(b"new"), None), (str(folder / "policy.md"), bytearray(b"new"), None)], "path string, content binary, error string")
    result = module.ingest(engine.load("c"), files, ChunkOptions(100, 10))
    assert result.counts()["error"] == 2 and result.collection.documents.count() == 2


def test_each_image_is_read_once(spark, tmp_path):
    class CountingOcr:
        """Notes each call in a folder, since it is called in workers (and so defined here); one image fails."""

        def __init__(self, folder):
            self.folder = folder

        def image_to_text(self, path):
            with open(path, "rb") as f:
                content = f.read()
            with open(f"{self.folder}/{uuid.uuid4().hex}", "wb") as f:
                f.write(content)
            if b"bad" in content:
                raise RuntimeError("blurred")
            return " text of " + content.decode() + " "

    root, calls = tmp_path / "images", tmp_path / "calls"
    root.mkdir()
    calls.mkdir()
    for name in ("one", "two", "bad"):
        (root / f"{name}.png").write_text(name)
    engine = Engine(spark, str(tmp_path / "base"), ocr=CountingOcr(str(calls)))
    first = engine.index(str(root), "c")
    assert first.counts() == {"added": 2, "updated": 0, "unchanged": 0, "skipped": 0, "error": 1, "removed": 0}
    assert len(list(calls.iterdir())) == 3
    assert [os.path.basename(r.path) for r in first.report.collect()] == ["bad.png", "one.png", "two.png"]
    (root / "two.png").write_text("three")
    (root / "one.png").unlink()
    assert engine.index(str(root), "c").counts() == {"added": 0, "updated": 1, "unchanged": 0, "skipped": 0, "error": 1, "removed": 1}
    assert len(list(calls.iterdir())) == 5  # the changed one, and the bad one again
    assert [r.text for r in engine.load("c").chunks.collect()] == ["text of three"]
    assert not [p for p in (tmp_path / "base").rglob("staging*")]


@pytest.mark.parametrize("most_gone", [200_000, 0])
def test_a_change_adds_a_segment(spark, tmp_path, monkeypatch, most_gone):
    from florilege.sources import store as module

    monkeypatch.setattr(module, "MOST_SEGMENTS", 4)
    monkeypatch.setattr(module, "MOST_GONE", most_gone)
    root = tmp_path / "docs"
    root.mkdir()
    engine, want = Engine(spark, str(tmp_path / "base")), {}
    at_work = tmp_path / "base" / collection_id("c") / "chunks" / "segment=s-of-another-writer"
    for step in range(6):
        for k in range(3):
            want[f"f{(step + k) % 5}.txt"] = f"text {step} of file {k}"
            (root / f"f{(step + k) % 5}.txt").write_text(want[f"f{(step + k) % 5}.txt"])
        if step == 3:
            (root / "f0.txt").unlink()
            del want["f0.txt"]
        engine.index(str(root), "c")
        at_work.mkdir(exist_ok=True, parents=True)
        found = engine.store.load(collection_id("c"))
        assert {os.path.basename(r.document_path): r.text for r in found.chunks.collect()} == want
        assert sorted(os.path.basename(r.path) for r in found.documents.collect()) == sorted(want)
    assert at_work.exists()
    live, covered = engine.store._in_force(collection_id("c"))
    assert len(live) <= 4 and len(live) + len(covered) <= 12
    changed = sorted((tmp_path / "base" / collection_id("c")).rglob("*"))
    assert engine.index(str(root), "c").counts()["unchanged"] == len(want)
    assert changed == sorted((tmp_path / "base" / collection_id("c")).rglob("*"))  # nothing was written


def test_scan(spark, folder):
    (folder / ".hidden").mkdir()
    (folder / ".hidden" / "_x.txt").write_text("x")
    (folder / "link").symlink_to(folder / ".hidden")
    names = {os.path.relpath(r.path, folder) for r in scan_folder(spark, str(folder)).collect()}
    assert {"policy.md", ".hidden/_x.txt"} <= names and "link/_x.txt" not in names
    assert scan_folder(spark, str(folder / "policy.md")).count() == 1
    with pytest.raises(FileNotFoundError):
        scan_folder(spark, str(folder / "none"))


def test_scan_of_many_folders(spark, tmp_path, monkeypatch):
    """Levels that are listed one by one, subtrees that are listed whole, and links, with times and lengths."""
    from florilege.sources import files

    want = {}
    for k in range(12):
        for name in (f"a{k}/f.txt", f"a{k}/b/c/d/{k}.txt", f"a{k}/b/.h/x y.txt", "top.txt"):
            path = tmp_path / "r" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(name * (k + 1))
            want[str(path)] = len(name) * (k + 1)
    (tmp_path / "r" / "empty").mkdir()
    (tmp_path / "r" / "a1" / "loop").symlink_to(tmp_path / "r")
    (tmp_path / "r" / "a2" / "nowhere").symlink_to(tmp_path / "none")
    (tmp_path / "r" / "a3" / "link.txt").symlink_to(tmp_path / "r" / "a4" / "f.txt")
    extra = {str(tmp_path / "r" / n) for n in ("a1/loop", "a2/nowhere")}
    want[str(tmp_path / "r" / "a3" / "link.txt")] = want[str(tmp_path / "r" / "a4" / "f.txt")]
    for levels in (0, 1, 4):
        monkeypatch.setattr(files, "LEVELS", levels)
        rows = scan_folder(spark, str(tmp_path / "r"), files_per_task=3).collect()
        assert {r.path for r in rows} == want.keys() | extra and len(rows) == len(want) + 2
        assert {r.path: r.length for r in rows if r.path in want} == want
        assert all(r.modified == os.lstat(r.path).st_mtime_ns // 1000 for r in rows if not os.path.islink(r.path))
    assert scan_folder(spark, str(tmp_path / "r" / "empty")).count() == 0
    assert [r.path for r in scan_folder(spark, str(tmp_path / "r" / "a1" / "loop")).collect()] == [str(tmp_path / "r" / "a1" / "loop")]


def test_a_folder_that_cannot_be_listed_fails_the_scan(spark, tmp_path, monkeypatch):
    (tmp_path / "r" / "gone").mkdir(parents=True)
    from florilege.sources import files

    folders = spark.createDataFrame([(str(tmp_path / "r" / "gone" / "none"),)], "path string")
    with pytest.raises(Exception, match="No such file"):
        files._listed(folders, True).collect()


def test_unchanged_files_are_not_opened(spark, engine, folder):
    """A file with another text but the old time and length would be found by its hash; it is not looked into."""
    for name in ("policy.md", "notes.txt"):
        os.utime(folder / name, (1_700_000_000, 1_700_000_000))
    (folder / "fresh.txt").write_text("of a clock that is ahead, so that its time proves nothing")
    os.utime(folder / "fresh.txt", (4_000_000_000, 4_000_000_000))
    engine.index(str(folder), "c")
    (folder / "notes.txt").write_text((folder / "notes.txt").read_text().upper())
    os.utime(folder / "notes.txt", (1_700_000_000, 1_700_000_000))
    assert engine.index(str(folder), "c").counts() == {"added": 0, "updated": 0, "unchanged": 3, "skipped": 1, "error": 0, "removed": 0}
    os.utime(folder / "notes.txt", (1_700_000_001, 1_700_000_001))
    os.utime(folder / "policy.md", (1_700_000_001, 1_700_000_001))  # opened, and found to be the same
    (folder / "fresh.txt").write_text((folder / "fresh.txt").read_text().upper())
    os.utime(folder / "fresh.txt", (4_000_000_000, 4_000_000_000))
    assert engine.index(str(folder), "c").counts() == {"added": 0, "updated": 2, "unchanged": 1, "skipped": 1, "error": 0, "removed": 0}


def test_store(spark, tmp_path, engine, folder):
    store = CollectionStore(spark, str(tmp_path / "none"))
    assert store.list() == [] and not store.exists("x")
    engine.index(str(folder), "c")
    cid = collection_id("c")
    assert engine.store.list() == [cid]
    shutil.rmtree(tmp_path / "base" / cid / "chunks")
    with pytest.raises(CorruptCollection):
        engine.store.load(cid)
    assert engine.list_collections().count() == 0
    with pytest.raises(FileNotFoundError):
        engine.ask("x", "unknown")


def test_json_import(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"collection": {"id": "i", "name": "n", "root_path": "r"}, "documents": {"d": {"id": "d", "path": "p", "hash": "h", "mime_type": "m"}}, "chunks": {"k": {"id": "k", "document_id": "d", "document_path": "p", "text": "a b a", "start_offset": 0, "end_offset": 5, "embedding": [1.0]}}}')
    c = import_json(spark, str(tmp_path / "c.json"))
    row = c.chunks.first()
    assert (c.name, row.dl, {t.term: t.tf for t in row.terms}) == ("n", 3, {"a": 2, "b": 1})
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(CorruptCollection):
        import_json(spark, str(tmp_path / "bad.json"))


def _pdf(*streams, deflate=False):
    out = b"%PDF-1.4\n"
    for s in streams:
        body = zlib.compress(s) if deflate else s
        out += b"1 0 obj\n<< /Length 9" + (b" /Filter /FlateDecode" if deflate else b"") + b" >>\nstream\n" + body + b"\nendstream\nendobj\n"
    return out


@pytest.mark.parametrize("deflate", [False, True])
def test_pdf(deflate):
    data = _pdf(rb"BT (Hello \(there\) \101) Tj ET", b"BT [(Wo) -20 (rld)] TJ (x) Tj ET", b"q 1 0 0 1 re", deflate=deflate)
    assert pdf.direct_text(data) == ("Hello (there) A\n\nx World", [17])


@pytest.mark.parametrize(("shown", "text"), [
    (rb"BT (see [1) Tj (more) Tj [(a)] TJ ET", "see [1 more a"),
    (rb"BT (see [1) Tj (more [2) Tj [(a) 3 (b)] TJ [(c)]TJ ET", "see [1 more [2 ab c"),
    (rb"[(a \] b)] TJ [(c \[ d)] TJ", "a ] b c [ d"),
    (rb"[(a) (b\\)] TJ", "ab\\"),
    (rb"[(x) \] TJ", "x"),
    (rb"[(x\\]) ] TJ", "x\\]"),
    (rb"[[(x)] TJ", "x"),
    (rb"[(x) ]TJ \n (y)Tj", "y x"),
])
def test_brackets_in_shown_strings(shown, text):
    assert pdf.shown_text(shown).decode() == text


def test_an_array_without_end_takes_no_long_time():
    began = time.time()
    assert pdf.shown_text(b"[(a" + b"\\" * 200_000) == b"" and pdf.shown_text(b"[" * 100_000 + b"(a)] TJ") == b"a"
    assert time.time() - began < 5


def test_recognition_by_a_program(tmp_path, monkeypatch, capsys, spark):
    assert main(["--ocr", "--base", str(tmp_path), "list"], spark) == (0 if pdf.Tesseract.available() else 1)
    program = tmp_path / "reads"
    program.write_text("#!/bin/sh\necho \"  read $1 as $4 \"\n")
    program.chmod(0o755)
    assert pdf.image_text(b"x", ".png", pdf.Tesseract("deu", str(program))).endswith(".png as deu")
    with pytest.raises(Exception, match="No such file"):
        pdf.Tesseract(program=str(tmp_path / "none")).image_to_text("a.png")


def test_pdf_details():
    assert pdf.unescape(rb"a\n\t\\\b\060") == b"a\n\t\\b0"
    assert pdf.direct_text(b"<< /FlateDecode >>\nstream\nnot zlib\nendstream") == ("", [])
    assert pdf.content_streams(_pdf(b"[(a)] TJ")) and not pdf.content_streams(_pdf(b"(a) Tj"))
    assert sorted(["p-10.png", "p-2.png"], key=pdf.page_order) == ["p-2.png", "p-10.png"]

    class Engine:
        def image_to_text(self, path):
            return "  scanned  "

    assert pdf.image_text(b"x", ".png", Engine()) == "scanned"
    assert pdf.pdf_text(_pdf(b"BT (short) Tj ET"), Engine())[0] in ("short", "scanned")


def test_parse_dispatch(spark):
    rows = [("a.md", bytearray(b"**x**"), "markdown"), ("b.go", bytearray(b"**x**\xff"), "code"), ("c.pdf", bytearray(_pdf(b"BT (y) Tj ET")), "pdf")]
    got = {r.path: r for r in parse(spark.createDataFrame(rows, "path string, content binary, parser string")).collect()}
    assert got["a.md"].text == "  x  " and got["b.go"].text == "**x**�" and (got["c.pdf"].text, got["c.pdf"].boundaries) == ("y", [])


def test_watch(engine, folder):
    query = engine.watch(str(folder), "w", 0.5)
    try:
        (folder / "late.txt").write_text("a file that came late")
        for _ in range(60):
            time.sleep(0.5)
            if engine.store.load(collection_id("w")).documents.count() == 3:
                break
        assert engine.store.load(collection_id("w")).documents.count() == 3
    finally:
        query.stop()


def test_command_line(spark, tmp_path, folder, capsys):
    base = ["--base", str(tmp_path / "cli")]
    assert main([*base, "list"], spark) == 0 and "No collections yet" in capsys.readouterr().out
    assert main([*base, "ask", "x", "--collection", "c"], spark) == 1
    assert main([*base, "index", "--collection", "c", str(folder)], spark) == 0
    assert "added: 2" in capsys.readouterr().out
    assert main([*base, "ask", "Who approves trips before they are booked?", "--collection", "c", "--export", str(tmp_path / "s.md")], spark) == 0
    assert "Sources:" in capsys.readouterr().out and (tmp_path / "s.md").read_text().startswith("# Session — c")
    assert main([*base, "ask", "Who approves trips?", "--collection", "c", "--json"], spark) == 0
    assert capsys.readouterr().out.startswith('{"text":')
