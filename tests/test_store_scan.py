"""Roots in a store that only Hadoop's file systems reach."""

import pytest

from florilege.api import Engine
from florilege.schema import ChunkOptions
from florilege.sources.files import read_store_files

FILES = {
    "z.md": b"visible", "pkg/__init__.py": b"import os", "pkg/_index.md": b"# Index of the greenhouse", ".dot.txt": b"\xff\x00dot", "a b%20.md": b"blank", "empty.txt": b"",
    "pkg/.hid/deep/x.txt": b"below a dot", "pkg/.hid/.more/_y.txt": b"twice", "_part=1/w.txt": b"partition", "_part=1/.v.txt": b"in it", ".br[a]ce/u.txt": b"pattern", "_skip/t.bin": b"\x00\x01",
}


@pytest.fixture
def store(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_bytes(content)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.scan.link./in", f"file://{tmp_path}")
    yield "viewfs://scan/in"
    spark._jsc.hadoopConfiguration().unset("fs.viewfs.mounttable.scan.link./in")


def read(spark, root):
    rows = read_store_files(spark, root).collect()
    got = {r.path.partition("/docs/")[2]: bytes(r.content) for r in rows}
    assert len(got) == len(rows)
    return got


def test_all_names_of_a_store_are_read(spark, store, tmp_path):
    assert read(spark, f"{store}/docs") == FILES
    assert read(spark, f"file://{tmp_path}/docs/") == FILES
    assert read(spark, f"{store}/docs/pkg/_index.md") == {"pkg/_index.md": FILES["pkg/_index.md"]}
    assert read(spark, f"{store}/docs/pkg/.hid").keys() == {"pkg/.hid/deep/x.txt", "pkg/.hid/.more/_y.txt"}
    assert read(spark, f"{store}/docs/*.md").keys() == {"z.md", "a b%20.md"}
    with pytest.raises(FileNotFoundError):
        read_store_files(spark, f"{store}/none")


def test_engine_indexes_all_names_of_a_store(spark, store, tmp_path):
    engine = Engine(spark, str(tmp_path / "base"), ChunkOptions(100, 10))
    assert engine.index(f"{store}/docs", "c").counts() == {"added": 11, "updated": 0, "unchanged": 0, "skipped": 1, "error": 0, "removed": 0}
    assert engine.index(f"{store}/docs", "c").counts()["unchanged"] == 11
