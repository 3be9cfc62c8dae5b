"""The listing data source: what it enters, pushes and deals out; what a refresh opens."""

import os

from pyspark.sql import functions as F

from docquarry.engine import Engine
from docquarry.sources import files, listing


def tree(root, n=3):
    for d in ("", "sub", "sub/deep/er", ".git", "Node_Modules/x", "sub/own"):
        for k in range(n):
            p = root / d / f"f{k}.{'MD' if k else 'txt'}"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("x" * (10 * k))
    (root / "README").write_text("no extension")
    (root / ".profile").write_text("hidden file")


def test_listing(spark, tmp_path):
    tree(tmp_path)
    rows = listing.listing(spark, str(tmp_path), ("node_modules", "OWN")).collect()
    assert {r["path"] for r in rows} == {f"file:{p}" for p in tmp_path.rglob("*") if p.is_file() and not {".git", "Node_Modules", "own"} & set(p.parts)}
    by = {r["path"].removeprefix(f"file:{tmp_path}/"): r for r in rows}
    one = by["sub/deep/er/f2.MD"]
    assert (one["file_name"], one["ext"], one["size"], one["modified_at"]) == ("f2.MD", "md", 20, int(os.stat(tmp_path / "sub/deep/er/f2.MD").st_mtime))
    assert by["README"]["ext"] == "" == by[".profile"]["ext"]
    assert listing.listing(spark, f"file://{tmp_path}/nowhere").collect() == []


def test_filters_are_taken_over(spark, tmp_path):
    tree(tmp_path)
    df = files.found(spark, str(tmp_path), exclude_exts=("txt",)).filter((F.col("size") > 10) & F.col("file_name").contains("2"))
    assert {r["size"] for r in df.collect()} == {20} and df.count() == 4
    reader = listing.ListingReader(str(tmp_path), ["node_modules"])
    left = list(reader.pushFilters([listing.In(("ext",), ("md",)), listing.GreaterThan(("size",), 10), listing.EqualTo(("path",), "x")]))
    assert [type(f) for f in left] == [listing.EqualTo]
    assert {r for p in reader.partitions() for b in reader.read(p) for r in b.column("size").to_pylist()} == {20}


def test_wide_trees_are_dealt_out(spark, tmp_path):
    for k in range(90):
        (tmp_path / f"d{k}" / "in").mkdir(parents=True)
        (tmp_path / f"d{k}" / "in" / "a.md").write_text("x")
    df = files.found(spark, str(tmp_path))
    assert df.count() == 90 and df.rdd.getNumPartitions() >= listing.FOLDERS


def test_read_files(spark, tmp_path):
    tree(tmp_path)
    paths = spark.createDataFrame([(f"file:{tmp_path}/sub/f2.MD",), (f"{tmp_path}/sub/f0.txt",), (f"file:{tmp_path}/gone.md",)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in listing.read_files(paths).collect()}
    assert got == {"f2.MD": b"x" * 20, "f0.txt": b""}


def test_a_refresh_opens_what_changed(spark, tmp_path):
    """Size and time decide; a thorough one compares hashes as well."""
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("first words")
    (folder / "b.txt").write_text("other words")
    e = Engine(spark, f"file://{tmp_path}/store", dimension=8, buckets=2)
    assert e.refresh(str(folder)) == {"insert": 2}
    before = os.stat(folder / "a.txt")
    (folder / "a.txt").write_text("FIRST words")
    os.utime(folder / "a.txt", ns=(before.st_atime_ns, before.st_mtime_ns))
    assert e.refresh(str(folder)) == {"skip": 2}
    assert e.refresh(str(folder), thorough=True) == {"update": 1, "skip": 1}
    assert sorted(r["snippet"] for r in e.table("chunks").collect()) == ["FIRST words", "other words"]
