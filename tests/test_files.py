"""Folders of files as a data source: packing, empty files, names, decoding, retries."""

import os

import pytest

from contentmark.sources import files as FS
from contentmark.sources import gold as G
from contentmark.sources import pages as P


def test_pack_bounds_every_run():
    mb = 1 << 20
    assert FS.pack([], 10 * mb) == []
    assert FS.pack([0] * 25, 10 * mb) == [0, 10, 20]
    assert FS.pack([50 * mb, 1, 1, 50 * mb, 9 * mb, 0], 10 * mb) == [0, 1, 3, 4, 5]


def test_folder_keeps_empty_files_and_leaves_hidden_ones(spark, tmp_path):
    d = tmp_path / "html"
    (d / "below").mkdir(parents=True)
    (d / "below" / "x.html").write_text("not listed")
    (d / "a b.html").write_text("<p>é</p>")
    for name in ("empty.html", "_SUCCESS", ".a.crc"):
        (d / name).write_bytes(b"")
    (d / "old.html").write_bytes("<p>“x”</p>".encode("cp1252"))
    want = {"a b.html": "<p>é</p>", "empty.html": "", "old.html": "<p>“x”</p>"}
    for path in (str(d), f"file:{d}", f"file://{d}"):
        assert {r["filename"]: r["html"] for r in P.read_pages(spark, path).collect()} == want
    raw = FS.read_files(spark, str(d), html=False, room=1).collect()
    assert {r["filename"]: bytes(r["content"]) for r in raw}["old.html"] == "<p>“x”</p>".encode("cp1252")
    assert FS.read_files(spark, str(d), room=1).rdd.getNumPartitions() == 3
    (tmp_path / "none").mkdir()
    assert P.read_pages(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="(?i)no such file|not exist|not found"):
        P.read_pages(spark, str(tmp_path / "missing")).collect()


def test_globs_go_through_the_binary_reader(spark, tmp_path):
    for name in ("a.html", "b.txt"):
        (tmp_path / name).write_text(name)
    assert not FS.readable(str(tmp_path / "*.html")) and not FS.readable("viewfs://store/in")
    assert [r["html"] for r in P.read_pages(spark, str(tmp_path / "*.html")).collect()] == ["a.html"]


def test_files_written_twice_are_whole_and_unique(spark, tmp_path):
    rows = [("1", "<p>é</p>"), ("a/b", None), ("c", "x" * 200_000), ("d", "")]
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    out = str(tmp_path / "out")
    assert FS.write_files(df, out, "k", "t", ".html") == 4
    assert FS.write_files(df, out, "k", "t", ".html") == 4     # as a task that runs again
    assert sorted(os.listdir(out)) == ["1.html", "a%2Fb.html", "c.html", "d.html"]
    got = {r["filename"]: r["html"] for r in P.read_pages(spark, out).collect()}
    assert got == {"1.html": "<p>é</p>", "a%2Fb.html": "", "c.html": "x" * 200_000, "d.html": ""}
    assert FS.write_files(df.limit(0), str(tmp_path / "none"), "k", "t") == 0


def test_gold_files_by_the_same_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\x93a\x94\r\n\n b \n")
    (tmp_path / "e.txt").write_bytes(b"")
    got = [(r["file_name"], r["line_no"], r["text"]) for r in G.read_gold_files(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a.txt", 0, "“a”"), ("a.txt", 2, "b")]
