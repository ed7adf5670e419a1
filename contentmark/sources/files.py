"""Folders of files, one page or gold text per file, as a Spark data source.

``read_files`` is a Python data source: the folder is listed once, files are packed
into partitions by bytes, and tasks read and decode their own files in Arrow
batches.  Unlike Spark's file sources it keeps files of zero length: an empty
page is a page.  ``write_files`` is the way back, one file per row.

Folders are opened by pyarrow (local or shared paths, ``hdfs``, ``s3``, ``gs``,
``abfss``).  Only files straight in the folder count; names that start with ``_``
or ``.`` are left out, as Spark does.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

import contentmark
from contentmark.functions.charset import decode_html_bytes

cloudpickle.register_pickle_by_value(contentmark)

SCHEMES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
OPEN_COST = 1 << 20     # bytes that opening a file counts for
BATCH_BYTES = 16 << 20  # a batch is handed on once its files reach this size
BATCH_FILES = 1024


def readable(path: str) -> bool:
    """Whether ``read_files`` can open the folder."""
    scheme, colon, _ = path.partition(":")
    return (not colon or "/" in scheme or scheme in SCHEMES) and not set("*?[{") & set(path)


def _filesystem(path: str):
    """(file system, path on it); ``file:/x`` and ``file:///x`` are both local."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def pack(sizes: list[int], room: int) -> list[int]:
    """First index of each run of files that together take ``room`` bytes (a
    larger file is a run of its own), opening costs included."""
    starts, used = [], room + 1
    for i, size in enumerate(sizes):
        if used + size + OPEN_COST > room:
            starts.append(i)
            used = 0
        used += size + OPEN_COST
    return starts


class FilePack(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class FolderReader(DataSourceReader):
    def __init__(self, path: str, html: bool, room: int):
        self.path, self.html, self.room = path, html, room

    def partitions(self):
        from pyarrow import fs
        system, folder = _filesystem(self.path)
        found = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(folder))
                       if f.type == fs.FileType.File and f.base_name[0] not in "_.")
        starts = pack([size for _, size in found], self.room)
        return [FilePack([p for p, _ in found[a:b]])
                for a, b in zip(starts, [*starts[1:], len(found)])] or [FilePack([])]

    def read(self, partition):
        system, _ = _filesystem(self.path)
        kind = pa.string() if self.html else pa.binary()
        names, bodies, size = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, kind)],
                                              names=["filename", "html" if self.html else "content"])
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                raw = f.read()
            names.append(path.rsplit("/", 1)[-1])
            bodies.append(decode_html_bytes(raw) if self.html else raw)
            size += len(raw)
            if size >= BATCH_BYTES or len(names) == BATCH_FILES:
                yield batch()
                names, bodies, size = [], [], 0
        if names:
            yield batch()


class FolderSource(DataSource):
    """Options: ``path``; ``as`` = ``html`` (decoded) or ``bytes``; ``room``, the
    bytes of a partition."""

    @classmethod
    def name(cls):
        return "contentmark-files"

    def _html(self) -> bool:
        return self.options.get("as", "html") == "html"

    def schema(self):
        return "filename string, html string" if self._html() else "filename string, content binary"

    def reader(self, schema):
        return FolderReader(self.options["path"], self._html(), int(self.options["room"]))


def read_files(spark: SparkSession, path: str, html: bool = True, room: int | None = None) -> DataFrame:
    """The files of a folder: (filename, html), decoded as ``decode_html_bytes``
    says, or (filename, content).  ``room``: bytes of a partition, by default
    what Spark's own file sources take.  An empty folder gives no rows."""
    spark.dataSource.register(FolderSource)
    if room is None:
        room = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return (spark.read.format(FolderSource.name()).option("as", "html" if html else "bytes")
            .option("room", room).load(path))


def write_files(df: DataFrame, path: str, key: str, body: str, suffix: str = "") -> int:
    """One file per row, ``<key><suffix>``, the text as UTF-8 (null: a file of
    zero length), keys percent-encoded where a file name can't hold them;
    returns the number of rows.  Keys must be unique and not null.  A file
    appears under its name when it is whole, so tasks can be run again."""
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(body).cast("string").alias("b"))

    def write(batches):
        import uuid
        from urllib.parse import quote
        system, folder = _filesystem(path)
        system.create_dir(folder, recursive=True)
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write((text or "").encode("utf-8"))
                system.move(part, f"{folder}/{quote(k, safe=' ')}{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
