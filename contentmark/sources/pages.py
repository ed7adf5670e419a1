"""Page corpora - directories of HTML files, allow-lists, CSV, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmark.functions.charset import decode_html
from contentmark.session import new_path
from contentmark.sources.files import read_files, readable


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    return new_path(spark, "contentmark-scratch", name)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A directory of HTML files, one page per file -> (filename, html).

    The key is the file name; bytes are decoded by ``decode_html_bytes``.  Folders are
    read by ``read_files``, which keeps files of zero length.  Glob patterns and file
    systems that only Spark can open go through its binary reader, which lists no
    such file (``missing_pages`` names it when an allow-list does)."""
    if readable(path):
        return read_files(spark, path)
    return (spark.read.format("binaryFile").load(path)
            .select(F.col("_metadata.file_name").alias("filename"),
                    decode_html(F.col("content")).alias("html")))


def read_name_lists(spark: SparkSession, paths) -> DataFrame:
    """Allow-list files (one name per line, several files concatenated,
    names stripped) -> (name)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return (spark.read.text(paths).select(F.trim(F.col("value")).alias("name"))
            .where(F.col("name") != ""))


def select_pages(pages: DataFrame, names: DataFrame, key: str = "filename") -> DataFrame:
    """Keep pages named in the allow-list (left semi join)."""
    return pages.join(names.withColumnRenamed("name", key), key, "left_semi")


def missing_pages(pages: DataFrame, names: DataFrame, key: str = "filename") -> DataFrame:
    """Names in the allow-list without a page (the reference fails on them)."""
    return names.withColumnRenamed("name", key).join(pages, key, "left_anti")


def pages_to_csv(pages: DataFrame, path: str, key: str = "filename") -> None:
    """S3: corpus to CSV with header ``filename,html``; quotes and newlines
    inside the HTML survive a ``multiLine`` read."""
    (pages.select(F.col(key).cast("string").alias("filename"), "html")
     .write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').csv(path))


def read_pages_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a corpus CSV written by ``pages_to_csv`` -> (filename, html)."""
    return (spark.read.option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .schema("filename STRING, html STRING").csv(path))


def write_pages(pages: DataFrame, path: str, fmt: str = "parquet",
                partition_by: str | None = None) -> None:
    """Write processed pages, one row per page (not one file per page)."""
    w = pages.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.save(path)
