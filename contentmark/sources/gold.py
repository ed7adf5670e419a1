"""Gold main-content lines.

A gold file is one main-content line per line, optionally followed by a
comments part after a separator line.  Lines are decoded (UTF-8, falling
back to windows-1252), stripped, blanks dropped, and cut at the separator
unless comments are wanted.  Sources: a directory of gold files, or any
table with a key and a text column (``documents``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmark.functions.charset import decode_windows_1252
from contentmark.functions.text import strip_ws
from contentmark.session import spread
from contentmark.sources.files import read_files, readable

# Fixed value: the separator line before the comments part of a gold file.
COMMENTS_SEPARATOR = "!@#$%^&*()  COMMENTS"


def gold_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
               include_comments: bool = False) -> DataFrame:
    """(key, line_no, text): stripped non-blank lines with their line number
    in the file, cut at the comments separator unless ``include_comments``.

    All per-row array expressions on the file's text - no shuffle."""
    # bind the split lines to a column first: referenced three times below,
    # and Generate does not eliminate common subexpressions
    lines = docs.select(F.col(key), F.transform(F.split(F.col(text), r"\r\n|\r|\n"),
                                                strip_ws).alias("_l"))
    arr = F.col("_l")
    if not include_comments:
        lines = lines.withColumn("_p", F.array_position(arr, COMMENTS_SEPARATOR))
        arr = F.when(F.col("_p") > 0, F.slice(arr, F.lit(1), (F.col("_p") - 1).cast("int"))
                     ).otherwise(arr)
    return (lines.select(F.col(key), F.posexplode(arr).alias("line_no", "text"))
            .where(F.col("text") != ""))


def decode_gold_bytes(content) -> "F.Column":
    """UTF-8 when valid, else windows-1252."""
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(
        decode_windows_1252(content))


def read_gold_files(spark, path: str, include_comments: bool = False) -> DataFrame:
    """Gold files from a directory: (file_name, line_no, text)."""
    if readable(path):
        raw = read_files(spark, path, html=False).withColumnRenamed("filename", "file_name")
    else:
        raw = (spark.read.format("binaryFile").load(path)
               .select(F.col("_metadata.file_name").alias("file_name"), "content"))
    raw = raw.select("file_name", decode_gold_bytes(F.col("content")).alias("text"))
    return gold_lines(raw, "file_name", "text", include_comments)


def page_source_doc(pages: DataFrame) -> DataFrame:
    """(page_id, doc_id): the source document named in the page URL path
    (``/<lang>/<doc_id>``) - the pairing of a page with its gold file."""
    return pages.select(
        "page_id",
        F.regexp_extract("url", r"/[a-z]{2}/([0-9]+)", 1).alias("_d")
    ).where(F.col("_d") != "").select("page_id", F.col("_d").cast("bigint").alias("doc_id"))


HOT = 2000          # a document is hot if it feeds over 1 / HOT of all pages ..
HOT_PAGES = 64      # .. and more pages than this


def hot_documents(pairs: DataFrame) -> DataFrame:
    """(doc_id, salts) of the documents that feed too many pages for one task, by
    exact counts: fewer than ``HOT`` rows, whatever the data, so they may be
    broadcast.  A salt holds about ``1 / HOT`` of the pages, at least ``HOT_PAGES``."""
    share = F.greatest(pairs.agg(F.count(F.lit(1))).scalar() / HOT, F.lit(float(HOT_PAGES)))
    counts = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > share).select("doc_id", F.ceil(F.col("n") / share).cast("int").alias("salts"))


def salted(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pairs`` (page_id, doc_id) joined with ``lines`` (doc_id, ..): the pages of a hot
    document are dealt to its salts by a digest, its lines copied to each of them."""
    hot = F.broadcast(hot_documents(pairs))
    n = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, "doc_id", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), n).cast("int")).drop("salts")
    copied = lines.join(hot, "doc_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
    return dealt.join(copied, ["doc_id", "salt"]).drop("salt")


def gold_for_pages(pages: DataFrame, documents: DataFrame,
                   include_comments: bool = False) -> DataFrame:
    """(page_id, line_no, text): gold lines of each page's source document.

    Only documents some page names are split into lines (a semi-join on
    ``doc_id`` before the explode).  A document feeding many pages is dealt over
    several tasks by a salt."""
    pd = page_source_doc(pages)
    docs = spread(documents.select("doc_id", "text"), "doc_id").join(
        pd.select("doc_id").distinct(), "doc_id", "left_semi")
    lines = gold_lines(docs, "doc_id", "text", include_comments)
    return salted(pd, lines).select("page_id", "line_no", "text")
