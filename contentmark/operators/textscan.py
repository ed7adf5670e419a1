"""Exact substring search of many needles in each page's text, as Spark jobs.

A page of ordinary size is searched in one piece: its runs and its needles form a
group, whose work is bounded (``PIECE``, ``WORK``).  For any longer page an index
of the text is joined with the needles; no page text meets a needle it does not
hold a rare piece of.

* The text is cut into slices of ``2 * SLICE`` characters, one every ``SLICE``,
  straight from the text runs, so a long page is many rows and no string of the
  whole page is made.
* Anchors are winnowed grams: of every ``w`` consecutive grams of ``k`` characters
  the one with the least hash.  A needle of ``k + w - 1`` characters or more
  holds a whole window, so it has anchors, at places that the page has as well.
  ``SCALES`` gives short needles shorter grams.
* Of a needle's anchors the one rarest in its page is looked up.  Each place
  found and each distinct length asked for there give one candidate text, which is cut from the
  slices and joined with the needles by equality.  Needles that share an anchor
  (numbered list items, say) do not multiply the candidates of each other.

One window pass over such a page's runs and occurrence ends, in text order, then
finds the runs an occurrence starts and ends in: the run's owner when it lies
inside one run, and the elements whose subtree covers it (the ancestors both
owners share).  Containment tests become equi-joins on (page, needle).
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import contentmark
from contentmark.schema import TEXT_KINDS
from contentmark.session import materialize

# Ship the package with the task closures, so executors need no install.
cloudpickle.register_pickle_by_value(contentmark)

PIECE = 1 << 20     # characters of text and needles, runs and path entries of a page searched in one piece
WORK = 1 << 26      # characters of its text times needles
SLICE = 512
# (shortest needle, characters of a gram, grams of a window)
SCALES = ((1, 1, 1), (4, 2, 3), (8, 4, 5), (16, 8, 9))
LOOK = 256          # characters at both ends of a needle that anchors are taken from
_PLACE = 1023       # low bits of an anchor: its place in the text it is from


def slices(dom: DataFrame) -> DataFrame:
    """(page_id, s, text): characters ``s * SLICE`` to ``(s + 2) * SLICE`` of each
    page's text (all runs, scripts included)."""
    runs = dom.where(F.col("kind").isin(*TEXT_KINDS) & (F.col("text") != "")).select(
        "page_id", "c0", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SLICE}}}"), 0)).alias("k", "chunk"))
    at = F.col("c0") + F.col("k") * SLICE
    first = F.greatest(F.floor(at / SLICE) - 1, F.lit(0))
    runs = runs.select("page_id", "chunk", at.alias("at"), F.explode(F.sequence(
        first, F.floor((at + F.length("chunk") - 1) / SLICE))).alias("s"))
    low = F.greatest(F.col("at").cast("bigint"), F.col("s") * SLICE)
    high = F.least(F.col("at") + F.length("chunk"), (F.col("s") + 2) * SLICE)
    part = F.substring("chunk", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    return (runs.select("page_id", "s", F.struct("at", part.alias("part")).alias("x"))
            .groupBy("page_id", "s").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("text")))


def _anchors(text: Column, k: Column, w: Column, windows: Column) -> Column:
    """The winnowed grams of the first ``windows`` windows of a text: gram hash
    over its place."""
    none = F.array().cast("array<bigint>")
    grams = F.transform(F.sequence(F.lit(0), windows + w - 2), lambda i: F.xxhash64(
        F.substring(text, i + 1, k), k).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("bigint")))
    least = F.transform(F.sequence(F.lit(0), windows - 1), lambda i: F.array_min(F.slice(F.col("_grams"), i + 1, w)))
    return F.when(windows > 0, grams).otherwise(none), F.when(
        windows <= 0, none).when(w == 1, F.col("_grams")).otherwise(F.array_distinct(least))


def _with_anchors(df: DataFrame, windows: Column) -> DataFrame:
    grams, least = _anchors(F.col("text"), F.col("sc.k"), F.col("sc.w"), windows)
    return df.withColumn("_grams", grams).withColumn("_a", F.explode(least)).select(
        *[c for c in df.columns if c != "text"], F.col("_a").bitwiseAND(F.lit(~_PLACE)).alias("gram"),
        F.col("_a").bitwiseAND(F.lit(_PLACE)).cast("int").alias("place"))


def _scale(n: Column) -> Column:
    out = None
    for least, k, w in SCALES[::-1]:
        here = F.struct(F.lit(k).alias("k"), F.lit(w).alias("w"))
        out = F.when(n >= least, here) if out is None else out.when(n >= least, here)
    return out


def places(dom: DataFrame, needles: DataFrame) -> DataFrame:
    """(page_id, needle, p): every place of every needle in its page's text.
    Empty needles are skipped (every text contains them - callers handle that
    case directly)."""
    n = F.length("needle")
    nd = materialize(needles.select("page_id", "needle").where(F.col("needle") != "").distinct().select(
        "page_id", "needle", n.alias("len"), _scale(n).alias("sc")), "needles")
    text = materialize(slices(dom), "slices")
    # anchors of the needles: from both ends, or of the whole if it is short
    tail = F.greatest(F.col("len") - LOOK, F.lit(LOOK))
    ends = nd.select("page_id", "needle", "len", "sc", F.explode(F.array(F.lit(0), tail)).alias("from")).where(
        "from < len")
    ends = ends.withColumn("text", F.substring("needle", F.col("from") + 1, F.lit(LOOK)))
    asked = _with_anchors(ends, F.length("text") - F.col("sc.k") - F.col("sc.w") + 2).select(
        "page_id", "needle", "len", "gram", (F.col("from") + F.col("place")).alias("off"))
    asked = materialize(asked, "needle-anchors")
    # anchors of the pages, of the scales and grams some needle asks for
    scales = nd.select("page_id", "sc").distinct()
    inside = F.least(F.length("text") - F.col("sc.k") - F.col("sc.w") + 2, F.lit(SLICE))
    held = _with_anchors(text.join(scales, "page_id"), inside)
    grams = asked.select("page_id", "gram").distinct()
    held = materialize(held.select("page_id", "gram", (F.col("s") * SLICE + F.col("place")).alias("at"))
                       .join(grams, ["page_id", "gram"], "left_semi").distinct(), "page-anchors")
    counts = held.groupBy("page_id", "gram").agg(F.count(F.lit(1)).alias("times"))
    rare = (asked.join(counts, ["page_id", "gram"], "left")
            .groupBy("page_id", "needle", "len").agg(
                F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram", "off")).alias("a"))
            .where("a.times > 0").select("page_id", "len", F.col("a.gram").alias("gram"), F.col("a.off").alias("off")))
    found = (rare.distinct().join(held, ["page_id", "gram"])
             .select("page_id", "len", (F.col("at") - F.col("off")).alias("p")).where("p >= 0").distinct())
    # the candidate texts, piece by piece from the slices
    piece = found.select("page_id", "p", "len", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("len") - 1) / SLICE))).alias("k"))
    at = F.col("p") + F.col("k") * SLICE
    piece = piece.withColumn("s", F.floor(at / SLICE)).join(text, ["page_id", "s"]).select(
        "page_id", "p", "len", "k", F.substring("text", (at - F.col("s") * SLICE + 1).cast("int"), F.least(
            F.lit(SLICE), F.col("len") - F.col("k") * SLICE).cast("int")).alias("part"))
    whole = piece.groupBy("page_id", "p", "len").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("needle"))
    # a candidate that the end of the text cuts short is none
    return (whole.join(nd.select("page_id", "needle", "len"), ["page_id", "needle", "len"])
            .select("page_id", "needle", F.col("p").cast("int").alias("p")))


_FOUND = pa.schema([("needle", pa.string()), ("run_i", pa.int32()), ("run_node", pa.int32()),
                    ("cover", pa.list_(pa.int32()))])


def _find(runs: list, needle: str, text: str, starts: list) -> set:
    """(run_i, run_node, cover) of the needle's occurrences.  A start is looked
    for only where the runs that the occurrence begins and ends in change."""
    out = set()
    n = len(needle)
    p = text.find(needle)
    while p >= 0:
        a = bisect_right(starts, p) - 1
        b = bisect_right(starts, p + n - 1) - 1
        first, last = runs[a], runs[b]
        path = first["path"] or []
        if a != b:
            other = set(last["path"] or [])
            path = [x for x in path if x in other]
        one = first["i"] == last["i"]
        out.add((first["i"] if one else None, first["node"] if one else None, tuple(path)))
        a_end, b_end = (starts[k + 1] if k + 1 < len(starts) else len(text) for k in (a, b))
        p = text.find(needle, max(p + 1, min(a_end, b_end - n + 1)))
    return out


def _search_page(key, rows):
    rows = rows.to_pylist()
    runs = sorted((r for r in rows if r["needle"] is None), key=lambda r: (r["c0"], r["i"]))
    starts = [r["c0"] for r in runs]
    text = "".join(r["text"] for r in runs)
    found = [(r["needle"], *hit) for r in rows if r["needle"] is not None
             for hit in _find(runs, r["needle"], text, starts)]
    columns = zip(*found) if found else [[]] * len(_FOUND)
    out = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)
    return out.add_column(0, pa.field("page_id", key[0].type), pa.array([key[0].as_py()] * len(found), key[0].type))


def _in_pieces(runs: DataFrame, nd: DataFrame) -> DataFrame:
    types = T.StructType([runs.schema["page_id"], *[
        T.StructField(name, kind) for name, kind in (
            ("needle", T.StringType()), ("run_i", T.IntegerType()), ("run_node", T.IntegerType()),
            ("cover", T.ArrayType(T.IntegerType())))]])
    rows = runs.unionByName(nd.select("page_id", "needle"), allowMissingColumns=True)
    return rows.groupBy("page_id").applyInArrow(_search_page, types)


def occurrences(dom: DataFrame, needles: DataFrame) -> DataFrame:
    """(page_id, needle, run_i, run_node, cover): one row per needle and
    distinct place in the tree it occurs at.  ``run_i`` / ``run_node``: token
    and owner of the run that holds it whole (else null); ``cover``: the
    elements covering it, root first."""
    nd = materialize(needles.select("page_id", "needle").where(
        (F.col("needle") != "") & F.col("page_id").isNotNull()).distinct(), "needles")
    asked = nd.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("needle")).alias("asked"))
    runs = dom.where(F.col("kind").isin(*TEXT_KINDS)).select("page_id", "c0", "i", "node", "path", "text")
    # a page given more than once has no text of its own and is left to the index
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    held = dom.where(F.col("kind").isin("doc", *TEXT_KINDS)).select(
        "page_id", (F.col("kind") == "doc").alias("doc"), n_chars.alias("chars"),
        (n_chars + F.greatest(F.size("path"), F.lit(0)) + 1).alias("size")).groupBy("page_id").agg(
            F.count_if("doc").alias("docs"), F.sum(F.when(F.col("doc"), F.col("chars"))).alias("chars"),
            F.sum(F.when(~F.col("doc"), F.col("size"))).alias("size"))
    ordinary = ((F.col("docs") == 1) & (F.col("size") + F.col("asked") <= PIECE)
                & (F.col("chars") * F.col("n") <= WORK))
    pages = materialize(held.where("size > 0").join(asked, "page_id").select("page_id", ordinary.alias("ordinary")),
                        "search-pages")
    near, far = (pages.where(c).select("page_id") for c in ("ordinary", "not ordinary"))
    near = _in_pieces(*(df.join(near, "page_id", "left_semi") for df in (runs, nd)))
    if far.isEmpty():
        return near
    return near.unionByName(_by_index(*(df.join(far, "page_id", "left_semi") for df in (dom, nd))))


def _by_index(dom: DataFrame, needles: DataFrame) -> DataFrame:
    """``occurrences`` in pages of any length, by ``places``."""
    run = F.struct("i", "node", "path")
    runs = dom.where(F.col("kind").isin(*TEXT_KINDS)).select(
        "page_id", F.col("c0").alias("at"), run.alias("run"))
    ends = places(dom, needles).select(
        "page_id", "needle", "p",
        F.explode(F.array(F.col("p"), F.col("p") + F.length("needle") - 1)).alias("at"))
    line = runs.unionByName(ends, allowMissingColumns=True)
    upto = (Window.partitionBy("page_id").orderBy("at", F.col("p").asc_nulls_first(), "run.i")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ab = (line.withColumn("run", F.last("run", ignorenulls=True).over(upto))
          .where(F.col("p").isNotNull())
          .groupBy("page_id", "needle", "p").agg(F.min("run").alias("a"), F.max("run").alias("b")))
    one = F.col("a.i") == F.col("b.i")
    return ab.select("page_id", "needle", F.when(one, F.col("a.i")).alias("run_i"),
                     F.when(one, F.col("a.node")).alias("run_node"),
                     F.coalesce(F.array_intersect("a.path", "b.path"), F.array().cast("array<int>"))
                     .alias("cover")).distinct()
