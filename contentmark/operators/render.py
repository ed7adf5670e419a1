"""Re-assemble pages from their tokens with edits applied.

Bytes outside edited tokens stay as in the source.  Edits are rows
(page_id, i, raw) replacing token ``i``; tokens and edits are unioned and
grouped once per page (one shuffle of the token stream), sorted by
(i, priority) so each edit sits right behind its token, and joined back
into the page text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_text(c) -> Column:
    """Minimal HTML escaping of text: & < >."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def attr_string(attrs="attrs", classes="classes") -> Column:
    """`` k="v"`` for every attribute in order; ``class`` from the class list."""
    a = F.transform_values(F.col(attrs), lambda k, v: F.when(
        k == "class", F.array_join(F.col(classes), " ")).otherwise(v))
    return F.array_join(F.transform(F.map_entries(a), lambda e: F.concat(
        F.lit(" "), e["key"], F.lit('="'),
        F.replace(escape_text(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")


def start_tag(tag="tag", attrs="attrs", classes="classes", raw="raw") -> Column:
    """A start tag rebuilt from (edited) attributes; keeps a self-closing ``/>``."""
    end = F.when(F.col(raw).endswith("/>"), F.lit("/>")).otherwise(F.lit(">"))
    return F.concat(F.lit("<"), F.col(tag), attr_string(attrs, classes), end)


def node_edits(nodes: DataFrame) -> DataFrame:
    """(page_id, i, raw) edits from an edited node table (needs ``i``,
    ``raw``, ``attrs``/``classes`` and their originals ``attrs0``/``classes0``):
    start tags whose attributes changed are rebuilt."""
    changed = attr_string("attrs", "classes") != attr_string("attrs0", "classes0")
    return nodes.where(changed).select("page_id", "i", start_tag().alias("raw"))


def removed_tags(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """(page_id, i, raw) blanking the start and end tags of the elements of
    ``nodes`` that ``kept`` no longer holds; their content stays."""
    gone = nodes.join(kept.select("page_id", "pre"), ["page_id", "pre"], "left_anti")
    return (gone.select("page_id", F.explode(F.array("i", "end_i")).alias("i"))
            .where(F.col("i").isNotNull()).withColumn("raw", F.lit("")))


def render(tokens: DataFrame, edits: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(page_id, html): tokens in order with ``edits`` (page_id, i, raw)
    applied; at most one edit per token."""
    t = tokens.select(key, "i", F.lit(0).alias("prio"), "raw")
    if edits is not None:
        t = t.unionByName(edits.select(key, "i", F.lit(1).alias("prio"), "raw"))
    grouped = t.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("i", "prio", "raw"))).alias("_a"))
    a = F.col("_a")
    picked = F.transform(a, lambda x, j: F.when(x["prio"] == 0, F.when(
        (j + 1 < F.size(a)) & (F.element_at(a, j + 2)["i"] == x["i"]),
        F.element_at(a, j + 2)["raw"]).otherwise(x["raw"])))
    return grouped.select(key, F.array_join(F.filter(picked, lambda x: x.isNotNull()), "").alias("html"))


def text_edits(texts: DataFrame, edited: DataFrame) -> DataFrame:
    """(page_id, i, raw) re-encoding the runs whose text ``edited`` changed;
    script and style bodies are written as they are."""
    new = edited.select("page_id", "i", F.col("text").alias("_new"))
    return (texts.join(new, ["page_id", "i"]).where(F.col("_new") != F.col("text"))
            .select("page_id", "i", F.when(F.col("kind") == "rawtext", F.col("_new"))
                    .otherwise(escape_text("_new")).alias("raw")))


def highlight_edits(nodes: DataFrame, tokens: DataFrame, flag: str = "label") -> DataFrame:
    """(page_id, i, raw) wrapping the single string (``.string``) of
    each positive element in ``<mark>``."""
    s = (nodes.where((F.col(flag) == 1) & F.col("string_i").isNotNull())
         .select("page_id", F.col("string_i").alias("i")).distinct())
    return (tokens.join(s, ["page_id", "i"])
            .select("page_id", "i", F.concat(F.lit("<mark>"), F.col("raw"),
                                             F.lit("</mark>")).alias("raw")))
