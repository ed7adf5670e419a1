"""Predicates, marking and edits over the node table.

Every operator is a DataFrame -> DataFrame function keyed by ``page_id``.  An
element's subtree is the interval [``pre``, ``last``] of element numbers, and
intervals nest, so tree relations are comparisons or running aggregates in
document order: no range join, no recursive step, no list of ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmark.functions.text import strip_ws
from contentmark.schema import MAIN_LABEL_ATTR


def by_class(nodes: DataFrame, name: str) -> DataFrame:
    """Elements carrying the class token ``name`` (case-sensitive)."""
    return nodes.where(F.array_contains("classes", name))


def attr_equals(name: str, value) -> Column:
    """Attribute ``name`` equals ``value`` (ints compared as their string)."""
    return F.try_element_at(F.col("attrs"), F.lit(name)) == F.lit(str(value))


def by_attr(nodes: DataFrame, name: str, value) -> DataFrame:
    """Elements whose attribute ``name`` equals ``value``."""
    return nodes.where(attr_equals(name, value))


def mark_subtrees(nodes: DataFrame, seeds: DataFrame, col: str = "is_main") -> DataFrame:
    """Seeds and every descendant element get ``col`` = 1, others 0.

    In document order, an element lies in a seed's subtree when the furthest
    ``last`` of the seeds up to it reaches it.  Seeds are lined up with the
    elements, so one shuffle by page and one sort answer both "is a seed" and
    "is below one".  ``col`` already on ``nodes`` is OR-ed in, so markings compose."""
    s = seeds.select("page_id", F.col("pre").cast("int").alias("pre"), F.lit(True).alias("_s"))
    line = nodes.withColumn("_s", F.lit(False)).unionByName(s, allowMissingColumns=True)
    upto = (Window.partitionBy("page_id").orderBy("pre", F.col("_s").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = (line.withColumn("_at", F.max(F.when(F.col("_s"), F.col("pre"))).over(upto))
            .withColumn("_to", F.max(F.when(F.col("_at") == F.col("pre"), F.col("last"))).over(upto)))
    hit = F.coalesce(F.col("_to") >= F.col("pre"), F.lit(False))
    if col in nodes.columns:
        hit = hit | (F.col(col) == 1)
    return line.where(~F.col("_s")).withColumn(col, hit.cast("int")).drop("_s", "_at", "_to")


def remove_class(nodes: DataFrame, name: str) -> DataFrame:
    """Drop the class token ``name``."""
    return nodes.withColumn("classes", F.array_remove("classes", name))


def remove_attr(nodes: DataFrame, name: str) -> DataFrame:
    """Drop attribute ``name`` where its value is 0 or 1."""
    return nodes.withColumn("attrs", F.map_filter(
        "attrs", lambda k, v: ~((k == F.lit(name)) & v.isin("0", "1"))))


def set_attr(nodes: DataFrame, name: str, flag: str = "is_main",
             value: str = "1") -> DataFrame:
    """Put attribute ``name`` = ``value`` on nodes where ``flag`` is 1."""
    return nodes.withColumn("attrs", F.when(
        F.col(flag) == 1,
        F.map_concat(F.map_filter("attrs", lambda k, v: k != F.lit(name)),
                     F.create_map(F.lit(name), F.lit(value)))
    ).otherwise(F.col("attrs")))


def unwrap_spans(nodes: DataFrame, texts: DataFrame, attr: str | None,
                 col: str = "is_main", tag: str = "span") -> tuple[DataFrame, DataFrame]:
    """Unwrap annotation spans (``tag`` elements with ``attr`` in {0, 1};
    every ``tag`` element when ``attr`` is None).

    * the span's single string (``.string``) is trimmed;
    * a main-labelled span passes the label to its effective parent - the
      nearest ancestor that is not itself unwrapped (labels chain through
      unwrapped spans, whatever order they are processed in);
    * the span disappears; its children are re-parented to that ancestor.

    ``_kept_parents`` finds the new parents.  Returns (nodes, texts) without
    the spans, with ``parent`` and ``depth`` recomputed and without path columns."""
    if col not in nodes.columns:
        nodes = nodes.withColumn(col, F.lit(0))
    flagged = nodes.drop("path", "path_tags", "path_cls", "text_seq", "tag_seq", "class_seq").withColumn("doomed", unwrap_condition(attr, tag))
    j = flagged.join(_kept_parents(flagged), ["page_id", "pre"])
    lifts = (j.where(F.col("doomed") & (F.col(col) == 1) & F.col("eff_parent").isNotNull())
             .select("page_id", F.col("eff_parent").alias("pre"))
             .distinct().withColumn("lifted", F.lit(1)))
    trims = (j.where(F.col("doomed") & F.col("string_i").isNotNull())
             .select("page_id", F.col("string_i").alias("i")).distinct()
             .withColumn("trim", F.lit(True)))
    out = (j.where(~F.col("doomed"))
           .withColumn("depth", F.col("_level"))
           .withColumn("parent", F.coalesce(F.col("eff_parent"), F.lit(-1)))
           .join(lifts, ["page_id", "pre"], "left")
           .withColumn(col, F.greatest(F.col(col), F.coalesce("lifted", F.lit(0))))
           .drop("lifted", "doomed", "_level", "eff_parent"))
    # a text run moves to its owner's nearest kept ancestor-or-self
    owner = j.select("page_id", F.col("pre").alias("node"),
                     F.coalesce(F.when(F.col("doomed"), F.col("eff_parent")).otherwise(F.col("pre")),
                                F.lit(-1)).alias("_new"))
    t = (texts.drop("path", "norm").join(trims, ["page_id", "i"], "left")
         .withColumn("text", F.when(F.col("trim"), strip_ws("text"))
                     .otherwise(F.col("text")))
         .drop("trim")
         .join(owner, ["page_id", "node"], "left")
         .withColumn("node", F.coalesce("_new", F.col("node")))
         .drop("_new"))
    return out, t


def unwrap_condition(attr: str | None, tag: str = "span") -> Column:
    c = F.col("tag") == tag
    if attr is not None:
        c = c & F.coalesce(F.try_element_at(F.col("attrs"), F.lit(attr)).isin("0", "1"),
                           F.lit(False))
    return c


def _kept_parents(flagged: DataFrame) -> DataFrame:
    """(page_id, pre, _level, eff_parent) of elements with a ``doomed`` flag:
    the number of kept strict ancestors and the nearest of them (or null).

    ``_level`` is the depth less the doomed elements open at that place, a running
    sum over their starts and ends.  The nearest kept ancestor of an element
    on level k is the last kept element before it on level k - 1: any kept one
    in between would lie below that ancestor, on level k or deeper."""
    part = F.col("doomed")
    starts = flagged.select("page_id", F.col("pre").alias("at"), F.lit(1).alias("side"), "pre", "depth",
                            "doomed", part.cast("int").alias("step"))
    ends = flagged.where(part).select("page_id", (F.col("last") + 1).alias("at"), F.lit(0).alias("side"),
                                      F.lit(-1).alias("step"))
    before = (Window.partitionBy("page_id").orderBy("at", "side")
              .rowsBetween(Window.unboundedPreceding, -1))
    level = (starts.unionByName(ends, allowMissingColumns=True)
             .withColumn("_open", F.coalesce(F.sum("step").over(before), F.lit(0)))
             .where(F.col("pre").isNotNull())
             .withColumn("_level", (F.col("depth") - F.col("_open")).cast("int")))
    # every element asks on the level above its own and, if kept, stands on its own
    asks = F.struct((F.col("_level") - 1).alias("slot"), F.lit(None).cast("int").alias("stands"))
    stands = F.struct(F.col("_level").alias("slot"), F.when(~part, F.col("pre")).alias("stands"))
    upto = (Window.partitionBy("page_id", "slot").orderBy("pre")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (level.select("page_id", "pre", "_level", F.explode(F.array(asks, stands)).alias("r"))
            .select("page_id", "pre", "_level", "r.slot", "r.stands")
            .withColumn("eff_parent", F.last("stands", ignorenulls=True).over(upto))
            .where(F.col("slot") < F.col("_level"))
            .select("page_id", "pre", "_level", "eff_parent"))


def lowest_common_ancestor(seeds: DataFrame) -> DataFrame:
    """N7 for seeds that carry ``path``: (page_id, lca) without the node table.

    The common prefix of the lexicographically smallest and largest root
    paths is the common prefix of all of them: a partial min / max
    aggregate.  Pages without seeds give no row."""
    agg = seeds.groupBy("page_id").agg(F.min("path").alias("mn"),
                                       F.max("path").alias("mx"))
    return agg.select("page_id", F.array_max(F.array_intersect("mn", "mx")).alias("lca"))


def common_ancestor(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(page_id, lca, lca_last) - the deepest element whose interval
    covers the first and the last seed of its page, and so all between.

    Seeds shrink to one (first, last) pair a page by a partial aggregate;
    the answer is one more over the elements.  Pages without seeds give no
    row; seeds without a common element give nulls."""
    span = seeds.groupBy("page_id").agg(F.min("pre").alias("_lo"), F.max("pre").alias("_hi"))
    covers = (F.col("pre") <= F.col("_lo")) & (F.col("last") >= F.col("_hi"))
    best = (nodes.select("page_id", "pre", "last").join(span, "page_id")
            .groupBy("page_id").agg(F.max(F.when(covers, F.struct("pre", "last"))).alias("b")))
    return best.select("page_id", F.col("b.pre").alias("lca"), F.col("b.last").alias("lca_last"))


def _extent(nodes: DataFrame, lca: DataFrame) -> DataFrame:
    """(page_id, lca, lca_last): the extent is looked up where ``lca`` lacks it."""
    if "lca_last" in lca.columns:
        return lca
    return lca.join(nodes.select("page_id", F.col("pre").alias("lca"), F.col("last").alias("lca_last")),
                    ["page_id", "lca"])


def mark_block(nodes: DataFrame, lca: DataFrame, col: str = "is_main") -> DataFrame:
    """Everything from the LCA down gets ``col`` = 1."""
    return (nodes.join(_extent(nodes, lca), "page_id", "left")
            .withColumn(col, F.coalesce(F.col("pre").between(F.col("lca"), F.col("lca_last")),
                                        F.lit(False)).cast("int"))
            .drop("lca", "lca_last"))


def contradictions(nodes: DataFrame, lca: DataFrame, attr: str | None = None,
                   where: Column | None = None) -> DataFrame:
    """(page_id, n) - pages whose main block holds descendants with
    ``attr`` = 0 (or matching ``where``); the reference warns once per page."""
    cond = attr_equals(attr, 0) if where is None else where
    return (nodes.join(_extent(nodes, lca), "page_id")
            .where((F.col("pre") > F.col("lca")) & (F.col("pre") <= F.col("lca_last")) & cond)
            .groupBy("page_id").agg(F.count(F.lit(1)).alias("n")))


def own_text_contains(texts: DataFrame, needle: Column | str) -> DataFrame:
    """(page_id, pre) of elements with one own text run containing
    ``needle`` (a literal or a column of the input)."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return (texts.where(F.contains("text", n))
            .select("page_id", F.col("node").alias("pre")).distinct())


def subtree_text(nodes: DataFrame, page_text: DataFrame, plain: bool = False) -> DataFrame:
    """Nodes with ``subtree_text`` = all descendant strings in document
    order (``plain`` excludes script / style bodies).

    The parser records each subtree's character range in the page's text,
    so this is one join with the per-page text and a substring - linear in
    the data, whatever the tree depth."""
    txt, a, b = ("plain", "s0", "s1") if plain else ("content", "c0", "c1")
    return (nodes.join(page_text.select("page_id", F.col(txt).alias("_t")), "page_id")
            .withColumn("subtree_text", F.substring(
                "_t", F.col(a) + 1, F.col(b) - F.col(a)))
            .drop("_t"))


def main_attr(nodes: DataFrame, col: str = "is_main") -> DataFrame:
    """Write the main-content label attribute on marked nodes."""
    return set_attr(nodes, MAIN_LABEL_ATTR, col, "1")
