"""Write block predictions back to the pages' elements.

Each block is matched to elements of its page in six tiers (tag + own text,
parent tag + subtree text, ``parent > tag``, the whole tag chain, and the
combined text in two forms); the cascade keeps the first tier with exactly
one hit (tier 2 only when tier 1 found none), else tier 6.  Tiers are matched
once per distinct target of a page.

Pages of ordinary size are matched page by page (``pagematch``).  Pages that are larger than
that (``PIECE``, ``WORK``) or given more than once are matched by equi-joins on (page,
needle) with the needle's occurrences and on (page, key) with the elements'
white-space-free text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmark.functions.tags import html_tag, html_tags
from contentmark.functions.text import remove_ws, strip_quotes
from contentmark.operators import shred as S
from contentmark.operators.pagematch import COUNTS, HITS, LABELS, PIECE, RESOLVED, WORK, match_pages
from contentmark.operators.textscan import occurrences
from contentmark.session import materialize

BKEY = ["page_id", "part", "pos"]
TIERS = (1, 2, 3, 4, 5, 6)


def clean_text(c) -> Column:
    """R2: drop one leading and one trailing double quote (``contains`` is
    literal, so no selector escaping is needed)."""
    return strip_quotes(c)


def _raw_targets(blocks: DataFrame, mapping: dict | None, label: str) -> DataFrame:
    """``block_targets`` with the texts as they are joined (``joined``), not their key."""
    tags = html_tags("tag_seq", mapping)
    return blocks.select(
        *BKEY, F.col(label).alias("label"),
        html_tag(F.try_element_at("tag_seq", F.lit(-1)), mapping).alias("t_tag"),
        html_tag(F.try_element_at("tag_seq", F.lit(-2)), mapping).alias("t_parent"),
        tags.alias("chain"),
        clean_text(F.try_element_at("text_seq", F.lit(-1))).alias("needle"),
        F.array_join("text_seq", ", ").alias("joined"))


def block_targets(blocks: DataFrame, mapping: dict | None = None,
                  label: str = "prediction") -> DataFrame:
    """Per block: HTML tag of the block (``t_tag``) and of its parent item
    (``t_parent``, null for one-item sequences), the chain of HTML tags,
    the cleaned last text (``needle``) and the key of all texts joined."""
    return (_raw_targets(blocks, mapping, label)
            .withColumn("all_key", remove_ws(clean_text("joined"))).drop("joined"))


def node_targets(nodes: DataFrame) -> DataFrame:
    """Per element: tag, parent tag and the tags of its strict ancestors
    (root first) - straight from the shredder's path tags."""
    anc = F.slice("path_tags", 1, F.greatest(F.size("path_tags") - 1, F.lit(0)))
    return nodes.select("page_id", "pre", "tag", "path", "path_tags", "k0", "k1",
                        anc.alias("anc_tags"),
                        F.try_element_at("path_tags", F.lit(-2)).alias("parent_tag"))


def _chain_match(want: Column, anc_tags: Column) -> Column:
    """CSS descendant chain: ``want`` = [t1 .. tn-1] must appear, in order,
    among the ancestors (greedy from the nearest ancestor upward)."""
    n = F.size(want)
    k = F.aggregate(F.reverse(anc_tags), n,
                    lambda k, x: F.when((k >= 1) & (F.element_at(want, F.greatest(k, F.lit(1))) == x),
                                        k - 1).otherwise(k))
    return k == 0


def targets(blocks: DataFrame, mapping: dict | None = None, label: str = "prediction") -> DataFrame:
    """``block_targets`` plus (t_part, t_pos): the first block of the page with
    the same target.  Tiers are matched once per target, so equal blocks do
    not multiply the hits."""
    same = Window.partitionBy("page_id", "t_tag", "t_parent", "chain", "needle", "all_key")
    return (block_targets(blocks, mapping, label)
            .withColumn("_t", F.min(F.struct("part", "pos")).over(same))
            .withColumn("t_part", F.col("_t.part")).withColumn("t_pos", F.col("_t.pos")).drop("_t"))


def _distinct_targets(b: DataFrame) -> DataFrame:
    return b.where((F.col("part") == F.col("t_part")) & (F.col("pos") == F.col("t_pos")))


def _per_block(b: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Rows found for targets, repeated for each block of the target."""
    f = found.withColumnRenamed("part", "t_part").withColumnRenamed("pos", "t_pos")
    return b.select(*BKEY, "t_part", "t_pos").join(f, ["page_id", "t_part", "t_pos"], how).drop("t_part", "t_pos")


def _tier1(b: DataFrame, occ: DataFrame, nt: DataFrame, texts: DataFrame) -> DataFrame:
    """An own text run of an element with the block's tag holds the
    needle - occurrences inside one run, joined on (page, needle)."""
    tags = nt.select("page_id", F.col("pre").alias("run_node"), F.col("tag").alias("t_tag"))
    hit = (b.where(F.col("needle") != "").select(*BKEY, "t_tag", "needle")
           .join(occ.where(F.col("run_node").isNotNull()).select("page_id", "needle", "run_node"),
                 ["page_id", "needle"])
           .join(tags, ["page_id", "run_node", "t_tag"])
           .select(*BKEY, F.lit(1).alias("tier"), F.col("run_node").alias("pre")))
    # an empty needle is in every text: every element of the tag owning a run
    owners = texts.select("page_id", F.col("node").alias("pre"), F.col("tag").alias("t_tag")).distinct()
    empty = (b.where(F.col("needle") == "").select(*BKEY, "t_tag")
             .join(owners, ["page_id", "t_tag"])
             .select(*BKEY, F.lit(1).alias("tier"), "pre"))
    return hit.unionByName(empty).distinct()


def _subtree_tiers(b: DataFrame, occ: DataFrame, nt: DataFrame) -> DataFrame:
    """R4 (tag = parent item), R5 (``parent > tag``), R6 (whole tag chain):
    the element's subtree text holds the needle.  Those elements cover an
    occurrence (its common ancestors, bounded by tree depth); one join with
    them answers the three tiers."""
    cov = (b.where(F.col("needle") != "").select(*BKEY, "needle")
           .join(occ.select("page_id", "needle", "cover"), ["page_id", "needle"])
           .select(*BKEY, F.explode("cover").alias("pre")).distinct())
    empty = (b.where(F.col("needle") == "").select(*BKEY)
             .join(nt.select("page_id", "pre"), "page_id"))
    j = (cov.unionByName(empty)
         .join(nt.select("page_id", "pre", "tag", "parent_tag", "anc_tags"), ["page_id", "pre"])
         .join(b.select(*BKEY, "t_tag", "t_parent", "chain"), BKEY))
    return _tiers(j, _subtree_conditions())


def _subtree_conditions() -> dict:
    own = F.col("tag") == F.col("t_tag")
    chain = _chain_match(F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0))), F.col("anc_tags"))
    return {2: F.col("tag") == F.col("t_parent"), 3: own & (F.col("parent_tag") == F.col("t_parent")), 4: own & chain}


def _path_tiers(b: DataFrame, occ: DataFrame, nt: DataFrame) -> DataFrame:
    """R3-R6 in pages given once, of needles with a text: the innermost element
    around an occurrence has all elements that cover it on its path.  They are listed
    once per needle, however many of its occurrences and targets there are."""
    inner = F.try_element_at("cover", F.lit(-1))
    around = (occ.select("page_id", "needle", inner.alias("inner"), F.col("run_node").isNotNull().alias("own"))
              .groupBy("page_id", "needle", "inner").agg(F.max("own").alias("own"))
              .join(nt.select("page_id", F.col("pre").alias("inner"), "path"), ["page_id", "inner"])
              .select("page_id", "needle", "inner", "own", F.explode("path").alias("pre"))
              .groupBy("page_id", "needle", "pre").agg(
                  F.max(F.col("own") & (F.col("pre") == F.col("inner"))).alias("own")))
    j = (b.select(*BKEY, "t_tag", "t_parent", "chain", "needle").join(around, ["page_id", "needle"]).drop("needle")
         .join(nt.select("page_id", "pre", "tag", "parent_tag", "anc_tags"), ["page_id", "pre"])
         .where((F.col("tag") == F.col("t_tag")) | (F.col("tag") == F.col("t_parent"))))
    return _tiers(j, {1: F.col("own") & (F.col("tag") == F.col("t_tag")), **_subtree_conditions()}).distinct()


def _tiers(j: DataFrame, conditions: dict) -> DataFrame:
    met = F.array(*[F.when(c, F.lit(t)) for t, c in conditions.items()])
    return j.select(*BKEY, F.explode(met).alias("tier"), "pre").where(F.col("tier").isNotNull())


def _equal_tiers(b: DataFrame, nt: DataFrame, page_text: DataFrame) -> DataFrame:
    """The element's whole text (white space ignored, one outer quote
    pair dropped) equals the block's joined texts.  Keys are cut from the page
    text only for elements whose tag and key length some block asks for, then
    joined on (page, key)."""
    asked = b.select("page_id", F.explode(F.array("t_tag", "t_parent")).alias("tag"),
                     F.length("all_key").alias("n")).distinct()
    keyed = (nt.select("page_id", "pre", "tag", "k0", (F.col("k1") - F.col("k0")).alias("n"))
             .join(asked, ["page_id", "tag", "n"], "left_semi")
             .join(page_text.select("page_id", "bare"), "page_id")
             .select("page_id", "pre", "tag",
                     F.substring("bare", F.col("k0") + 1, F.col("n")).alias("all_key")))
    j = b.select(*BKEY, "t_tag", "t_parent", "all_key").join(keyed, ["page_id", "all_key"])
    return _tiers(j, {5: F.col("tag") == F.col("t_tag"), 6: F.col("tag") == F.col("t_parent")})


def _first_tiers(b: DataFrame, nt: DataFrame, texts: DataFrame, dom: DataFrame) -> DataFrame:
    occ = materialize(occurrences(dom, b.select("page_id", "needle")), "wb-occ")
    # a page given more than once has several elements of one number
    again = materialize(dom.where(F.col("kind") == "doc").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("page_id"), "wb-again")
    held = b.where(F.col("needle") != "")
    hits = _path_tiers(held.join(again, "page_id", "left_anti"), occ, nt)
    rest = b.where(F.col("needle") == "").unionByName(held.join(again, "page_id", "left_semi"))
    if rest.isEmpty():
        return hits
    return hits.unionByName(_tier1(rest, occ, nt, texts)).unionByName(_subtree_tiers(rest, occ, nt))


def _target_hits(b: DataFrame, nodes: DataFrame, texts: DataFrame, page_text: DataFrame,
                 dom: DataFrame) -> DataFrame:
    nt, t = node_targets(nodes), _distinct_targets(b)
    return _first_tiers(t, nt, texts, dom).unionByName(_equal_tiers(t, nt, page_text))


def _far_pages(blocks: DataFrame, dom: DataFrame) -> DataFrame:
    """(page_id) of the pages with blocks that are not matched in one piece: long ones, ones
    with much text or many elements for many blocks, and ones given more than once, which
    have several elements of one number."""
    size = F.length("text").cast("bigint")
    docs = _docs(dom).select("page_id", F.lit(1).alias("docs"), F.greatest(size, F.length("tree") / 12).alias("work"), (
        size + F.length("wtext") + F.length("tree")).alias("size"), F.lit(0).alias("n"))
    asked = blocks.select("page_id", F.lit(0).alias("docs"), F.lit(0.0).alias("work"), F.coalesce(
        F.length(F.array_join("text_seq", ", ")), F.lit(0)).cast("bigint").alias("size"), F.lit(1).alias("n"))
    sums = docs.unionByName(asked).where(F.col("page_id").isNotNull()).groupBy("page_id").agg(
        *[F.sum(c).alias(c) for c in ("docs", "work", "size", "n")])
    return sums.where((F.col("n") > 0) & (
        (F.col("docs") > 1) | (F.col("size") > PIECE) | (F.col("work") * F.col("n") > WORK))).select("page_id")


def _docs(dom: DataFrame) -> DataFrame:
    return dom.where(F.col("kind") == "doc")


def _matched(blocks: DataFrame, dom: DataFrame, mapping: dict | None, label: str, emit: str, by_joins) -> DataFrame:
    """What ``match_pages`` emits for ordinary pages and ``by_joins`` (blocks, nodes, texts,
    page_text, dom of the others) gives for the others."""
    docs = _docs(dom)
    far = materialize(_far_pages(blocks, dom), "wb-far")
    if far.isEmpty():
        return match_pages(docs, _raw_targets(blocks, mapping, label), emit)
    near = [df.join(far, "page_id", "left_anti") for df in (docs, blocks)]
    out = match_pages(near[0], _raw_targets(near[1], mapping, label), emit)
    rows = materialize(S.unpacked(docs.join(far, "page_id", "left_semi")), "wb-far-dom", partition_by="kind")
    rest = by_joins(blocks.join(far, "page_id", "left_semi"), S.nodes(rows), S.texts(rows), S.page_text(rows), rows)
    return out.unionByName(rest.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in out.schema]))


def tier_hits(blocks: DataFrame, nodes: DataFrame, texts: DataFrame,
              page_text: DataFrame, dom: DataFrame, mapping: dict | None = None,
              label: str = "prediction") -> DataFrame:
    """R3-R8 (A6): (page_id, part, pos, tier, pre) - every hit of every
    tier for every block (``count_hits`` gives the counts without repeating
    the hits of equal blocks)."""
    def by_joins(blocks, *page):
        b = materialize(targets(blocks, mapping, label), "wb-targets")
        return _per_block(b, _target_hits(b, *page)).select(*BKEY, "tier", "pre")
    return _matched(blocks, dom, mapping, label, HITS, by_joins)


def count_hits(blocks: DataFrame, nodes: DataFrame, texts: DataFrame,
               page_text: DataFrame, dom: DataFrame, mapping: dict | None = None,
               label: str = "prediction") -> DataFrame:
    """(page_id, part, pos, n1 .. n6) of every block, counted per target."""
    def by_joins(blocks, *page):
        b = materialize(targets(blocks, mapping, label), "wb-targets")
        return _per_block(b, tier_counts(_distinct_targets(b), _target_hits(b, *page)), "left")
    return _matched(blocks, dom, mapping, label, COUNTS, by_joins)


def _decide14(n: dict) -> Column:
    return (F.when(n[1] == 1, 1).when((n[1] == 0) & (n[2] == 1), 2)
            .when(n[3] == 1, 3).when(n[4] == 1, 4))


def _resolve_targets(b: DataFrame, nodes: DataFrame, texts: DataFrame, page_text: DataFrame,
                     dom: DataFrame) -> DataFrame:
    """R9 per target: tiers 1-4 are counted for every target and decide most;
    element keys of tiers 5-6 are cut only for those still undecided."""
    nt, t = node_targets(nodes), _distinct_targets(b)
    h14 = materialize(_first_tiers(t, nt, texts, dom), "wb-hits")
    d = materialize(tier_counts(t, h14).select(
        *BKEY, _decide14({k: F.col(f"n{k}") for k in (1, 2, 3, 4)}).alias("tier")), "wb-decided")
    decided = h14.join(d.where(F.col("tier").isNotNull()), BKEY + ["tier"])
    rest = t.join(d.where(F.col("tier").isNull()).select(*BKEY), BKEY, "left_semi")
    fives = F.count_if(F.col("tier") == 5).over(Window.partitionBy(*BKEY))
    late = (_equal_tiers(rest, nt, page_text).withColumn("_n5", fives)
            .where((F.col("tier") == 5) == (F.col("_n5") == 1)))
    return decided.select(*BKEY, "tier", "pre").unionByName(late.select(*BKEY, "tier", "pre"))


def resolve_cascade(blocks: DataFrame, nodes: DataFrame, texts: DataFrame,
                    page_text: DataFrame, dom: DataFrame, mapping: dict | None = None,
                    label: str = "prediction") -> DataFrame:
    """(page_id, part, pos, tier, pre) - each block's hits of its deciding tier."""
    def by_joins(blocks, *page):
        b = materialize(targets(blocks, mapping, label), "wb-targets")
        return _per_block(b, _resolve_targets(b, *page)).select(*BKEY, "tier", "pre")
    return _matched(blocks, dom, mapping, label, RESOLVED, by_joins)


def tier_counts(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """(page_id, part, pos, n1 .. n6) - hits per tier, missing = 0."""
    c = hits.groupBy(*BKEY).pivot("tier", list(TIERS)).agg(F.count(F.lit(1)))
    out = blocks.select(*BKEY).join(c, BKEY, "left")
    return out.select(*BKEY, *[F.coalesce(F.col(str(t)), F.lit(0)).cast("bigint").alias(f"n{t}")
                               for t in TIERS])


def resolve(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """(page_id, part, pos, tier, pre) - hits of the deciding tier.

    Deciding tier = first of 1, 2 (only if tier 1 had none), 3, 4, 5 with
    exactly one hit, else 6 (whatever it found, possibly nothing)."""
    c = tier_counts(blocks, hits)
    n = {t: F.col(f"n{t}") for t in TIERS}
    decided = (F.when(n[1] == 1, 1)
               .when((n[1] == 0) & (n[2] == 1), 2)
               .when(n[3] == 1, 3).when(n[4] == 1, 4).when(n[5] == 1, 5).otherwise(6))
    d = c.select(*BKEY, decided.alias("tier"))
    return hits.join(d, BKEY + ["tier"]).select(*BKEY, "tier", "pre")


def annotate(blocks: DataFrame, nodes: DataFrame, texts: DataFrame, page_text: DataFrame,
             dom: DataFrame, mapping: dict | None = None, label: str = "prediction") -> DataFrame:
    """(page_id, pre, label) of the matched elements - later blocks
    override earlier ones.  A target carries the label of its last block, so
    hits are not repeated for equal blocks."""
    def by_joins(blocks, *page):
        b = materialize(targets(blocks, mapping, label), "wb-targets")
        at = F.struct("part", "pos")
        last = (b.groupBy("page_id", "t_part", "t_pos")
                .agg(F.max_by("label", at).alias("label"), F.max(at).alias("at"))
                .withColumnsRenamed({"t_part": "part", "t_pos": "pos"}))
        return (_resolve_targets(b, *page).join(last, BKEY)
                .groupBy("page_id", "pre").agg(F.max_by("label", "at").alias("label")))
    return _matched(blocks, dom, mapping, label, LABELS, by_joins)


def label_pages(tokens: DataFrame, nodes: DataFrame, texts: DataFrame, page_text: DataFrame,
                dom: DataFrame, blocks: DataFrame, attr: str = "predicted_label", highlight: bool = True,
                mapping: dict | None = None, label: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """R12 (A7): (page_id, html) with ``attr`` = label on matched elements
    and, when ``highlight``, the single string of positive elements wrapped
    in ``<mark>``; also returns the per-element labels.  Pages are joined to
    the block table on ``page_id`` once (no per-page scan)."""
    from contentmark.operators import render as R

    labels = materialize(annotate(blocks, nodes, texts, page_text, dom, mapping, label), "wb-labels")
    # only elements with a label have edits
    n = (nodes.join(labels.where(F.col("label").isNotNull()), ["page_id", "pre"])
         .withColumn("attrs", F.map_concat(
             F.map_filter("attrs", lambda k, v: k != F.lit(attr)),
             F.create_map(F.lit(attr), F.col("label").cast("string")))))
    edits = R.node_edits(n)
    if highlight:
        hl = R.highlight_edits(n, tokens, "label")
        edits = edits.unionByName(hl)
    return R.render(tokens, edits), labels
