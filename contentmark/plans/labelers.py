"""Labelling recipes - compositions of node / alignment operators.

Each recipe takes the node table (and texts / gold where needed) and returns
nodes with ``is_main`` (plus edited ``classes`` / ``attrs``); ``label_corpus``
applies any recipe to shredded pages and renders the edited HTML.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmark.operators import align as A
from contentmark.operators import nodes as N

# Annotation marks of the class-annotated corpus format.
MAIN_CONTENT_CLASS = "TECO_mainContent"
ANNOTATION_CLASSES = ("TECO_mainContent", "TECO_notTemplate", "TECO_mainMenu")
# Fixed value: label attribute of the attribute-annotated corpus format.
LABEL_ATTR = "__boilernet_label"


def label_by_class(nodes: DataFrame, main_class: str = MAIN_CONTENT_CLASS,
                   drop=ANNOTATION_CLASSES) -> DataFrame:
    """L1: class-annotated pages: subtrees of ``main_class`` elements are
    main; the annotation classes are removed."""
    seeds = N.by_class(nodes, main_class).select("page_id", "pre")
    out = N.mark_subtrees(nodes, seeds)
    for c in drop:
        out = N.remove_class(out, c)
    return out


def label_by_attr(nodes: DataFrame, texts: DataFrame, attr: str = LABEL_ATTR):
    """L2: attribute-annotated pages, node level: subtrees of ``attr`` = 1
    elements are main; annotation spans unwrapped; the attribute dropped.
    Returns (nodes, texts)."""
    seeds = N.by_attr(nodes, attr, 1).select("page_id", "pre")
    marked = N.mark_subtrees(nodes, seeds)
    out, t = N.unwrap_spans(marked, texts, attr)
    return N.remove_attr(out, attr), t


def label_block_by_attr(nodes: DataFrame, texts: DataFrame, attr: str = LABEL_ATTR):
    """L3: attribute-annotated pages, block level: everything under the LCA
    of the ``attr`` = 1 elements is main.  Returns (nodes, texts,
    contradictions) - the last lists pages whose block holds 0-labels."""
    seeds = N.by_attr(nodes, attr, 1).select("page_id", "pre")
    lca = N.common_ancestor(nodes, seeds)
    marked = N.mark_block(nodes, lca)
    bad = N.contradictions(nodes, lca, attr)
    out, t = N.unwrap_spans(marked, texts, attr)
    return N.remove_attr(out, attr), t, bad


def label_by_text(nodes: DataFrame, texts: DataFrame, gold: DataFrame) -> DataFrame:
    """L4: gold-text pages, node level: elements owning a text run equal to
    a gold line (and their subtrees) are main."""
    seeds = A.owners(A.align(texts, A.distinct_lines(gold)))
    return N.mark_subtrees(nodes, seeds)


def label_block_by_text(nodes: DataFrame, texts: DataFrame, gold: DataFrame, within: str | None = None) -> DataFrame:
    """Gold-text pages, block level: everything under the LCA of the
    aligned elements is main.  ``within`` (e.g. ``"body"``) restricts the
    seeds to that element's subtree; the default keeps every hit, title
    included, as the reference does."""
    seeds = A.owners(A.align(texts, A.distinct_lines(gold)))
    if within:
        inside = N.mark_subtrees(nodes.select("page_id", "pre", "last"),
                                 nodes.where(F.col("tag") == within), "_in").where("_in = 1")
        seeds = seeds.join(inside, ["page_id", "pre"], "left_semi")
    return N.mark_block(nodes, N.common_ancestor(nodes, seeds))


def label_corpus(pages: DataFrame, recipe: Callable) -> DataFrame:
    """Run a recipe over a whole corpus and render the labelled pages.

    ``recipe(nodes, texts)`` gives nodes with ``is_main``, or a tuple of such
    nodes and edited texts (and more, not used here).  The main label attribute
    is written on marked elements; tags of elements the recipe removed go and
    texts it edited are re-encoded: (page_id, html).  Pages without markup are
    kept as they are, null ones as empty."""
    from contentmark.operators import render as R
    from contentmark.operators import shred as S
    from contentmark.session import materialize

    dom = materialize(S.shred(pages, columns=S.NO_PATHS), "dom", partition_by="kind")
    out = recipe(S.nodes(dom), S.texts(dom))
    n, t = out[:2] if isinstance(out, tuple) else (out, None)
    edits = R.node_edits(N.main_attr(n))
    if t is not None:
        edits = (edits.unionByName(R.removed_tags(S.nodes(dom), n))
                 .unionByName(R.text_edits(S.texts(dom), t)))
    return R.render(S.tokens(dom), edits)
