"""Node operators on intervals: against ancestor lists, and on very deep pages."""

import random
import time

from conftest import pages_df, shredded

from contentmark.operators import nodes as N
from contentmark.operators import shred as S
from contentmark.operators.htmltree import page_rows, shred_html

PIECES = ["<div>", "</div>", "<p>", "</p>", "<span>", "</span>", "<span a=1>", "t", "<br>", "</i>"]


def random_pages(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(40)) for _ in range(n)]


def starts(html):
    return [r for r in shred_html(html) if r["kind"] == "start"]


def test_marks_and_ancestor_equal_the_ancestor_lists(spark):
    pages = random_pages(40, 3)
    nodes, *_ = shredded(spark, *pages)
    nodes = nodes.drop(*S.PATHS)
    seeds = nodes.where("tag = 'p'").select("page_id", "pre")
    lca = N.common_ancestor(nodes, seeds)
    marked = {(r["page_id"], r["pre"]): r["is_main"] for r in N.mark_subtrees(nodes, seeds.union(seeds)).collect()}
    blocks = {(r["page_id"], r["pre"]): r["is_main"] for r in N.mark_block(nodes, lca).collect()}
    bare = N.mark_block(nodes, lca.drop("lca_last"))
    assert blocks == {(r["page_id"], r["pre"]): r["is_main"] for r in bare.collect()}
    bad = {r["page_id"]: r["n"] for r in N.contradictions(nodes, lca, "a", N.attr_equals("a", 1)).collect()}
    tops = {r["page_id"]: r["lca"] for r in lca.collect()}
    for pid, html in enumerate(pages):
        rows = starts(html)
        ps = [r["path"] for r in rows if r["tag"] == "p"]
        common = set(ps[0]).intersection(*ps) if ps else set()
        top = max(common) if common else None
        assert (pid in tops) == bool(ps) and tops.get(pid) == top
        below = [r for r in rows if top in r["path"]]
        assert bad.get(pid, 0) == sum(r["attrs"].get("a") == "1" and r["node"] != top for r in below)
        for r in rows:
            assert marked[pid, r["node"]] == any(rows[a]["tag"] == "p" for a in r["path"])
            assert blocks[pid, r["node"]] == (top in r["path"])


def test_unwrap_equals_filtered_ancestor_lists(spark):
    pages = random_pages(40, 5)
    nodes, texts, *_ = shredded(spark, *pages)
    out, moved = N.unwrap_spans(nodes, texts, None)
    got = {(r["page_id"], r["pre"]): (r["parent"], r["depth"]) for r in out.collect()}
    owner = {(r["page_id"], r["i"]): r["node"] for r in moved.collect()}
    want, runs = {}, {}
    for pid, html in enumerate(pages):
        rows = starts(html)

        def kept(r):
            return [-1] + [a for a in r["path"] if rows[a]["tag"] != "span"]
        for r in rows:
            if r["tag"] != "span":
                want[pid, r["node"]] = (kept(r)[-2], len(kept(r)) - 2)
        for r in shred_html(html):
            if r["kind"] == "text" and r["node"] is not None:
                runs[pid, r["i"]] = kept(r)[-1]
    assert got == want and owner == runs
    assert not set(S.PATHS) & set(out.columns)


def test_very_deep_page_is_linear_without_paths(spark):
    deep = 20_000
    html = "<body>" + "<p>x" * deep + "</q>" * deep
    t = time.perf_counter()
    rows = list(page_rows(html, paths=False))
    assert time.perf_counter() - t < 20 and rows[deep]["kind"] in ("start", "text")
    dom = S.shred(pages_df(spark, html), columns=S.TREE).cache()
    assert not set(S.PATHS) & set(dom.columns)
    nodes = S.nodes(dom)
    assert nodes.agg({"depth": "max"}).first()[0] == deep
    seeds = nodes.where("pre in (9000, 15000)").select("page_id", "pre")
    lca = N.common_ancestor(nodes, seeds)
    assert lca.first()["lca"] == 9000
    assert N.mark_subtrees(nodes, seeds).agg({"is_main": "sum"}).first()[0] == deep + 1 - 9000
    wide = S.nodes(S.shred(pages_df(spark, html), columns=S.NO_PATHS))
    out, _ = N.unwrap_spans(wide, S.texts(dom), None, tag="p")
    assert [(r["tag"], r["depth"]) for r in out.collect()] == [("body", 0)]


def test_batches_of_deep_pages_are_bounded_by_path_entries():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "html": ["<p>" * 2_500]})
    wanted = {"kind", "node", "path"}
    out = list(S._shred_batches([batch], wanted))
    assert len(out) >= 3 and sum(b.num_rows for b in out) == 2_501
    assert all(sum(len(p or ()) for p in b.column("path").to_pylist()) <= S._CELLS_PER_BATCH + 2_500 for b in out)
