"""Hand-made annotation pages (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from conftest import shredded
from contentmark.operators import nodes as N
from contentmark.operators import render as R
from contentmark.plans import labelers as L
from contentmark.sources import gold as G


def _main(df):
    return sorted((r["tag"], r["is_main"]) for r in df.select("tag", "is_main").collect())


def test_class_marks(spark):
    nodes, texts, tokens, _ = shredded(spark, '<body><div class="x TECO_mainContent"><p>a</p></div>'
                                              '<div class="TECO_mainMenu"><p>b</p></div></body>')
    out = L.label_by_class(nodes).orderBy("pre").collect()
    assert [(r["tag"], r["is_main"], r["classes"]) for r in out] == [
        ("body", 0, []), ("div", 1, ["x"]), ("p", 1, []), ("div", 0, []), ("p", 0, [])]
    html = R.render(tokens, R.node_edits(N.main_attr(L.label_by_class(nodes)))).first()["html"]
    assert html == ('<body><div class="x" CASM_main_content_label="1"><p CASM_main_content_label="1">a</p>'
                    '</div><div class=""><p>b</p></div></body>')


def test_attribute_marks_unwrap(spark):
    nodes, texts, tokens, _ = shredded(
        spark, '<body><p><span __boilernet_label="1"> Hi </span></p><p><span __boilernet_label="0">ad</span></p></body>')
    n, t = L.label_by_attr(nodes, texts)
    assert _main(n) == [("body", 0), ("p", 0), ("p", 1)]
    assert sorted(r["text"] for r in t.collect()) == ["Hi", "ad"]
    assert n.where("tag = 'span'").count() == 0


def test_attribute_marks_non_span(spark):
    nodes, texts, _, _ = shredded(spark, '<body><h1 __boilernet_label="1">T</h1></body>')
    n, _ = L.label_by_attr(nodes, texts)
    rows = {r["tag"]: r for r in n.collect()}
    assert rows["h1"]["is_main"] == 1 and "__boilernet_label" not in rows["h1"]["attrs"]


def test_nested_label(spark):
    nodes, texts, _, _ = shredded(
        spark, '<body><div><span __boilernet_label="1"><span __boilernet_label="0">x</span></span></div></body>')
    n, _ = L.label_by_attr(nodes, texts)
    assert _main(n) == [("body", 0), ("div", 1)]


def test_block_level_and_contradiction(spark):
    nodes, texts, _, _ = shredded(
        spark, '<body><div><p><span __boilernet_label="1">a</span></p><p><span __boilernet_label="0">ad</span></p>'
               '<p><span __boilernet_label="1">b</span></p></div><p><span __boilernet_label="0">c</span></p></body>')
    n, _, bad = L.label_block_by_attr(nodes, texts)
    assert _main(n) == [("body", 0), ("div", 1), ("p", 0), ("p", 1), ("p", 1), ("p", 1)]
    assert [(r["page_id"], r["n"]) for r in bad.collect()] == [(0, 1)]


def _lca_tag(spark, html):
    nodes, _, _, _ = shredded(spark, html)
    seeds = N.by_attr(nodes, L.LABEL_ATTR, 1).select("page_id", "pre", "path")
    lca = N.lowest_common_ancestor(seeds).collect()
    if not lca:
        return None
    return nodes.where(F.col("pre") == lca[0]["lca"]).first()["tag"]


def test_lca_identity_zero_and_one_seed(spark):
    assert _lca_tag(spark, '<body><div><p><span __boilernet_label="1">s</span></p></div>'
                           '<div><p><span __boilernet_label="1">s</span></p></div></body>') == "body"
    assert _lca_tag(spark, "<body><p>a</p></body>") is None
    assert _lca_tag(spark, '<body><p __boilernet_label="1">a</p></body>') == "p"


GOLD = "First line\n\nSecond line\n!@#$%^&*()  COMMENTS\nnoise\n"
PAGE = "<body><div><p>First  line</p><p>Second line</p></div><p>noise</p></body>"


def _gold(spark, include_comments):
    docs = spark.createDataFrame([(0, GOLD)], "page_id bigint, text string")
    return G.gold_lines(docs, "page_id", "text", include_comments)


def test_gold_lines_cut(spark):
    assert [r["text"] for r in _gold(spark, False).orderBy("line_no").collect()] == [
        "First line", "Second line"]
    assert len(_gold(spark, True).collect()) == 4


def test_gold_text_node_and_block(spark):
    nodes, texts, _, _ = shredded(spark, PAGE)
    # "First  line" equals the gold line after white space is normalised
    l4 = L.label_by_text(nodes, texts, _gold(spark, False))
    assert sorted(r["pre"] for r in l4.where("is_main = 1").collect()) == [2, 3]
    l5 = L.label_block_by_text(nodes, texts, _gold(spark, False))
    assert sorted(r["pre"] for r in l5.where("is_main = 1").collect()) == [1, 2, 3]
    l5c = L.label_block_by_text(nodes, texts, _gold(spark, True))
    assert sorted(r["pre"] for r in l5c.where("is_main = 1").collect()) == [0, 1, 2, 3, 4]


def test_gold_normalised_match(spark):
    nodes, texts, _, _ = shredded(spark, "<body><div><p>First\n line</p><p>Second line</p></div></body>")
    g = spark.createDataFrame([(0, 0, "First line"), (0, 1, "Second line")], "page_id bigint, line_no int, text string")
    l5 = L.label_block_by_text(nodes, texts, g)
    assert sorted(r["tag"] for r in l5.where("is_main = 1").collect()) == ["div", "p", "p"]


def test_gold_encoding_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\x93a\x94\n")
    (tmp_path / "b.txt").write_bytes("café\n".encode("utf-8"))
    rows = {r["file_name"]: r["text"] for r in G.read_gold_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "“a”", "b.txt": "café"}


def test_lca_property_random_trees(spark):
    """LCA = deepest element containing every seed (brute force on random pages)."""
    import random

    from contentmark.operators.htmltree import shred_html

    rnd = random.Random(11)
    pieces = ["<div>", "</div>", "<p>", "</p>", "<b>", "t", "<i>", "</i>"]
    htmls, expect = [], {}
    for pid in range(30):
        html = "<body>" + "".join(rnd.choice(pieces) for _ in range(30)) + "</body>"
        rows = [r for r in shred_html(html) if r["kind"] == "start"]
        seeds = rnd.sample(range(len(rows)), k=min(len(rows), rnd.randint(1, 4)))
        paths = [rows[s]["path"] for s in seeds]
        common = [a for a in paths[0] if all(a in p for p in paths)]
        expect[pid] = (max(common), seeds)
        htmls.append(html)
    nodes, _, _, _ = shredded(spark, *htmls)
    seed_rows = [(pid, s) for pid, (_, ss) in expect.items() for s in ss]
    sdf = spark.createDataFrame(seed_rows, "page_id bigint, pre int").join(
        nodes.select("page_id", "pre", "path"), ["page_id", "pre"])
    got = {r["page_id"]: r["lca"] for r in N.lowest_common_ancestor(sdf).collect()}
    assert got == {pid: e[0] for pid, e in expect.items()}


def test_block_within_body(spark):
    nodes, texts, _, _ = shredded(spark, "<html><head><title>T</title></head><body><div><p>A</p>"
                                         "<p>B</p></div><p>c</p></body></html>")
    gold = spark.createDataFrame([(0, 0, "T"), (0, 1, "A"), (0, 2, "B")],
                                 "page_id bigint, line_no int, text string")
    everywhere = L.label_block_by_text(nodes, texts, gold)
    in_body = L.label_block_by_text(nodes, texts, gold, within="body")
    # the title matches too, so without a scope the block is the whole page
    assert {r["tag"] for r in everywhere.where("is_main = 1").collect()} >= {"html", "title", "body"}
    assert sorted(r["tag"] for r in in_body.where("is_main = 1").collect()) == ["div", "p", "p"]
