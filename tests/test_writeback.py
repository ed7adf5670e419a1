"""Write-back tier cascade (FIXTURES.md section 5)."""

from conftest import shredded_dom
from contentmark.operators import writeback as WB

CASES = [
    ("<body><h1>T</h1><p>T</p></body>", ["body", "primary headline"], ["T"], 1, ["h1"]),
    ("<body><p><b>T</b></p></body>", ["body", "paragraph", "i"], ["T"], 2, ["p"]),
    ("<body><div><p>T</p></div><ul><li><p>T</p></li></ul></body>",
     ["body", "division", "paragraph"], ["T"], 3, ["p"]),
    ("<body><p>T</p></body>", ["paragraph"], ["Z"], 6, []),
]


def test_tiers(spark):
    for html, tags, txt, tier, hit_tags in CASES:
        nodes, texts, tokens, page_text, dom = shredded_dom(spark, html)
        blocks = spark.createDataFrame([(0, 0, 0, tags, txt, 1)],
                                       "page_id bigint, part int, pos int, tag_seq array<string>, "
                                       "text_seq array<string>, prediction int")
        hits = WB.tier_hits(blocks, nodes, texts, page_text, dom)
        res = WB.resolve(blocks, hits).collect()
        cas = WB.resolve_cascade(blocks, nodes, texts, page_text, dom).collect()
        assert sorted(tuple(r) for r in cas) == sorted(tuple(r) for r in res)
        tag_of = {r["pre"]: r["tag"] for r in nodes.collect()}
        assert sorted(tag_of[r["pre"]] for r in res) == hit_tags, html
        if res:
            assert {r["tier"] for r in res} == {tier}
        if tier == 3:
            parent = [r for r in res][0]["pre"]
            assert tag_of[parent - 1] == "div"


def test_label_pages_highlight(spark):
    nodes, texts, tokens, page_text, dom = shredded_dom(spark, "<body><h1>T</h1><p>U</p></body>")
    blocks = spark.createDataFrame([(0, 0, 0, ["body", "primary headline"], ["T"], 1),
                                    (0, 0, 1, ["body", "paragraph"], ["U"], 0)],
                                   "page_id bigint, part int, pos int, tag_seq array<string>, "
                                   "text_seq array<string>, prediction int")
    html, labels = WB.label_pages(tokens, nodes, texts, page_text, dom, blocks)
    assert html.first()["html"] == ('<body><h1 predicted_label="1"><mark>T</mark></h1>'
                                    '<p predicted_label="0">U</p></body>')


def test_needle_across_runs_and_empty(spark):
    # "a b" spans the text of <p> and <i>: only subtree tiers can see it
    nodes, texts, tokens, page_text, dom = shredded_dom(spark, "<body><div><p>a <i>b</i></p></div></body>")
    blocks = spark.createDataFrame([(0, 0, 0, ["body", "division", "paragraph"], ["a b"], 1),
                                    (0, 0, 1, ["body", "division", "paragraph"], [""], 1)],
                                   "page_id bigint, part int, pos int, tag_seq array<string>, "
                                   "text_seq array<string>, prediction int")
    hits = WB.tier_hits(blocks, nodes, texts, page_text, dom)
    got = sorted((r["pos"], r["tier"], r["pre"]) for r in hits.collect())
    # pre: body 0, div 1, p 2, i 3
    assert (0, 1, 2) not in got and (0, 2, 1) in got and (0, 3, 2) in got and (0, 4, 2) in got
    assert (1, 1, 2) in got and (1, 2, 1) in got


def test_tier5_equality_ignores_space_and_outer_quotes(spark):
    nodes, texts, tokens, page_text, dom = shredded_dom(
        spark, '<body><div><p>"A</p><p>b  c"</p></div><p>x</p></body>')
    blocks = spark.createDataFrame([(0, 0, 0, ["body", "division"], ['"A b c"'], 1)],
                                   "page_id bigint, part int, pos int, tag_seq array<string>, "
                                   "text_seq array<string>, prediction int")
    res = WB.resolve_cascade(blocks, nodes, texts, page_text, dom).collect()
    tag_of = {r["pre"]: r["tag"] for r in nodes.collect()}
    assert [(r["tier"], tag_of[r["pre"]]) for r in res] == [(5, "div")]


def test_occurrences_match_brute_force(spark):
    """Runs holding each needle and elements whose subtree text holds it
    equal a direct search over the pages."""
    import random

    from contentmark.operators import shred as S
    from contentmark.operators.htmltree import shred_html
    from contentmark.operators.textscan import occurrences

    rnd = random.Random(5)
    pieces = ["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "ab", "ba", "a", " ", "b", "\\E.", "\U0001f600"]
    needles = ["ab", "a b", "b", "aba", "aa", "\\E", ".", "\U0001f600b", "b\\E."]
    pages = {k: "<body>" + "".join(rnd.choice(pieces) for _ in range(30)) + "</body>" for k in range(40)}
    dom = S.shred(spark.createDataFrame(list(pages.items()), "page_id bigint, html string"))
    nd = spark.createDataFrame([(k, n) for k in pages for n in needles + [""]], "page_id bigint, needle string")
    got_runs, got_cover = set(), set()
    for h in occurrences(dom, nd).collect():
        if h["run_i"] is not None:
            got_runs.add((h["page_id"], h["needle"], h["run_i"]))
        got_cover |= {(h["page_id"], h["needle"], p) for p in h["cover"]}
    want_runs, want_cover = set(), set()
    for k, html in pages.items():
        rows = shred_html(html)
        doc = [r for r in rows if r["kind"] == "doc"][0]
        for n in needles:
            want_runs |= {(k, n, r["i"]) for r in rows if r["kind"] in ("text", "rawtext") and n in r["text"]}
            want_cover |= {(k, n, r["node"]) for r in rows if r["kind"] == "start"
                           and n in doc["text"][r["c0"]:r["c1"]]}
    assert got_runs == want_runs
    assert got_cover == want_cover


def test_equal_items_resolve_linearly(spark):
    """Equal blocks share one target: its hits grow with the items, not their square."""
    n = 400
    html = "<body><ul>" + "<li>Home</li>" * n + "</ul></body>"
    nodes, texts, tokens, page_text, dom = shredded_dom(spark, html)
    blocks = spark.createDataFrame(
        [(0, 0, k, ["body", "list", "item"], ["Home"], k % 2) for k in range(n)],
        "page_id bigint, part int, pos int, tag_seq array<string>, text_seq array<string>, prediction int")
    b = WB.targets(blocks)
    assert WB._distinct_targets(b).count() == 1
    assert WB._target_hits(b, nodes, texts, page_text, dom).count() <= 4 * n
    counts = WB.count_hits(blocks, nodes, texts, page_text, dom)
    assert counts.count() == n and counts.select("n1", "n5").distinct().count() == 1


def test_tiers_on_the_columns_they_read(spark):
    """A token table cut to the columns that write-back names gives every tier the
    hits of the plain joins (``_tier1``, ``_subtree_tiers``) on the whole table,
    for random trees, a page given twice and empty needles."""
    import random

    from contentmark.operators import shred as S
    from contentmark.plans.queries import MATCH_COLUMNS
    rnd = random.Random(5)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(["a", "b", "a b", "b a"])
        tag = rnd.choice(["p", "div", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randint(1, 3))) + f"</{tag}>"
    pages = [(k, "<body>" + tree(5) + tree(5) + "</body>") for k in range(6)]
    df = spark.createDataFrame(pages + pages[:1], "page_id bigint, html string")
    blocks = [(k, 0, i, [rnd.choice(["body", "paragraph", "division", "b"]) for _ in range(rnd.randint(1, 4))],
               [rnd.choice(["a", "b", "a b", "ab", "", "ba b"])], 1) for k in range(6) for i in range(8)]
    blocks = spark.createDataFrame(blocks, "page_id bigint, part int, pos int, tag_seq array<string>, "
                                           "text_seq array<string>, prediction int")
    cut, whole = S.shred(df, columns=MATCH_COLUMNS), S.shred(df)
    got = WB.tier_hits(blocks, S.nodes(cut), S.texts(cut), S.page_text(cut), cut)
    b, nt = WB.targets(blocks), WB.node_targets(S.nodes(whole))
    t = WB._distinct_targets(b)
    occ = WB.occurrences(whole, t.select("page_id", "needle"))
    want = (WB._tier1(t, occ, nt, S.texts(whole)).unionByName(WB._subtree_tiers(t, occ, nt))
            .unionByName(WB._equal_tiers(t, nt, S.page_text(whole))))
    want = WB._per_block(b, want).select(*WB.BKEY, "tier", "pre")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["tier"] for r in got.collect()} >= {1, 2, 3, 4}


def _random_corpus(spark, seed):
    import random

    rnd = random.Random(seed)
    pieces = ["<p>", "</p>", "<b class='k l'>", "</b>", "<div>", "</div>", "<ul><li>", "</ul>", "ab", "a", " ", " b", '"',
              "<script>a</script>", "<br>", "\U0001f600", "</body>", "<body class='m'>"]
    pages = [(k, "<body>" + "".join(rnd.choice(pieces) for _ in range(40)) + "</body>") for k in range(25)]
    tags = ["body", "paragraph", "division", "b", "list item", "unordered list", None]
    words = ["a", "b", "ab", "a b", "", "aab", '"', '"ab"', 'b"\n', "\U0001f600", "a b", None]
    blocks = [(k, rnd.randint(0, 1), i, rnd.choice([None, [rnd.choice(tags) for _ in range(rnd.randint(0, 4))]])
               if rnd.random() < 0.1 else [rnd.choice(tags[:-1]) for _ in range(rnd.randint(1, 4))],
               [rnd.choice(words) for _ in range(rnd.randint(0, 2))], rnd.randint(0, 1))
              for k in range(27) for i in range(12)]
    return pages, spark.createDataFrame(blocks, "page_id bigint, part int, pos int, tag_seq array<string>, "
                                                "text_seq array<string>, prediction int")


def test_ordinary_pages_are_matched_without_joins(spark, monkeypatch):
    """Page by page, every step gives the rows of the joins that larger pages go by."""
    from contentmark.operators import shred as S
    from contentmark.plans.queries import MATCH_COLUMNS

    pages, blocks = _random_corpus(spark, 3)
    dom = S.shred(spark.createDataFrame(pages, "page_id bigint, html string"), columns=MATCH_COLUMNS).cache()
    args = (blocks, S.nodes(dom), S.texts(dom), S.page_text(dom), dom)

    def rows():
        return [sorted(map(tuple, f(*args).collect()), key=repr)
                for f in (WB.tier_hits, WB.count_hits, WB.resolve_cascade, WB.annotate)]

    with monkeypatch.context() as m:
        m.setattr(WB, "PIECE", 0)
        joined = rows()
    with monkeypatch.context() as m:
        m.setattr(WB, "WORK", 500)      # some pages by the joins, some page by page
        mixed = rows()
    monkeypatch.setattr(WB, "occurrences", None)
    got = rows()
    assert got == joined == mixed
    assert {r[3] for r in got[0]} == {1, 2, 3, 4, 5, 6} and len(got[3]) > 50


def test_blocks_from_the_shredder_equal_regrouped_runs(spark):
    from contentmark.functions.text import normalize_ws
    from contentmark.operators import blocks as B
    from contentmark.operators import shred as S

    pages, _ = _random_corpus(spark, 4)
    dom = S.shred(spark.createDataFrame(pages + [(99, None), (None, "<body>x")], "page_id bigint, html string")).cache()
    nodes, texts = S.nodes(dom), S.texts(dom)
    got, want = (sorted(map(tuple, B.extract_blocks(nodes, t).collect()), key=repr) for t in (None, texts))
    assert got == want and len(got) > 50
    runs = texts.selectExpr("coalesce(norm, text) as a", "*").withColumn("b", normalize_ws("text"))
    assert runs.where("a != b").count() == 0 and runs.where("norm is not null").count() > 0


def test_a_deep_page_of_repeats_takes_no_cubic_time():
    """Many equal texts on unclosed elements: each target has many occurrences, all of them
    below each other, on paths of many elements."""
    import time

    from contentmark.operators.htmltree import FACTS, page_rows
    from contentmark.operators.pagematch import Page
    n = 300
    rows = list(page_rows("<body>" + "<p>Home" * n + "<b>Home</b>" * n, (), FACTS))
    page = Page(*(rows[-1][c] for c in ("text", "wtext", "tree", "tags")))
    t = time.perf_counter()
    for r in rows:
        if r.get("text_seq"):
            chain = tuple(r["tag_seq"])
            hits = page.every_tier((chain[-1], chain[-2], chain, r["text_seq"][0], "Home"))
            k = len(chain) - 2      # paragraphs above
            want = {1: n, 2: n if k else 1, 3: n - (chain[-1] == "p"), 4: n - k if chain[-1] == "p" else n}
            if chain[-1] == "p" and not k:      # the only one right below body
                want[3] = 1
            assert {tier: sum(x == tier for x, _ in hits) for tier in want} == want
    assert time.perf_counter() - t < 20


def test_repeated_gold_lines_meet_a_run_once(spark):
    from contentmark.operators import align as A
    from contentmark.operators import shred as S

    dom = S.shred(spark.createDataFrame([(0, "<p>" + "<b>a</b>" * 20)], "page_id bigint, html string"))
    gold = spark.createDataFrame([(0, k, " a" if k % 2 else "a") for k in range(20)],
                                 "page_id bigint, line_no int, text string")
    hits = A.align(S.texts(dom), A.distinct_lines(gold))
    assert hits.count() == 20 and A.align(S.texts(dom), gold).count() == 400
    assert A.owners(hits).exceptAll(A.owners(A.align(S.texts(dom), gold))).count() == 0
