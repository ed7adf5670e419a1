"""Tree-building rules of the shredder (pure Python, no Spark)."""

from contentmark.operators.htmltree import shred_html


def _nodes(html):
    return [r for r in shred_html(html) if r["kind"] == "start"]


def test_roundtrip_bytes():
    src = '<!DOCTYPE html><p a=1 B>x &amp; y<br/>z</P><!-- c -->\n<b>tail'
    rows = [r for r in shred_html(src) if r["kind"] != "doc"]
    assert "".join(r["raw"] for r in rows) == src


def test_p_nests_and_open_tags_close_at_end():
    ns = _nodes("<body><p>a<p>b</body>")
    tags = [(n["tag"], n["parent"], n["depth"]) for n in ns]
    assert tags == [("body", -1, 0), ("p", 0, 1), ("p", 1, 2)]


def test_void_and_unmatched_end_tags():
    ns = _nodes("<div><br>x</br></span><p>y</p></div>")
    assert [n["tag"] for n in ns] == ["div", "br", "p"]
    assert ns[2]["parent"] == 0          # br took no children
    assert ns[0]["last"] == 2


def test_end_tag_pops_to_nearest_open():
    ns = _nodes("<div><b><i>t</div><p>u</p>")
    assert [(n["tag"], n["parent"]) for n in ns] == [("div", -1), ("b", 0), ("i", 1), ("p", -1)]


def test_script_is_raw_text_and_entities_decode():
    rows = shred_html('<script>var t="</p>";</script><p>a &amp; &quot;b&quot;</p>')
    texts = [(r["kind"], r["text"]) for r in rows if r["kind"] in ("text", "rawtext")]
    assert texts == [("rawtext", 'var t="</p>";'), ("text", 'a & "b"')]


def test_string_follows_single_children():
    ns = _nodes("<li><a>x</a></li><div>a<b>c</b></div>")
    li, a, div, b = ns
    assert li["string_i"] == a["string_i"] is not None
    assert div["string_i"] is None and b["string_i"] is not None


def test_subtree_offsets():
    rows = shred_html("<body><p>a <b>b<br>x</p> c<script>s</script></body>")
    doc = [r for r in rows if r["kind"] == "doc"][0]
    for n in (r for r in rows if r["kind"] == "start"):
        sub = doc["text"][n["c0"]:n["c1"]]
        plain = doc["own_text"][n["s0"]:n["s1"]]
        if n["tag"] == "body":
            assert sub == "a bx cs" and plain == "a bx c"
        if n["tag"] == "b":
            assert sub == "bx"      # closed implicitly by </p>
        if n["tag"] == "br":
            assert sub == ""


def test_class_tokens_and_attrs():
    n = _nodes('<div class=" x  TECO_mainContent " id=a data-k>')[0]
    assert n["classes"] == ["x", "TECO_mainContent"]
    assert n["attrs"]["id"] == "a" and n["attrs"]["data-k"] == ""


def test_skipped_markup_and_entities():
    src = "</>x<p>a</>b</p>&copy2020 &amp; &amp &#233;"
    rows = [r for r in shred_html(src) if r["kind"] != "doc"]
    assert "".join(r["raw"] for r in rows) == src
    assert [r["text"] for r in rows if r["kind"] == "text"] == ["x", "ab", "&copy2020 & & é"]
    assert [r["raw"] for r in shred_html("</>") if r["kind"] != "doc"] == ["</>"]


def test_null_and_empty_pages_keep_their_doc_row():
    for src in (None, ""):
        assert [(r["kind"], r["text"]) for r in shred_html(src)] == [("doc", "")]
