"""Sources, sinks and render round trips."""

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import pages_df, shredded
from contentmark.operators import render as R
from contentmark.operators.htmltree import shred_html
from contentmark.plans import labelers as L
from contentmark.schema import BLOCK_CSV_COLUMNS
from contentmark.sources import blocks_io as BIO
from contentmark.sources import pages as P

PIECES = ["</>", "<", "&copy2020", "&#233;", "<p>", "</p>", "<b>", "</b>", "<br>", "<div class='a b'>", "</div>", "text", " ",
          "&amp;", "<!-- c -->", "<script>x</p></script>", "<span x=1>", "</span>", "é", "\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_shred_roundtrip_property(parts):
    src = "".join(parts)
    rows = [r for r in shred_html(src) if r["kind"] != "doc"]
    assert "".join(r["raw"] for r in rows) == src
    starts = [r for r in rows if r["kind"] == "start"]
    assert [r["node"] for r in starts] == list(range(len(starts)))
    for r in starts:  # path is ancestors-or-self, last covers the subtree
        assert r["path"][-1] == r["node"] and r["last"] >= r["node"]


def test_render_identity(spark):
    htmls = ["<p>a<b>b</p>", "<!DOCTYPE html><html><body>x &amp; y</body></html>", "t"]
    _, _, tokens, _ = shredded(spark, *htmls)
    out = {r["page_id"]: r["html"] for r in R.render(tokens).collect()}
    assert [out[i] for i in range(3)] == htmls


def test_read_pages_dir_and_allowlist(spark, tmp_path):
    d = tmp_path / "html"
    d.mkdir()
    (d / "a.html").write_text("<p>a</p>\n<p>b</p>")
    (d / "b.html").write_text("<p>c</p>")
    pages = P.read_pages(spark, str(d))
    assert {r["filename"]: r["html"] for r in pages.collect()} == {
        "a.html": "<p>a</p>\n<p>b</p>", "b.html": "<p>c</p>"}
    (tmp_path / "l1.txt").write_text(" a.html \n")
    (tmp_path / "l2.txt").write_text("zz.html\n")
    names = P.read_name_lists(spark, [str(tmp_path / "l1.txt"), str(tmp_path / "l2.txt")])
    assert [r["filename"] for r in P.select_pages(pages, names).collect()] == ["a.html"]
    assert [r["filename"] for r in P.missing_pages(pages, names).collect()] == ["zz.html"]


def test_csv_roundtrips(spark, tmp_path):
    pages = pages_df(spark, 'a "quoted", \n multi-line', "<p>x</p>").withColumnRenamed("page_id", "filename")
    P.pages_to_csv(pages, str(tmp_path / "c"))
    back = P.read_pages_csv(spark, str(tmp_path / "c"))
    assert sorted(r["html"] for r in back.collect()) == sorted(r["html"] for r in pages.collect())
    blocks = spark.createDataFrame([(1, 0, 0, ["a", "b"], 1, 0)],
                                   "page_id bigint, part int, pos int, tag_seq array<string>, label int, prediction int")
    BIO.write_blocks(blocks, str(tmp_path / "b"), with_ids=False)
    r = BIO.read_blocks(spark, str(tmp_path / "b")).first()
    assert r["tag_seq"] == "[a, b]" and r["prediction"] == 0 and r["page_id"] == "1"


def test_read_blocks_unions_differing_columns(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text('html/originalId,html/part,html/tagSequence,html/label\np1,0,"[body, paragraph]",1\n')
    b.write_text('html/originalId,html/part,html/tagSequence,html/label,postgresId\np2,0,[body],0,77\n')
    df = BIO.read_blocks(spark, [str(a), str(b)])
    rows = {r["page_id"]: r for r in df.collect()}
    assert set(df.columns) >= {"page_id", "part", "tag_seq", "label", "postgresId"}
    assert rows["p1"]["postgresId"] is None and rows["p2"]["postgresId"] == "77"
    assert rows["p1"]["tag_seq"] == "[body, paragraph]"


def test_attach_and_audit(spark):
    from contentmark.operators import align as A
    blocks = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "page_id long, part int, pos int")
    preds = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 2, 0)], "page_id long, part int, pos int, prediction int")
    got = sorted(tuple(r) for r in A.attach(blocks, preds).collect())
    assert got == [(1, 0, 0, 1), (1, 0, 1, None)]
    audit = sorted(tuple(r) for r in A.attach_audit(blocks, preds).collect())
    assert audit == [(1, 0, 1, "block"), (1, 0, 2, "prediction")]


def test_spread_only_when_few_splits(spark):
    from contentmark.session import spread
    n = spark.sparkContext.defaultParallelism * 2
    small = spark.range(10).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == n
    big = spark.range(10).repartition(n + 3)
    assert spread(big).rdd.getNumPartitions() == n + 3


def test_string_keys_and_empty_pages_survive_labelling(spark):
    pages = spark.createDataFrame([("a.html", "<div><span l='1'> Hi &amp; x </span><i>z</i></div>"),
                                   ("b.html", None), ("c.html", ""), ("d.html", "</>")],
                                  "filename string, html string")
    got = {r["page_id"]: r["html"] for r in L.label_corpus(
        pages, lambda n, t: L.label_by_attr(n, t, "l")).collect()}
    assert got == {"a.html": '<div CASM_main_content_label="1">Hi &amp; x<i>z</i></div>',
                   "b.html": "", "c.html": "", "d.html": "</>"}


def test_contract_csv_without_pos_gets_line_order(spark, tmp_path):
    f = tmp_path / "blocks.csv"
    rows = [f"{d},{p},[c],[p],[t{k}],0" for k, (d, p) in enumerate([(1, 0), (1, 0), (2, 0), (1, 1), (1, 0)])]
    names = {v: k for k, v in BLOCK_CSV_COLUMNS.items()}
    head = ",".join(names[c] for c in ("page_id", "part", "class_seq", "tag_seq", "text_seq", "label"))
    f.write_text(head + "\n" + "\n".join(rows) + "\n")
    got = {r["text_seq"]: (r["page_id"], r["part"], r["pos"]) for r in BIO.read_blocks(spark, str(f)).collect()}
    assert got == {"[t0]": ("1", 0, 0), "[t1]": ("1", 0, 1), "[t2]": ("2", 0, 0),
                   "[t3]": ("1", 1, 0), "[t4]": ("1", 0, 2)}


def test_read_pages_decodes_bytes(spark, tmp_path):
    d = tmp_path / "bytes"
    d.mkdir()
    meta = '<meta http-equiv="Content-Type" content="text/html; charset={}">'
    want = {"utf8.html": ("<p>é</p>", "utf-8"), "cp1252.html": ("<p>\u201cé\u201d</p>", "cp1252"),
            "declared.html": (meta.format("koi8-r") + "<p>да</p>", "koi8-r"),
            "short.html": ("<meta charset='shift_jis'><p>日本</p>", "shift_jis"),
            "unknown.html": (meta.format("no-such") + "é", "utf-8")}
    for name, (text, enc) in want.items():
        (d / name).write_bytes(text.encode(enc))
    (d / "mark.html").write_bytes("\ufeff<p>x</p>".encode("utf-16-le"))
    got = {r["filename"]: r["html"] for r in P.read_pages(spark, str(d)).collect()}
    assert got == {k: t for k, (t, _) in want.items()} | {"mark.html": "<p>x</p>"}


def test_windows_1252_needs_no_session_flag(spark):
    from contentmark.sources.gold import decode_gold_bytes
    raw = [bytes([i]) for i in range(0x80, 0x100) if bytes([i]).decode("cp1252", "ignore")]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b binary")
    got = [r[0] for r in df.select(decode_gold_bytes(df["b"])).collect()]
    assert got == [b.decode("cp1252") for b in raw]
