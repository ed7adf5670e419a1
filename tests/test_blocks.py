"""Block table, vocabulary, padding, masks and parts (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from conftest import shredded
from contentmark.operators import blocks as B
from contentmark.operators import model as M
from contentmark.schema import PAD

TOY = [  # (pos, class_seq, tag_seq, text_seq, label)
    (0, "[]", "[body, primary headline]", "[My First Heading]", 1),
    (1, "[one my div]", "[body, division, paragraph]", "[My first paragraph.]", 1),
    (2, "[one my div]", "[body, division, quinary headline]", "[Another heading]", 1),
    (3, "[one my div]", "[body, division, anchor]", "[www.example.com]", 0),
    (4, "[]", "[body, secondary headline]", "[Last heading]", 0),
]


def toy(spark):
    rows = [("a.html", 0, *r) for r in TOY]
    df = spark.createDataFrame(rows, "page_id string, part int, pos int, class_seq string, "
                                     "tag_seq string, text_seq string, label int")
    return B.parse_sequences(df)


def test_parse_sequences(spark):
    r = toy(spark).where("pos = 2").first()
    assert r["tag_seq"] == ["body", "division", "quinary headline"]
    assert r["class_seq"] == ["one my div"]


def test_extract_blocks_from_page(spark):
    nodes, texts, _, _ = shredded(
        spark, '<html><body><h1>My First Heading</h1><div class="one my div"><p>My first paragraph.</p>'
               '<h5>Another heading</h5><a>www.example.com</a></div><h2>Last heading</h2></body></html>')
    b = B.extract_blocks(nodes, texts, label_col=None).orderBy("pos").collect()
    assert [r["tag_seq"] for r in b] == [
        ["body", "primary headline"], ["body", "division", "paragraph"],
        ["body", "division", "quinary headline"], ["body", "division", "anchor"],
        ["body", "secondary headline"]]
    assert [r["class_seq"] for r in b] == [[], ["one my div"], ["one my div"], ["one my div"], []]
    assert [r["text_seq"] for r in b] == [[t[1:-1]] for _, _, _, t, _ in TOY]


def test_fold_pad_mask_and_weights(spark):
    blocks = toy(spark)
    vocab = B.fit_vocab(blocks, 100)
    enc = B.encode(blocks, vocab, max_length=8, pad="max_length")
    s = B.make_samples(enc.select("page_id", "part", "pos", *B.ID_COLS, "label"), 7, 8).first()
    assert s["label"] == [1, 1, 1, 0, 0, 0, 0]
    assert s["mask"] == [1, 1, 1, 1, 1, 0, 0]
    assert s["features"][2][6] == [PAD] * 8
    real = {r["label"]: round(r["weight"], 4) for r in M.class_weights(blocks).collect()}
    assert real == {0: 1.25, 1: 0.8333}
    samples = B.make_samples(enc.select("page_id", "part", "pos", *B.ID_COLS, "label"), 7, 8)
    padded = {r["label"]: round(r["weight"], 4) for r in M.class_weights(M.padded_labels(samples)).collect()}
    assert padded == {0: 0.875, 1: 1.1667}


def test_unpad_inverts_pad(spark):
    blocks = toy(spark)
    enc = B.encode(blocks, B.fit_vocab(blocks, 100), max_length=6, pad="do_not_pad")
    enc = enc.select("page_id", "part", "pos", *B.ID_COLS, "label")
    back = B.explode_blocks(B.unpad(B.make_samples(enc, 9, 6)).drop("features"))
    # blocks come back in step; a block's own padding is left to the attention mask
    back = back.withColumn("text_ids", F.filter("text_ids", lambda i: i != PAD))
    a = sorted(tuple(r) for r in enc.select("page_id", "part", "pos", "text_ids", "label").collect())
    b = sorted(tuple(r) for r in back.select("page_id", "part", "pos", "text_ids", "label").collect())
    assert a == b


def test_truncation_keeps_eos(spark):
    blocks = toy(spark)
    enc = B.encode(blocks, B.fit_vocab(blocks, 100), max_length=3, pad="longest")
    for r in enc.collect():
        assert len(r["text_ids"]) == 3 and r["text_ids"][0] == 0 and r["text_ids"][-1] == 2


def test_split_parts_even(spark):
    df = spark.range(172).select(F.lit(7).alias("page_id"), F.lit(0).alias("part"),
                                 F.col("id").cast("int").alias("pos"))
    parts = B.split_parts(df, 85).groupBy("part").agg(F.count("*").alias("n"),
                                                      F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    assert sorted(tuple(r) for r in parts.collect()) == [(0, 58, 0, 57), (1, 57, 0, 56), (2, 57, 0, 56)]


def test_labeller_fit_save_load(spark, tmp_path):
    from contentmark.plans.labeller import BlockLabeler, BlockLabelerModel
    blocks = toy(spark)
    for emissions in ("nb", "lr"):
        model = BlockLabeler(vocab_size=50, max_length=8, max_blocks=3, emissions=emissions).fit(blocks)
        pred = {(r["pos0"]): r["prediction"] for r in model.transform(blocks).collect()}
        assert set(pred) == set(range(5)) and set(pred.values()) <= {0, 1}
        path = str(tmp_path / emissions)
        model.save(path)
        again = BlockLabelerModel.load(spark, path)
        assert {r["pos0"]: r["prediction"] for r in again.transform(blocks).collect()} == pred
        m = {r["metric"]: r["value"] for r in model.evaluate(blocks).collect()}
        assert len(m) == 9


def test_split_parts_keeps_input_parts_apart(spark):
    rows = [(1, part, pos, 10 * part + pos) for part, n in ((0, 5), (1, 3)) for pos in range(n)]
    b = spark.createDataFrame(rows, "page_id bigint, part int, pos int, v int")
    got = sorted((r["part"], r["pos"], r["v"]) for r in B.split_parts(b, 3).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4), (2, 0, 10), (2, 1, 11), (2, 2, 12)]


def test_encode_moves_one_number_per_token(spark):
    """Tokens are regrouped as numbers, not as rows of kind, place and id; ids keep kind and place order."""
    b = spark.createDataFrame([(7, 0, 0, ["x y", "z"], ["div", "p"], ["b a b", "q"]), (7, 0, 1, [], [], [])],
                              "page_id bigint, part int, pos int, class_seq array<string>, tag_seq array<string>, "
                              "text_seq array<string>")
    v = spark.createDataFrame([("a", 4), ("b", 5), (",", 6), ("div", 2**31 - 1), ("x", 9)], "token string, id bigint")
    e = B.encode(b, v)
    rows = {r["pos"]: r for r in e.collect()}
    assert rows[0]["text_ids"] == [0, 5, 4, 5, 6, 3, 2]
    assert rows[0]["tag_ids"] == [0, 2**31 - 1, 6, 3, 2] and rows[0]["class_ids"] == [0, 9, 3, 6, 3, 2]
    assert rows[1]["text_ids"] == rows[1]["class_ids"] == [0, 2]
    assert "collect_list(struct" not in e._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_given_twice_has_the_texts_of_both(spark, tmp_path):
    from contentmark.plans.queries import BLOCK_COLUMNS, Corpus
    pages = [(k, f"http://x.example/en/{k}", f"<body><p>a{k}<b>b</b></p></body>") for k in (0, 1, 1)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(0, "b"), (1, "b")], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = Corpus(spark, str(tmp_path), columns=BLOCK_COLUMNS).blocks().orderBy("page_id", "pos").collect()
    assert [r["text_seq"] for r in got if r["page_id"] == 0] == [["a0"], ["b"]]
    assert [r["text_seq"] for r in got if r["page_id"] == 1] == [["a1", "a1"]] * 2 + [["b", "b"]] * 2
