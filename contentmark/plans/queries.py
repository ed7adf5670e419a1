"""Registered queries: one callable (spark, sf_dir) -> DataFrame per
inventory item.  Every query reads the given tables (or data Spark derives
from them) whole; array outputs are rendered as strings and doubles rounded
so the DuckDB oracles compare exactly."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmark.functions.tags import html_tags
from contentmark.functions.text import render_seq
from contentmark.operators import align as A
from contentmark.operators import blockfeat as BF
from contentmark.operators import blocks as B
from contentmark.operators import chain as C
from contentmark.operators import evaluate as E
from contentmark.operators import model as M
from contentmark.operators import nodes as N
from contentmark.operators import render as R
from contentmark.operators import shred as S
from contentmark.operators import tokenscore as TS
from contentmark.operators import tokenvec as TV
from contentmark.operators import vectors as V
from contentmark.operators import writeback as WB
from contentmark.plans import labelers as L
from contentmark.session import materialize, table_path
from contentmark.sources import blocks_io as BIO
from contentmark.sources import gold as G
from contentmark.sources import pages as P
from contentmark.sources.files import write_files


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# What text blocks are made of, what write-back reads, and what it edits; None: all columns.
BLOCK_COLUMNS = (*S.TREE, "norm", "text_seq", "tag_seq", "class_seq")
MATCH_COLUMNS = (*BLOCK_COLUMNS, "wtext", "tree", "tags")
EDIT_COLUMNS = (*MATCH_COLUMNS, "raw", "attrs", "classes", "string_i")


class Corpus:
    """Lazily shredded pages of one scale factor (one parse per plan)."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False, columns=S.NO_PATHS):
        self.spark, self.sf_dir, self.once, self.columns = spark, sf_dir, once, columns
        self.pages = _t(spark, sf_dir, "pages")
        self._blocks = None

    @cached_property
    def dom(self) -> DataFrame:
        """The token table.  One parse per corpus: lineage is cut so branches and
        scalar subqueries downstream read the table instead of re-parsing
        HTML; a query that reads it ``once`` needs no table."""
        columns = self.columns
        if self.repeated is not None:
            columns = (*columns, "path_tags", "path_cls")
        dom = S.shred(self.pages, columns=columns)
        return dom if self.once else materialize(dom, "dom", partition_by="kind")

    @cached_property
    def repeated(self) -> DataFrame | None:
        """(page_id) of the pages given more than once, if there are any and blocks are asked
        for: the texts of all copies of an element belong to each of its blocks."""
        if self.columns is None or "text_seq" not in self.columns:
            return None
        ids = self.pages.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
        ids = materialize(ids.where("n > 1").select("page_id"), "repeated")
        return None if ids.isEmpty() else ids

    @property
    def nodes(self) -> DataFrame:
        return S.nodes(self.dom)

    @property
    def texts(self) -> DataFrame:
        return S.texts(self.dom)

    @property
    def tokens(self) -> DataFrame:
        return S.tokens(self.dom)

    @property
    def page_text(self) -> DataFrame:
        return S.page_text(self.dom)

    def gold(self, include_comments: bool = False) -> DataFrame:
        return G.gold_for_pages(self.pages, _t(self.spark, self.sf_dir, "documents"),
                                include_comments)

    def blocks(self) -> DataFrame:
        """Text blocks labelled by the block-level gold alignment."""
        if self._blocks is None:
            labelled = L.label_block_by_text(self.nodes, self.texts, self.gold())
            if self.repeated is None:
                blocks = B.extract_blocks(labelled)
            else:
                once, more = (labelled.join(self.repeated, "page_id", how) for how in ("left_anti", "left_semi"))
                texts = self.texts.join(self.repeated, "page_id", "left_semi")
                blocks = B.extract_blocks(once).unionByName(B.extract_blocks(more, texts))
            self._blocks = materialize(blocks)
        return self._blocks


def _big(*cols):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def q_dom_nodes(spark, sf_dir):
    # the token table is read once here: no need to materialise it
    nodes = S.nodes(S.shred(_t(spark, sf_dir, "pages"), columns=(*S.TREE, "own_text")))
    return nodes.select("page_id", *_big("pre", "parent", "depth"), "tag", "own_text")


def q_label_block_by_text(spark, sf_dir):
    c = Corpus(spark, sf_dir, columns=S.TREE)
    out = L.label_block_by_text(c.nodes, c.texts, c.gold())
    return out.select("page_id", *_big("pre"), "tag", "is_main")




# --- annotated corpus derived from the given pages -------------------------
# The test pages carry no annotation marks; these queries derive an
# attribute-annotated corpus from them with Spark (every <b> becomes a
# label-1 span, the ad box and every line break get label 0), so the recipes
# run on whole tables.

def annotated_pages(pages: DataFrame) -> DataFrame:
    html = F.replace(F.replace("html", F.lit("<b>"), F.lit(f'<span {L.LABEL_ATTR}="1">')),
                     F.lit('<div class="ad">'), F.lit(f'<div class="ad" {L.LABEL_ATTR}="0">'))
    html = F.replace(html, F.lit("<br>"), F.lit(f'<br {L.LABEL_ATTR}="0">'))
    return pages.select("page_id", "url", html.alias("html"))


class AnnotatedCorpus(Corpus):
    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False):
        super().__init__(spark, sf_dir, once)
        self.pages = annotated_pages(self.pages)




def q_gold_lines(spark, sf_dir):
    g = G.gold_lines(_t(spark, sf_dir, "documents"))
    return g.select("doc_id", *_big("line_no"), "text")


def q_gold_keys(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return A.gold_keys(c.gold()).select("page_id", *_big("line_no"), "key_raw", "key_own")


def q_gold_candidates(spark, sf_dir):
    c = Corpus(spark, sf_dir, columns=None)
    return (A.candidates(c.dom, c.gold())
            .select("page_id", *_big("line_no"), F.col("node").cast("bigint").alias("pre"))
            .distinct())


def q_gold_align(spark, sf_dir):
    c = Corpus(spark, sf_dir, once=True)
    return A.owners(A.align(c.texts, c.gold())).select("page_id", *_big("pre"))


def q_label_by_text(spark, sf_dir):
    c = Corpus(spark, sf_dir, columns=S.TREE)
    return L.label_by_text(c.nodes, c.texts, c.gold()).select("page_id", *_big("pre"), "is_main")


def q_class_select(spark, sf_dir):
    c = Corpus(spark, sf_dir, once=True)
    return N.by_class(c.nodes, "ad").select("page_id", *_big("pre"), "tag")


def q_attr_select(spark, sf_dir):
    c = Corpus(spark, sf_dir, once=True)
    return N.by_attr(c.nodes, "lang", "en").select("page_id", *_big("pre"), "tag")


def q_subtree_mark(spark, sf_dir):
    c = Corpus(spark, sf_dir, columns=S.TREE)
    seeds = c.nodes.where(F.col("tag") == "nav").select("page_id", "pre")
    return N.mark_subtrees(c.nodes, seeds).select("page_id", *_big("pre"), "is_main")


def q_class_remove(spark, sf_dir):
    c = Corpus(spark, sf_dir, once=True)
    n = c.nodes.where(F.map_contains_key("attrs", F.lit("class")))
    return (N.remove_class(n, "ad")
            .select("page_id", *_big("pre"), F.array_join("classes", " ").alias("classes")))


def q_attr_remove(spark, sf_dir):
    c = AnnotatedCorpus(spark, sf_dir, once=True)
    n = N.remove_attr(c.nodes, L.LABEL_ATTR)
    return n.select("page_id", *_big("pre"), "tag",
                    F.map_contains_key("attrs", F.lit(L.LABEL_ATTR)).cast("int").alias("has_label"),
                    F.size(F.map_keys("attrs")).cast("bigint").alias("n_attrs"))


def q_unwrap(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    n, _ = N.unwrap_spans(c.nodes, c.texts, None, tag="b")
    return n.select("page_id", *_big("pre", "parent", "depth"), "tag")


def q_lca(spark, sf_dir):
    c = Corpus(spark, sf_dir, columns=S.TREE)
    seeds = c.nodes.where(F.col("tag") == "p").select("page_id", "pre")
    return N.common_ancestor(c.nodes, seeds).select("page_id", *_big("lca"))


def q_block_mark(spark, sf_dir):
    c = Corpus(spark, sf_dir, columns=S.TREE)
    seeds = c.nodes.where(F.col("tag") == "p").select("page_id", "pre")
    out = N.mark_block(c.nodes, N.common_ancestor(c.nodes, seeds))
    return out.select("page_id", *_big("pre"), "is_main")


def q_contradictions(spark, sf_dir):
    c = AnnotatedCorpus(spark, sf_dir)
    seeds = N.by_attr(c.nodes, L.LABEL_ATTR, 1).select("page_id", "pre")
    bad = N.contradictions(c.nodes, N.common_ancestor(c.nodes, seeds), L.LABEL_ATTR)
    return bad.select("page_id", *_big("n"))


def q_own_text_search(spark, sf_dir):
    c = Corpus(spark, sf_dir, once=True)
    return N.own_text_contains(c.texts, "the").select("page_id", *_big("pre"))


def q_subtree_text(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    return (N.subtree_text(c.nodes, c.page_text)
            .select("page_id", *_big("pre"), "subtree_text"))


def q_render(spark, sf_dir):
    c = Corpus(spark, sf_dir, once=True)
    return R.render(c.tokens)


def q_label_by_class(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    out = L.label_by_class(c.nodes, "ad", ["ad"])
    return out.select("page_id", *_big("pre"), "is_main",
                      F.array_join("classes", " ").alias("classes"))


def q_label_by_attr(spark, sf_dir):
    c = AnnotatedCorpus(spark, sf_dir)
    n, _ = L.label_by_attr(c.nodes, c.texts)
    return n.select("page_id", *_big("pre", "parent", "depth"), "tag", "is_main",
                    F.map_contains_key("attrs", F.lit(L.LABEL_ATTR)).cast("int").alias("has_label"))


def q_label_block_by_attr(spark, sf_dir):
    c = AnnotatedCorpus(spark, sf_dir)
    n, _, _ = L.label_block_by_attr(c.nodes, c.texts)
    return n.select("page_id", *_big("pre", "parent", "depth"), "tag", "is_main")


def q_label_corpus(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    gold = c.gold()
    return L.label_corpus(c.pages, lambda n, t: L.label_block_by_text(n, t, gold))


def q_label_corpus_attr(spark, sf_dir):
    return L.label_corpus(annotated_pages(_t(spark, sf_dir, "pages")), L.label_by_attr)


def q_label_corpus_block_attr(spark, sf_dir):
    return L.label_corpus(annotated_pages(_t(spark, sf_dir, "pages")), L.label_block_by_attr)


def q_page_scan(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    out = P.scratch_path(spark, "pages")
    P.write_pages(pages, out)
    back = spark.read.parquet(out)
    return back.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


def q_page_files(spark, sf_dir):
    """S1 on files: every page, and an empty twin of each, becomes a file; the folder is read back."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "html")
    twins = pages.select((-1 - F.col("page_id")).alias("page_id"), F.lit("").alias("html"))
    out = P.scratch_path(spark, "page-files")
    write_files(pages.unionByName(twins), out, "page_id", "html", ".html")
    back = P.read_pages(spark, out)
    return back.select(F.regexp_replace("filename", r"\.html$", "").cast("bigint").alias("page_id"), "html")


def q_gold_files(spark, sf_dir):
    """S6 on files: every document becomes a gold file; the folder is read back as lines."""
    out = P.scratch_path(spark, "gold-files")
    write_files(_t(spark, sf_dir, "documents"), out, "doc_id", "text", ".txt")
    lines = G.read_gold_files(spark, out)
    return lines.select(F.regexp_replace("file_name", r"\.txt$", "").cast("bigint").alias("doc_id"),
                        *_big("line_no"), "text")


def q_csv_roundtrip(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").withColumn("filename", F.col("page_id").cast("string"))
    out = P.scratch_path(spark, "csv")
    P.pages_to_csv(pages, out)
    back = P.read_pages_csv(spark, out)
    return back.select(F.col("filename").cast("bigint").alias("page_id"), "html")


def q_page_allowlist(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").withColumn("filename", F.col("page_id").cast("string"))
    lists = []
    for lang in ("en", "de"):
        out = P.scratch_path(spark, f"names-{lang}")
        (pages.where(F.col("url").contains(f"/{lang}/"))
         .select(F.concat(F.lit("  "), F.col("filename"), F.lit(" ")).alias("value"))
         .write.text(out))
        lists.append(out)
    kept = P.select_pages(pages, P.read_name_lists(spark, lists))
    return kept.select("page_id", "url")



VOCAB_TOP = 1000   # B3's top-k, in the query of that feature only
CUT_LENGTH = 64    # B5's truncation, likewise


def _seqs(df):
    return [render_seq(c).alias(c) for c in B.SEQ_COLS]


def _ids(df, cols=B.ID_COLS):
    return [F.array_join(c, ",").alias(c) for c in cols]


def q_text_blocks(spark, sf_dir):
    b = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    return b.select("page_id", "part", "pos", *_seqs(b), "label")


def q_blocks_csv(spark, sf_dir):
    b = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    out = P.scratch_path(spark, "blocks")
    BIO.write_blocks(b.drop("node"), out)
    back = BIO.read_blocks(spark, [out])
    return back.select("page_id", "part", "pos", *B.SEQ_COLS, "label").withColumn(
        "page_id", F.col("page_id").cast("bigint"))


def q_parse_sequences(spark, sf_dir):
    b = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    out = P.scratch_path(spark, "blocks")
    BIO.write_blocks(b.drop("node"), out)
    back = B.parse_sequences(BIO.read_blocks(spark, out))
    return back.select(F.col("page_id").cast("bigint").alias("page_id"), "part", "pos",
                       *[F.array_join(c, "|").alias(c) for c in B.SEQ_COLS],
                       *[F.size(c).cast("bigint").alias(f"n_{c}") for c in B.SEQ_COLS])


def q_vocab(spark, sf_dir):
    v = B.fit_vocab(Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks(), VOCAB_TOP)
    return v.select("token", F.col("id").cast("bigint").alias("id"), F.col("cnt").cast("bigint").alias("cnt"))


def _encoded(spark, sf_dir, pad="do_not_pad"):
    """Blocks with the ids of whole texts over the whole vocabulary."""
    blocks = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    return B.encode(blocks, B.fit_vocab(blocks), pad=pad)


def q_encode(spark, sf_dir):
    blocks = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    e = B.encode(blocks, B.fit_vocab(blocks, VOCAB_TOP), CUT_LENGTH)
    return e.select("page_id", "part", "pos", *_ids(e))


def q_encode_padded(spark, sf_dir):
    """Every sequence padded to the model's length."""
    blocks = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    e = B.encode(blocks, B.fit_vocab(blocks, VOCAB_TOP), CUT_LENGTH, "max_length")
    return e.select("page_id", "part", "pos", *_ids(e))


def q_split_parts(spark, sf_dir):
    b = B.split_parts(Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks(), 10)
    return b.select("page_id", "part", "pos", F.col("node").cast("bigint").alias("node"))


SEQ_BLOCKS = 85


def _samples(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    e = B.split_parts(e.select("page_id", "part", "pos", *B.ID_COLS, "label"), SEQ_BLOCKS)
    return B.make_samples(e, SEQ_BLOCKS)


def q_fold_pad_mask(spark, sf_dir):
    s = _samples(spark, sf_dir)
    shown = F.array_join(F.transform("features", lambda f: F.array_join(
        F.transform(f, lambda ids: F.array_join(ids, ",")), "|")), ";")
    return s.select("page_id", "part", F.array_join("label", ",").alias("labels"),
                    F.array_join("mask", ",").alias("mask"), F.md5(shown).alias("features_md5"))


def q_unpad_explode(spark, sf_dir):
    s = B.unpad(_samples(spark, sf_dir))
    rows = B.explode_blocks(s.drop("features"))
    return rows.select("page_id", "part", "pos", "label", "mask",
                       F.array_join(F.filter("text_ids", lambda i: i != 1), ",").alias("text_ids"))


# --- vectors (embeddings table: token vectors grouped by label) -------------



def _emb(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings")


def _long(df, keys, arr):
    return df.select(*keys, F.posexplode(arr).alias("dim", "value")).select(
        *keys, F.col("dim").cast("bigint").alias("dim"),
        F.round(F.col("value").cast("double"), 6).alias("value"))


def _pooled(spark, sf_dir, how):
    return V.pool(_emb(spark, sf_dir), "label", "embedding", how, order="vec_id")


def q_pool_mean(spark, sf_dir):
    return _long(_pooled(spark, sf_dir, "mean"), ["label"], "pooled")


def q_pool_max(spark, sf_dir):
    return _long(_pooled(spark, sf_dir, "max"), ["label"], "pooled")


def q_pool_first(spark, sf_dir):
    return _long(_pooled(spark, sf_dir, "first"), ["label"], "pooled")


VECTOR_DIMS = 4


def _masked_pool(spark, sf_dir, how):
    """Vectors of the text tokens of every block, padding blocks included, pooled under the mask."""
    rows = materialize(TV.token_rows(_samples(spark, sf_dir), every_pad=False), "token-rows")
    tokens = TV.attach_vectors(rows, TV.learn(rows, VECTOR_DIMS), VECTOR_DIMS)
    pooled = V.pool(tokens, ["page_id", "part", "pos"], how=how, mask="mask", order="k")
    return pooled.select("page_id", "part", "pos",
                         *[F.round(F.get("pooled", F.lit(d)), 6).alias(f"d{d}") for d in range(VECTOR_DIMS)])


def q_masked_mean(spark, sf_dir):
    return _masked_pool(spark, sf_dir, "mean")


def q_masked_max(spark, sf_dir):
    return _masked_pool(spark, sf_dir, "max")


def q_combine(spark, sf_dir):
    p = {h: _pooled(spark, sf_dir, h).withColumnRenamed("pooled", h) for h in V.POOL_MODES}
    j = p["mean"].join(p["max"], "label").join(p["first"], "label")
    modes = F.array(*[F.struct(F.lit(how).alias("how"), V.combine(["mean", "max", "first"], how).alias("c"))
                      for how in V.COMBINE_MODES])
    return _long(j.select("label", F.inline(modes)), ["label", "how"], "c")


def q_context(spark, sf_dir):
    # a sample: SEQ_BLOCKS consecutive ids of one label, so no window grows with the table
    e = _emb(spark, sf_dir).withColumn("vec", F.col("embedding").cast("array<double>")).withColumn(
        "sample", F.floor(F.col("vec_id") / SEQ_BLOCKS))
    c = V.with_context(e, "vec", keys=["label", "sample"], order="vec_id")
    z = c.select("vec_id", F.posexplode(F.arrays_zip("prev_1", "next_1")).alias("dim", "pn"))
    return z.select("vec_id", F.col("dim").cast("bigint").alias("dim"),
                    F.round(F.col("pn.prev_1"), 6).alias("prev"),
                    F.round(F.col("pn.next_1"), 6).alias("next"))


def q_attention_mask(spark, sf_dir):
    e = _encoded(spark, sf_dir, "longest")
    # made once a row
    e = e.select("page_id", "part", "pos", V.attention_mask("text_ids").alias("mask"))
    return e.select("page_id", "part", "pos", F.size("mask").cast("bigint").alias("length"),
                    F.size(F.array_remove("mask", 0)).cast("bigint").alias("n_real"),
                    F.array_position("mask", 0).cast("bigint").alias("first_pad"))


def q_seq_len(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select("page_id", "part", V.seq_len("mask").cast("bigint").alias("seq_len"))


# --- model ---------------------------------------------------------------------------

def _model_blocks(spark, sf_dir):
    """Split blocks - the training / scoring unit of the labeller (written once:
    fitting and scoring both read it)."""
    return materialize(B.split_parts(Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks().drop("node"), SEQ_BLOCKS), "model-blocks")


def q_class_weights(spark, sf_dir):
    b = _model_blocks(spark, sf_dir)
    real = M.class_weights(b).withColumn("variant", F.lit("blocks"))
    e = B.encode(b.drop("label"), B.fit_vocab(b)).select("page_id", "part", "pos", "text_ids").join(
        b.select("page_id", "part", "pos", "label"), ["page_id", "part", "pos"])
    s = B.make_samples(e.select("page_id", "part", "pos", "label", "text_ids",
                                F.lit(None).cast("array<int>").alias("class_ids"),
                                F.lit(None).cast("array<int>").alias("tag_ids")),
                       SEQ_BLOCKS, 1)
    padded = M.class_weights(M.padded_labels(s)).withColumn("variant", F.lit("padded"))
    return real.unionByName(padded).select(
        "variant", "label", F.col("n").cast("bigint").alias("n"), F.round("weight", 6).alias("weight"))


def _scored(spark, sf_dir):
    b = _model_blocks(spark, sf_dir)
    return b, TS.score_tokens(b, TS.fit_token_scores(b))


def q_emissions_nb(spark, sf_dir):
    _, sc = _scored(spark, sf_dir)
    return sc.select("page_id", "part", "pos", F.round(F.col("em")[0], 6).alias("s0"),
                     F.round(F.col("em")[1], 6).alias("s1"))


def q_emissions_weighted(spark, sf_dir):
    """M2 trained with the balanced class weights of M1."""
    b = _model_blocks(spark, sf_dir)
    sc = TS.score_tokens(b, TS.fit_token_scores(b, weights=M.class_weights(b)))
    return sc.select("page_id", "part", "pos", F.round(F.col("em")[0], 6).alias("s0"),
                     F.round(F.col("em")[1], 6).alias("s1"))


def q_transitions(spark, sf_dir):
    t = M.fit_transitions(_model_blocks(spark, sf_dir))
    return t.select("kind", F.coalesce("from_label", F.lit(-1)).alias("from_label"), "to_label",
                    F.round("score", 6).alias("score"))


def _decoded(spark, sf_dir):
    """(page_id, part, pos, prediction) and the blocks they were decoded from."""
    b, sc = _scored(spark, sf_dir)
    return C.decode_blocks(sc, M.fit_transitions(b), longest=SEQ_BLOCKS), b


def q_decode(spark, sf_dir):
    return _decoded(spark, sf_dir)[0]


def q_sequence_loss(spark, sf_dir):
    b, sc = _scored(spark, sf_dir)
    per = C.chain_loss(sc, M.fit_transitions(b), longest=SEQ_BLOCKS)
    loss = per.agg((F.sum("nll") / F.sum("n")).alias("loss"), F.sum("n").alias("n_blocks"))
    return loss.select(F.round("loss", 6).alias("loss"), F.col("n_blocks").cast("bigint").alias("n_blocks"))


# --- evaluation (labels table: quality = truth, toxic = prediction) -----------------

def _eval_pairs(spark, sf_dir):
    lab = _t(spark, sf_dir, "labels")
    return lab.select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


def q_eval_pairs(spark, sf_dir):
    """Decoded samples padded to SEQ_BLOCKS blocks with their masks;
    ``pairs`` must recover exactly the real blocks: (label, prediction, n)."""
    d, b = _decoded(spark, sf_dir)
    d = B.fold(d.join(b.select("page_id", "part", "pos", "label"), ["page_id", "part", "pos"]))
    n = F.size("label")
    pad = F.greatest(F.lit(SEQ_BLOCKS) - n, F.lit(0))
    padded = d.select(
        F.concat("label", F.array_repeat(F.lit(0), pad)).alias("label"),
        F.concat("prediction", F.array_repeat(F.lit(0), pad)).alias("prediction"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad)).alias("mask"))
    return (E.confusion(E.pairs(padded))
            .select("label", "prediction", F.col("n").cast("bigint").alias("n")))


def q_eval_metrics(spark, sf_dir):
    m = E.metrics(_eval_pairs(spark, sf_dir), "test")
    return m.select("metric", F.round("value", 6).alias("value"))


def q_eval_report(spark, sf_dir):
    r = E.report(_eval_pairs(spark, sf_dir))
    return r.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


# --- write-back (blocks of the pages, prediction = their label) -----------------



def _wb(spark, sf_dir, columns=MATCH_COLUMNS):
    c = Corpus(spark, sf_dir, columns=columns)
    blocks = c.blocks().withColumn("prediction", F.col("label"))
    return c, blocks


def q_tag_map(spark, sf_dir):
    b = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    return b.select("page_id", "part", "pos", F.array_join(html_tags("tag_seq"), " ").alias("tags"))


def q_clean_text(spark, sf_dir):
    b = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    return b.select("page_id", "part", "pos",
                    WB.clean_text(F.element_at("text_seq", -1)).alias("text"))


def q_match_tiers(spark, sf_dir):
    c, b = _wb(spark, sf_dir)
    return WB.count_hits(b, c.nodes, c.texts, c.page_text, c.dom)


def q_match_resolve(spark, sf_dir):
    c, b = _wb(spark, sf_dir)
    r = WB.resolve_cascade(b, c.nodes, c.texts, c.page_text, c.dom)
    return r.select("page_id", "part", "pos", "tier", F.col("pre").cast("bigint").alias("pre"))


def q_annotate(spark, sf_dir):
    c, b = _wb(spark, sf_dir)
    return WB.annotate(b, c.nodes, c.texts, c.page_text, c.dom).select("page_id", F.col("pre").cast("bigint").alias("pre"), "label")


def q_label_pages(spark, sf_dir):
    c, b = _wb(spark, sf_dir, EDIT_COLUMNS)
    html, _ = WB.label_pages(c.tokens, c.nodes, c.texts, c.page_text, c.dom, b, highlight=False)
    return html


def q_highlight(spark, sf_dir):
    c, b = _wb(spark, sf_dir, EDIT_COLUMNS)
    html, _ = WB.label_pages(c.tokens, c.nodes, c.texts, c.page_text, c.dom, b, highlight=True)
    return html


def q_attach_predictions(spark, sf_dir):
    from contentmark.operators import align as A2
    preds, blocks = _decoded(spark, sf_dir)
    out = P.scratch_path(spark, "predictions")
    BIO.write_blocks(A2.attach(blocks, preds), out, with_ids=False)
    back = BIO.read_blocks(spark, out)
    return back.select(F.col("page_id").cast("bigint").alias("page_id"), "part", "pos", "label",
                       "prediction")


# --- M6, M7: the labeller as estimator / model ------------------------------------

def q_fit_predict(spark, sf_dir):
    """Fit the labeller with MLlib logistic-regression emissions on the training
    pages (four of five by digest) and predict every block; ``held_out`` marks
    the others (rows-only check; ``fit_moments`` checks the solver)."""
    from contentmark.plans.labeller import BlockLabeler
    blocks = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    held_out = F.crc32(F.col("page_id").cast("string")) % 5 == 0
    model = BlockLabeler(max_blocks=SEQ_BLOCKS, emissions="lr").fit(blocks.where(~held_out))
    return model.transform(blocks).select("page_id", "part", "pos", held_out.alias("held_out"), "label", "prediction")


def q_fit_moments(spark, sf_dir):
    """The solver of ``fit_predict`` checked by optimality, over all blocks: what the fitted
    model gives every feature slot must be what was observed there."""
    rows = BF.block_features(_model_blocks(spark, sf_dir)).select("page_id", "part", "pos", "label", "features")
    rows = materialize(rows, "features")
    m = BF.moments(rows, BF.fit_logistic(rows))
    return m.select("slot", "n", F.col("observed").cast("double").alias("observed"), F.round("fitted", 1).alias("fitted"))


def q_split_metrics(spark, sf_dir):
    """The labeller in a ``pyspark.ml`` pipeline: fitted on the training pages, measured
    on stored predictions of separate training, validation and test tables."""
    from pyspark.ml import Pipeline

    from contentmark.plans.labeller import BlockLabeler
    blocks = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks().drop("node")
    fold = F.pmod("page_id", F.lit(5))
    train, val, test = blocks.where(fold > 1), blocks.where(fold == 1), blocks.where(fold == 0)
    model = Pipeline(stages=[BlockLabeler(max_blocks=SEQ_BLOCKS)]).fit(train).stages[0]
    m = model.evaluate_splits({"train_": train, "val_": val, "test": test})
    return m.select("metric", F.round("value", 6).alias("value"))


def q_model_reload(spark, sf_dir):
    """Fit (naive-Bayes emissions), save, reload and predict: must equal
    ``decode``."""
    from contentmark.plans.labeller import BlockLabeler, BlockLabelerModel
    blocks = Corpus(spark, sf_dir, columns=BLOCK_COLUMNS).blocks()
    model = BlockLabeler(max_blocks=SEQ_BLOCKS, emissions="nb").fit(blocks)
    path = P.scratch_path(spark, "model")
    model.save(path)
    again = BlockLabelerModel.load(spark, path)
    return again.transform(blocks).select("page_id", "part", "pos", "prediction")


def registry() -> dict:
    """Query name -> callable(spark, sf_dir); one per inventory item."""
    return {
        "dom_nodes": q_dom_nodes,
        "label_block_by_text": q_label_block_by_text,
        "gold_lines": q_gold_lines,
        "page_files": q_page_files,
        "gold_files": q_gold_files,
        "gold_keys": q_gold_keys,
        "gold_candidates": q_gold_candidates,
        "gold_align": q_gold_align,
        "label_by_text": q_label_by_text,
        "class_select": q_class_select,
        "attr_select": q_attr_select,
        "subtree_mark": q_subtree_mark,
        "class_remove": q_class_remove,
        "attr_remove": q_attr_remove,
        "unwrap": q_unwrap,
        "lca": q_lca,
        "block_mark": q_block_mark,
        "contradictions": q_contradictions,
        "own_text_search": q_own_text_search,
        "subtree_text": q_subtree_text,
        "render": q_render,
        "label_by_class": q_label_by_class,
        "label_by_attr": q_label_by_attr,
        "label_block_by_attr": q_label_block_by_attr,
        "label_corpus": q_label_corpus,
        "label_corpus_attr": q_label_corpus_attr,
        "label_corpus_block_attr": q_label_corpus_block_attr,
        "page_scan": q_page_scan,
        "csv_roundtrip": q_csv_roundtrip,
        "page_allowlist": q_page_allowlist,
        "text_blocks": q_text_blocks,
        "blocks_csv": q_blocks_csv,
        "parse_sequences": q_parse_sequences,
        "vocab": q_vocab,
        "encode": q_encode,
        "encode_padded": q_encode_padded,
        "split_parts": q_split_parts,
        "fold_pad_mask": q_fold_pad_mask,
        "unpad_explode": q_unpad_explode,
        "pool_mean": q_pool_mean,
        "pool_max": q_pool_max,
        "pool_first": q_pool_first,
        "masked_mean": q_masked_mean,
        "masked_max": q_masked_max,
        "combine": q_combine,
        "context": q_context,
        "attention_mask": q_attention_mask,
        "seq_len": q_seq_len,
        "class_weights": q_class_weights,
        "emissions_nb": q_emissions_nb,
        "emissions_weighted": q_emissions_weighted,
        "transitions": q_transitions,
        "decode": q_decode,
        "sequence_loss": q_sequence_loss,
        "eval_pairs": q_eval_pairs,
        "eval_metrics": q_eval_metrics,
        "eval_report": q_eval_report,
        "tag_map": q_tag_map,
        "clean_text": q_clean_text,
        "match_tiers": q_match_tiers,
        "match_resolve": q_match_resolve,
        "annotate": q_annotate,
        "label_pages": q_label_pages,
        "highlight": q_highlight,
        "attach_predictions": q_attach_predictions,
        "fit_predict": q_fit_predict,
        "fit_moments": q_fit_moments,
        "split_metrics": q_split_metrics,
        "model_reload": q_model_reload,
    }
