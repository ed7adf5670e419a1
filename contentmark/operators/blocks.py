"""Text blocks and block-sequence preparation.

A block is one element with non-blank own text; blocks are ordered by ``pos``
inside (page_id, part).  Samples are blocks folded to one row per
(page_id, part); all per-sample work is array expressions on that row, and a
sample is bounded by ``split_parts`` (at most ``max_blocks`` blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentmark.functions.tags import SEMANTIC_NAME_TAG_MAP, _map_literal
from contentmark.functions.text import strip_brackets, strip_ws
from contentmark.schema import BOS, EOS, PAD, UNK
from contentmark.session import materialize

PAD_MODES = ("max_length", "longest", "do_not_pad")
# Word-level tokens (letters / digits / underscore runs) and single
# punctuation marks - the stand-in for the pre-trained subword tokenizer.
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SEQ_COLS = ("class_seq", "tag_seq", "text_seq")
ID_COLS = ("class_ids", "tag_ids", "text_ids")


# --- S9 ---------------------------------------------------------------------

def extract_blocks(nodes: DataFrame, texts: DataFrame | None = None, label_col: str | None = "is_main",
                   mapping: dict | None = None) -> DataFrame:
    """(page_id, part, pos, class_seq, tag_seq, text_seq, label, node).

    One block per element inside ``body`` with non-blank own text runs;
    ``tag_seq`` = semantic names of the path from the (outermost) ``body``
    down to it, ``class_seq`` = non-empty class strings on that path,
    ``text_seq`` = its stripped own text runs.  Without ``texts`` the three come
    with each element from the shredder (its ``FACTS``); edited ``texts`` are
    regrouped by element, and the paths come with the elements."""
    inv = {v: k for k, v in (mapping or SEMANTIC_NAME_TAG_MAP).items()}
    names = _map_literal(inv)
    has_label = bool(label_col) and label_col in nodes.columns
    label_cols = [label_col] if has_label else []
    if texts is None:
        b = nodes.select("page_id", "pre", "class_seq", "tag_seq", "text_seq", *label_cols).where(
            F.col("text_seq").isNotNull() & F.col("page_id").isNotNull())
    else:
        b = _regrouped(nodes.select("page_id", "pre", "path_tags", "path_cls", *label_cols), texts)
    tag_seq = F.transform("tag_seq", lambda t: F.coalesce(F.try_element_at(names, t), t))
    label = F.col(label_col).cast("int") if has_label else F.lit(0)
    w = W.partitionBy("page_id").orderBy("pre")
    return b.select("page_id", F.lit(0).alias("part"),
                    (F.row_number().over(w) - 1).alias("pos"),
                    "class_seq", tag_seq.alias("tag_seq"), "text_seq",
                    label.alias("label"), F.col("pre").alias("node"))


def _regrouped(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Elements inside ``body`` with the stripped runs of ``texts`` they own."""
    runs = (texts.where(F.col("kind") == "text")
            .select("page_id", "node", "i", strip_ws("text").alias("t"))
            .where(F.col("t") != "")
            .groupBy("page_id", "node")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))),
                             lambda x: x["t"]).alias("text_seq")))
    body_at = F.array_position("path_tags", "body").cast("int")
    b = nodes.where(body_at > 0).join(runs.withColumnRenamed("node", "pre"), ["page_id", "pre"])
    rel_tags = F.slice("path_tags", body_at, F.size("path_tags"))
    rel_cls = F.slice("path_cls", body_at, F.size("path_cls"))
    return b.withColumn("tag_seq", rel_tags).withColumn("class_seq", F.filter(rel_cls, lambda c: c != ""))


# --- B1, B2, B14: list-like strings ------------------------------------------

def parse_sequences(blocks: DataFrame, cols=SEQ_COLS) -> DataFrame:
    """B2 on several columns: list-like strings -> arrays."""
    from contentmark.functions.text import parse_seq
    for c in cols:
        blocks = blocks.withColumn(c, parse_seq(c))
    return blocks


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """Configurable column names mapped to the canonical ones."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


# --- B3: vocabulary ------------------------------------------------------------

def tokenize(c) -> Column:
    """Lower-cased word / punctuation tokens of a string column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RE), 0)


def _seq_string(df: DataFrame, c: str) -> Column:
    t = dict(df.dtypes)[c]
    if t.startswith("array"):
        return F.array_join(F.col(c), ", ")
    return strip_brackets(c)


def fit_vocab(blocks: DataFrame, max_size: int | None = None, cols=SEQ_COLS) -> DataFrame:
    """(token, id, cnt) - ids by descending frequency then token, after
    the special ids bos=0 pad=1 eos=2 unk=3; ``max_size`` keeps the most
    frequent tokens only (all by default).  Counting is a partial aggregate;
    ids come from a range sort with one offset per partition."""
    toks = None
    for c in cols:
        t = blocks.select(F.explode(tokenize(_seq_string(blocks, c))).alias("token"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    order = [F.col("cnt").desc(), F.col("token")]
    if max_size is not None:
        counts = counts.orderBy(*order).limit(max_size)
    # eager, like an estimator's fit
    parts = materialize(counts.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "vocab")
    per_part = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))     # a row per partition
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return (parts.withColumn("_rn", inside).join(F.broadcast(offsets), "_p")
            .select("token", (F.col("_off") + F.col("_rn") + UNK).alias("id"), "cnt"))


def encode(blocks: DataFrame, vocab: DataFrame, max_length: int | None = None,
           pad: str = "do_not_pad", cols=SEQ_COLS, keys=("page_id", "part", "pos")) -> DataFrame:
    """Token ids for class / tag / text sequences: bos + ids + eos,
    unknown tokens -> unk, truncated to ``max_length`` if given (eos kept),
    padded per ``pad`` (``longest`` = longest sequence of that kind in the
    whole column, one aggregate for all three).

    Tokens of all three sequences are exploded once, looked up by a join
    with the vocabulary (the planner picks it by size and splits hot tokens;
    the vocabulary has one row per token) and regrouped per block."""
    if pad not in PAD_MODES:
        raise ValueError(f"pad must be one of {PAD_MODES}")
    if pad == "max_length" and max_length is None:
        raise ValueError("padding to max_length needs max_length")
    keys = list(keys)
    toks = blocks.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), _seq_string(blocks, c).alias("s"))
        for k, c in enumerate(cols)])))
    toks = toks.select(*keys, "kind", F.posexplode(tokenize("s")).alias("k", "token"))
    v = vocab.select("token", F.col("id").cast("int").alias("id"))
    # a token travels as one number that sorts as (kind, place) and ends in its id
    place = F.shiftleft((F.col("kind") - 2).cast("bigint"), 62) + F.shiftleft(F.col("k").cast("bigint"), 32)
    low = F.coalesce("id", F.lit(UNK)).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    ids = (toks.join(v, "token", "left").select(*keys, (place + low).alias("_x"))
           .groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_t")))
    out = blocks.join(ids, keys, "left")
    for kind, ic in enumerate(ID_COLS):
        got = F.transform(F.filter(F.coalesce("_t", F.array().cast("array<bigint>")),
                                   lambda x: F.shiftright(x, 62) == kind - 2),
                          lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
        seq = F.concat(F.array(F.lit(BOS)), got, F.array(F.lit(EOS)))
        if max_length is not None:
            seq = F.when(F.size(seq) > max_length, F.concat(
                F.slice(seq, 1, max_length - 1), F.array(F.lit(EOS)))).otherwise(seq)
        out = out.withColumn(ic, seq)
    out = out.drop("_t")
    if pad == "do_not_pad":
        return out
    if pad == "max_length":
        targets = dict.fromkeys(ID_COLS, max_length)
    else:
        targets = out.agg(*[F.coalesce(F.max(F.size(ic)), F.lit(0)).alias(ic) for ic in ID_COLS]).first().asDict()
    return out.withColumns({ic: pad_ids(F.col(ic), n) for ic, n in targets.items()})


def pad_ids(ids: Column, length) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(length - F.size(ids), F.lit(0))))


# --- B11: split long pages ----------------------------------------------------------

def split_parts(blocks: DataFrame, max_blocks: int = 85) -> DataFrame:
    """Split parts with more than ``max_blocks`` blocks evenly into
    k = ceil(n / max_blocks); ``part`` counts all resulting parts of a page
    in order (input parts never merge) and ``pos`` starts anew in each."""
    in_part = W.partitionBy("page_id", "part")
    b = (blocks.withColumn("_n", F.count(F.lit(1)).over(in_part))
         .withColumn("_rn", F.row_number().over(in_part.orderBy("pos")) - 1)
         .withColumn("_k", F.ceil(F.col("_n") / max_blocks)))
    b = b.withColumn("_sub", F.floor(F.col("_rn") * F.col("_k") / F.col("_n")))
    b = b.withColumn("pos", (F.col("_rn") - F.ceil(F.col("_sub") * F.col("_n") / F.col("_k"))).cast("int"))
    started = F.sum((F.col("pos") == 0).cast("int")).over(
        W.partitionBy("page_id").orderBy("part", "_rn").rowsBetween(W.unboundedPreceding, 0))
    return (b.withColumn("_part", (started - 1).cast("int")).withColumn("part", F.col("_part"))
            .drop("_n", "_rn", "_k", "_sub", "_part"))


# --- B7-B10: fold, pad blocks, mask, stack -----------------------------------------------

def fold(blocks: DataFrame, keys=("page_id", "part"), order: str = "pos") -> DataFrame:
    """One row per (page_id, part); every other column becomes a list in
    ``pos`` order.  Rows with a null key are dropped (as the reference's
    group-by does)."""
    keys = list(keys)
    others = [c for c in blocks.columns if c not in keys]
    b = blocks
    for k in keys:
        b = b.where(F.col(k).isNotNull())
    folded = b.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*[order] + [c for c in others if c != order])))
        .alias("_rows"))
    return folded.select(*keys, *[F.col("_rows")[c].alias(c) for c in others])


def _padded(blocks_col: str, length: Column) -> Column:
    return F.transform(blocks_col, lambda b: pad_ids(b, length))


def pad_blocks(samples: DataFrame, max_blocks: int = 85, max_length: int | None = None,
               label_col: str = "label") -> DataFrame:
    """Pad every block's ids to ``max_length`` (the sample's own longest
    block of that kind by default), the id lists to ``max_blocks`` with
    all-pad blocks and the labels with 0; longer samples stay as they are.
    Runs after the fold, so no pad travels through its shuffle."""
    out = samples
    for ic in ID_COLS:
        longest = F.coalesce(F.array_max(F.transform(ic, F.size)), F.lit(0)) if max_length is None \
            else F.lit(max_length)
        missing = F.array_repeat(F.array_repeat(F.lit(PAD), longest),
                                 F.greatest(F.lit(max_blocks) - F.size(ic), F.lit(0)))
        out = out.withColumn(ic, F.concat(_padded(ic, longest), missing))
    return out.withColumn(label_col, F.concat(label_col, F.array_repeat(
        F.lit(0), F.greatest(F.lit(max_blocks) - F.size(label_col), F.lit(0)))))


def block_mask(text_ids="text_ids") -> Column:
    """0 for a block whose text ids are all pad, else 1."""
    c = F.col(text_ids) if isinstance(text_ids, str) else text_ids
    return F.transform(c, lambda b: (~F.forall(b, lambda i: i == PAD)).cast("int"))


def stack_features(samples: DataFrame) -> DataFrame:
    """features = [class_ids, tag_ids, text_ids]."""
    return samples.withColumn("features", F.array(*[F.col(c) for c in ID_COLS]))


def make_samples(blocks: DataFrame, max_blocks: int = 85, max_length: int | None = None,
                 pad_to_max_blocks: bool = True) -> DataFrame:
    """B7-B10 in one go on encoded blocks."""
    s = fold(blocks)
    if pad_to_max_blocks:
        s = pad_blocks(s, max_blocks, max_length)
    return stack_features(s.withColumn("mask", block_mask()))


# --- B12, B13: unpad, explode ---------------------------------------------------------------

def unpad(samples: DataFrame, list_cols=None) -> DataFrame:
    """Cut every list to the number of real blocks (sum of the mask);
    the feature column is cut on its block axis."""
    n = F.aggregate("mask", F.lit(0), lambda a, x: a + x)
    list_cols = list_cols or [c for c, t in samples.dtypes
                              if t.startswith("array") and c != "features"]
    out = samples.withColumn("_n", n)
    for c in list_cols:
        out = out.withColumn(c, F.slice(c, F.lit(1), F.col("_n")))
    if "features" in samples.columns:
        out = out.withColumn("features", F.transform(
            "features", lambda f: F.slice(f, F.lit(1), F.col("_n"))))
    return out.drop("_n")


def explode_blocks(samples: DataFrame, keys=("page_id", "part"), list_cols=None) -> DataFrame:
    """Samples back to block rows, all lists in step (not features)."""
    keys = list(keys)
    list_cols = list_cols or [c for c, t in samples.dtypes
                              if t.startswith("array") and c != "features" and c not in keys]
    z = F.arrays_zip(*[F.col(c) for c in list_cols])
    return samples.select(*keys, F.inline(z))
