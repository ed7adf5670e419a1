"""Canonical table schemas and column names."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per token of a page (start tag, end tag, text run, comment, decl)
# plus one "doc" row per page holding its content text (text = all runs,
# own_text = runs outside script/style).  Start rows carry the node they open
# (node = pre order number) and the character range [c0, c1) / [s0, s1) of
# the node's subtree in those two texts; text rows carry their owning node
# and its tag / path; end rows the node they close.
DOM = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.IntegerType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("own_text", T.StringType()),
    T.StructField("n_children", T.IntegerType()),
    T.StructField("string_i", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_no", T.IntegerType()),
    T.StructField("c0", T.IntegerType()),
    T.StructField("c1", T.IntegerType()),
    T.StructField("s0", T.IntegerType()),
    T.StructField("s1", T.IntegerType()),
    T.StructField("end_i", T.IntegerType()),
    T.StructField("path_tags", T.ArrayType(T.StringType())),
    T.StructField("path_cls", T.ArrayType(T.StringType())),
    T.StructField("w0", T.IntegerType()),
    T.StructField("w1", T.IntegerType()),
    T.StructField("k0", T.IntegerType()),
    T.StructField("k1", T.IntegerType()),
    T.StructField("wtext", T.StringType()),
    T.StructField("norm", T.StringType()),
    T.StructField("text_seq", T.ArrayType(T.StringType())),
    T.StructField("tag_seq", T.ArrayType(T.StringType())),
    T.StructField("class_seq", T.ArrayType(T.StringType())),
    T.StructField("tree", T.BinaryType()),
    T.StructField("tags", T.StringType()),
])

TEXT_KINDS = ("text", "rawtext")

# Canonical block table (one row per text block, in page order).
BLOCK_KEYS = ("page_id", "part", "pos")

# Default column names of the block CSV contract, mapped to ours.
BLOCK_CSV_COLUMNS = {
    "html/originalId": "page_id",
    "html/part": "part",
    "html/classSequence": "class_seq",
    "html/tagSequence": "tag_seq",
    "html/textSequence": "text_seq",
    "html/label": "label",
    "html/prediction": "prediction",
    "html/classSequenceIds": "class_ids",
    "html/tagSequenceIds": "tag_ids",
    "html/textSequenceIds": "text_ids",
    "html/masks": "mask",
    "html/featureIds": "features",
}

# Special token ids of the block vocabulary.
BOS, PAD, EOS, UNK = 0, 1, 2, 3
# Fixed value: label attribute set on main-content nodes.
MAIN_LABEL_ATTR = "CASM_main_content_label"
