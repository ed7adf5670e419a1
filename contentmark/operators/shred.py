"""Shred a page table into the token / node / text tables.

``shred`` is the engine's single Python stage: an Arrow-batched
``mapInArrow`` over pages.  Everything downstream is built-in expressions
over its output, a flat token table (schema.DOM) from which ``nodes``,
``texts`` and ``tokens`` are projections - so one parse feeds all three.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import contentmark
from contentmark.operators.htmltree import FACTS, page_rows, unpack_tree
from contentmark.schema import DOM, TEXT_KINDS
from contentmark.session import spread

# Ship the package with the task closures, so executors need no install.
cloudpickle.register_pickle_by_value(contentmark)

_ARROW_DOM = pa.schema([
    pa.field("page_id", pa.int64()),
    pa.field("i", pa.int32()),
    pa.field("kind", pa.string()),
    pa.field("raw", pa.string()),
    pa.field("node", pa.int32()),
    pa.field("tag", pa.string()),
    pa.field("parent", pa.int32()),
    pa.field("depth", pa.int32()),
    pa.field("last", pa.int32()),
    pa.field("path", pa.list_(pa.int32())),
    pa.field("attrs", pa.map_(pa.string(), pa.string())),
    pa.field("classes", pa.list_(pa.string())),
    pa.field("own_text", pa.string()),
    pa.field("n_children", pa.int32()),
    pa.field("string_i", pa.int32()),
    pa.field("text", pa.string()),
    pa.field("text_no", pa.int32()),
    pa.field("c0", pa.int32()),
    pa.field("c1", pa.int32()),
    pa.field("s0", pa.int32()),
    pa.field("s1", pa.int32()),
    pa.field("end_i", pa.int32()),
    pa.field("path_tags", pa.list_(pa.string())),
    pa.field("path_cls", pa.list_(pa.string())),
    pa.field("w0", pa.int32()),
    pa.field("w1", pa.int32()),
    pa.field("k0", pa.int32()),
    pa.field("k1", pa.int32()),
    pa.field("wtext", pa.string()),
    pa.field("norm", pa.string()),
    pa.field("text_seq", pa.list_(pa.string())),
    pa.field("tag_seq", pa.list_(pa.string())),
    pa.field("class_seq", pa.list_(pa.string())),
    pa.field("tree", pa.binary()),
    pa.field("tags", pa.string()),
])
# Column sets: a row's ancestors; all that relates elements and text runs.
PATHS = ("path", "path_tags", "path_cls")
TREE = ("i", "kind", "node", "tag", "parent", "depth", "last", "text")
NO_PATHS = tuple(f.name for f in DOM if f.name not in ("page_id", *PATHS, *FACTS))
_ROWS_PER_BATCH = 32768
_CELLS_PER_BATCH = 1 << 20   # path entries of a batch


def _shred_batches(batches, wanted):
    import gc
    # page_rows and its module travel by value with this function
    schema = pa.schema([f for f in _ARROW_DOM if f.name == "page_id" or f.name in wanted])
    cols = schema.names[1:]
    paths = tuple(c for c in PATHS if c in wanted)
    facts = tuple(c for c in FACTS if c in wanted)

    def batch_of(ids, rows):
        buf = {c: [r.get(c) for r in rows] for c in cols}
        if "attrs" in buf:
            buf["attrs"] = [None if v is None else list(v.items()) for v in buf["attrs"]]
        return pa.RecordBatch.from_pydict({"page_id": ids, **buf}, schema=schema)

    ids, rows = [], []
    cells = 0
    on = gc.isenabled()
    gc.disable()   # token rows hold no cycles
    try:
        for batch in batches:
            schema = schema.set(0, pa.field("page_id", batch.column("page_id").type))
            docs = batch.column("html").to_pylist()
            for pid, doc in zip(batch.column("page_id").to_pylist(), docs):
                for r in page_rows(doc, paths, facts):
                    ids.append(pid)
                    rows.append(r)
                    if paths:
                        cells += len(r[paths[0]] or ())
                    elif facts:
                        cells += len(r.get("tag_seq") or ())
                    if len(rows) >= _ROWS_PER_BATCH or cells >= _CELLS_PER_BATCH:
                        yield batch_of(ids, rows)
                        ids, rows = [], []
                        cells = 0
        if rows:
            yield batch_of(ids, rows)
    finally:
        if on:
            gc.enable()


def shred(pages: DataFrame, partitions: int | None = None, key: str | None = None,
          columns=None) -> DataFrame:
    """Pages (page_id or filename, html) -> token table (schema.DOM).

    The page key (``key``, else ``page_id``, else ``filename``) may be an
    integer or any value with a string form, such as a file name; every
    operator carries it as ``page_id``.

    Parallelism comes from the scan splits; only when the input has fewer
    partitions than the cluster has task slots (small files, one row group)
    the pages are spread by ``page_id`` first.  A page is parsed whole
    inside one task - it is the unit the tree is defined on.

    ``columns`` names the columns of schema.DOM to make (default all, ``page_id``
    and ``kind`` always); a table that is written keeps to what is read.
    ``PATHS`` list each row's ancestors, which blocks and write-back compare:
    depth entries a row.  Node operators and labelling recipes use intervals
    alone; without ``PATHS`` the table is linear in the page at any depth.
    """
    wanted = {f.name for f in DOM} if columns is None else {"kind", *columns}
    name = key or ("page_id" if "page_id" in pages.columns else "filename")
    whole = isinstance(pages.schema[name].dataType, T.IntegralType)
    src = pages.select(F.col(name).cast("bigint" if whole else "string").alias("page_id"),
                       F.col("html").cast("string").alias("html"))
    if partitions:
        src = src.repartition(partitions, "page_id")
    else:
        src = spread(src, "page_id")
    types = T.StructType([T.StructField("page_id", src.schema["page_id"].dataType),
                          *[f for f in DOM.fields[1:] if f.name in wanted]])
    return src.mapInArrow(lambda batches: _shred_batches(batches, wanted), types)


def _of(dom: DataFrame, names, **aliases: str) -> list[Column]:
    """Those of the columns that the token table has, some under another name."""
    return [F.col(aliases.get(c, c)).alias(c) for c in names if aliases.get(c, c) in dom.columns]


def nodes(dom: DataFrame) -> DataFrame:
    """One row per element, with those of the columns below that the token
    table has; ``i`` is the start tag's token."""
    return dom.where(F.col("kind") == "start").select(_of(dom, [
        "page_id", "pre", "last", "parent", "depth", "tag",
        "attrs", "classes", "own_text", "path", "n_children", "string_i", "i",
        "raw", "c0", "c1", "s0", "s1", "w0", "w1", "k0", "k1", "end_i", "path_tags", "path_cls",
        "text_seq", "tag_seq", "class_seq", "attrs0", "classes0"], pre="node", attrs0="attrs", classes0="classes"))


def texts(dom: DataFrame) -> DataFrame:
    """One row per text run owned by an element: page_id, text_no, i, node
    (owner pre), tag / depth / path of the owner, kind, text, as far as the
    token table has them; ``norm``: the text with folded white space where that
    differs."""
    return dom.where(F.col("kind").isin(*TEXT_KINDS) & F.col("node").isNotNull()).select(_of(dom, [
        "page_id", "text_no", "i", "node", "tag", "depth", "path", "kind", "text", "norm"]))


def tokens(dom: DataFrame) -> DataFrame:
    """The token stream: page_id, i, kind, raw, node (opened / closed /
    owning element).  Each page starts with its empty ``doc`` token, so pages
    without any markup are kept."""
    return dom.select("page_id", "i", "kind", "raw", "node", "tag")


def page_text(dom: DataFrame) -> DataFrame:
    """One row per page: content (all text runs, script included), plain
    (runs outside script / style) and bare (plain without white space), in
    document order, as far as the token table has them."""
    return dom.where(F.col("kind") == "doc").select(_of(
        dom, ["page_id", "content", "plain", "bare"], content="text", plain="own_text", bare="wtext"))


UNPACKED = ("kind", "i", "node", "tag", "path", "path_tags", "text", "c0", "k0", "k1", "wtext")


def _unpack_batches(batches):
    cols = ("page_id", *UNPACKED)

    def batch_of(rows, key):
        fields = [pa.field("page_id", key), *[f for c in UNPACKED for f in _ARROW_DOM if f.name == c]]
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], f.type) for c, f in zip(cols, fields)],
                                          schema=pa.schema(fields))

    for batch in batches:
        rows, cells = [], 0
        key = batch.schema.field("page_id").type
        for page, text, bare, tree, names in zip(*(batch.column(c).to_pylist() for c in (
                "page_id", "text", "wtext", "tree", "tags"))):
            tags, parents, k0, k1, run_i, run_at, run_node = unpack_tree(tree, names)

            def path(x):
                line = []
                while x >= 0:
                    line.append(x)
                    x = parents[x]
                return line[::-1]
            rows.append({"page_id": page, "kind": "doc", "i": -1, "text": text, "wtext": bare})
            for x, tag in enumerate(tags):
                line = path(x)
                rows.append({"page_id": page, "kind": "start", "node": x, "tag": tag, "path": line,
                             "path_tags": [tags[a] for a in line], "k0": k0[x], "k1": k1[x]})
                cells += len(line)
                if len(rows) >= _ROWS_PER_BATCH or cells >= _CELLS_PER_BATCH:
                    yield batch_of(rows, key)
                    rows, cells = [], 0
            for i, at, end, x in zip(run_i, run_at, [*run_at[1:], len(text)], run_node):
                owned = x >= 0
                rows.append({"page_id": page, "kind": "text", "i": i, "node": x if owned else None,
                             "tag": tags[x] if owned else None, "path": path(x) if owned else None,
                             "text": text[at:end], "c0": at})
                cells += len(rows[-1]["path"] or ())
                if len(rows) >= _ROWS_PER_BATCH or cells >= _CELLS_PER_BATCH:
                    yield batch_of(rows, key)
                    rows, cells = [], 0
        if rows:
            yield batch_of(rows, key)


def unpacked(docs: DataFrame) -> DataFrame:
    """The token rows (``UNPACKED``) of pages from their packed trees: elements and
    text runs (of both kinds) with their paths, and the ``doc`` row.  The paths take depth
    entries a row; they are handed out in batches, and are needed for few pages."""
    types = T.StructType([docs.schema["page_id"], *[DOM[c] for c in UNPACKED]])
    return docs.select("page_id", "text", "wtext", "tree", "tags").mapInArrow(_unpack_batches, types)
