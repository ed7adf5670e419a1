"""Substring de-duplication by content-defined chunking.

A gear hash rolls over the code points; a chunk ends before a word start (or
before any character from U+2E80 on) where the hash of
the last ``WINDOW`` characters has ``MASK_BITS`` chosen bits zero.  Where no blank lies
in the last ``RUN`` characters (Thai, Lao, Khmer, Burmese, base64), it ends before any
character where ``RUN_BITS`` bits are zero.  Cuts depend on
nearby text only, so an insertion shifts no later chunk.  Chunks are
compared by 96 digest bits over all documents: a digest's owner is the
smallest id that holds it, and it is repeated text in every other document, and
at each later place of the same document.  Adjacent repeated chunks make a span;
spans of at least ``MIN_SPAN`` characters are removed.  That length also keeps
common phrases and any chance equality of single digests.

The whole text is chunked.  Digest counts combine before the shuffle.  The few
digests that hold over a thousandth of all chunks each are joined by broadcast
(there are fewer than a thousand, whatever the data); no other digest is hot.

Defined cases: null and empty texts have no chunk and stay as they are; rows
of one id are one document, so nothing is removed between them for being in both
(equal rows come out equal); rows without an id count as one last document; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmark.llm.common import text_or_empty
from contentmark.session import materialize

WINDOW, MASK_BITS = 16, 2
RUN, RUN_BITS = 64, 5
MIN_CHUNK, MAX_CHUNK = 16, 256
MIN_SPAN = 100
HOT = 1000           # a digest of over one chunk in so many is joined by broadcast
NO_ID = (1 << 63) - 1


def gear_table():
    """256 pseudo-random 32-bit values by a multiplicative rule."""
    import numpy as np
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def chunk_ends(text: str, gear) -> list[int]:
    """Ends of the chunks of one text, in code points."""
    import numpy as np

    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    h = gear[(cp ^ cp >> 8) & 255]
    for k in (1, 2, 4, 8):    # doubles the window: 2, 4, 8, 16 characters
        h[k:] += h[:-k].copy() << np.uint32(k)
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
    may = (blank[:-1] & ~blank[1:]) | (cp[1:] >= 0x2E80)
    low = np.uint32((1 << MASK_BITS) - 1 << WINDOW - MASK_BITS)
    cut = may & (h[:-1] & low == 0)
    stops = np.concatenate(([-1], np.flatnonzero(blank), [len(cp)]))
    strict = np.uint32((1 << RUN_BITS) - 1 << WINDOW - RUN_BITS)
    for k in np.flatnonzero(np.diff(stops) > RUN).tolist():
        a, b = int(stops[k]) + RUN, int(stops[k + 1]) - 1
        cut[a:b] |= h[a:b] & strict == 0
    ends, last = [], 0
    for x in (np.flatnonzero(cut) + 1).tolist() + [len(cp)]:
        while x - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if x - last >= MIN_CHUNK or x == len(cp) > last:
            ends.append(x)
            last = x
    return ends


def _chunks(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash
    gear = gear_table()
    names = ["digest", "more", "id", "h", "a", "b", "again"]
    out: list[tuple] = []
    size = 0

    def flush():
        cols = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=names)
    few = (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256))
    for batch in few:   # only a few texts at once are Python strings
        for i, text, h in zip(*(c.to_pylist() for c in batch.columns)):
            if not text:
                continue
            ends = chunk_ends(text, gear)
            raw = memoryview(text.encode("utf-32-le", "surrogatepass"))
            b = np.array(ends, np.int32)
            a = np.concatenate((np.zeros(1, np.int32), b[:-1]))
            both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), ends)]),
                                 np.int32).reshape(-1, 4)
            d, more = np.ascontiguousarray(both[:, :2]).view(np.int64).ravel(), both[:, 2].copy()
            first = np.ones(len(d), bool)
            first[np.unique(d, return_index=True)[1]] = False
            out.append((d, more, np.full(len(d), NO_ID if i is None else i), np.full(len(d), h), a, b, first))
            size += len(d)
            if size >= 65536:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: digest and more (96 bits of its digest), id, h (text
    digest), a, b (code points) and again (the digest occurs earlier in the same text)."""
    t = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"),
                    F.xxhash64(text_or_empty(F.col(text_col))).alias("h"))
    return t.mapInArrow(_chunks, "digest bigint, more int, id bigint, h bigint, a int, b int, again boolean")


def _merge(min_span: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            ids, hs, spans = [], [], []
            for i, h, ps in zip(*(c.to_pylist() for c in batch.columns)):
                merged: list[list[int]] = []
                for p in sorted((x["a"], x["b"]) for x in ps):
                    if merged and p[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], p[1])
                    else:
                        merged.append([p[0], p[1]])
                long = [{"a": a, "b": b} for a, b in merged if b - a >= min_span]
                if long:
                    ids.append(i)
                    hs.append(h)
                    spans.append(long)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()),
                                              pa.array(spans, kind)], names=["id", "h", "spans"])
    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_span: int = MIN_SPAN) -> DataFrame:
    """(id, h, spans): the repeated spans of every text that has any."""
    table = materialize(chunks(docs, id_col, text_col), "chunks")
    key = ["digest", "more"]
    owners = (table.groupBy(*key).agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count(F.lit(1)).alias("times"))
              .where("last <> owner").select(*key, "owner", "times"))
    owners = materialize(owners, "chunk-owners")
    hot = F.col("times") * HOT > table.count()
    few = F.broadcast(owners.where(hot).drop("times"))
    rest = table.join(few, key, "left_anti").join(owners.where(~hot).drop("times"), key)
    across = rest.unionByName(table.join(few, key)).where("id <> owner")
    both = across.select("id", "h", "a", "b").unionAll(table.where("again").select("id", "h", "a", "b"))
    per_doc = both.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("ps"))
    return per_doc.mapInArrow(_merge(min_span), "id bigint, h bigint, spans array<struct<a:int,b:int>>")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          min_span: int = MIN_SPAN) -> DataFrame:
    """``docs`` with repeated spans cut out of the text, plus _x_spans (null
    where nothing was cut)."""
    spans = repeated_spans(docs, id_col, text_col, min_span)
    spans = materialize(spans.select(F.col("id").alias("_x_id"), F.col("h").alias("_x_h"),
                                     F.col("spans").alias("_x_spans")), "repeated-spans")
    keyed = docs.withColumn("_x_k", F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))).withColumn(
        "_x_g", F.xxhash64(text_or_empty(F.col(text_col))))
    # spans grow with the documents: shuffled at every size, never broadcast
    j = keyed.join(spans.hint("merge"), (F.col("_x_k") == F.col("_x_id")) & (F.col("_x_g") == F.col("_x_h")), "left")
    s, text = F.col("_x_spans"), F.col(text_col)
    between = F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.substring(
        text, F.coalesce(F.get(s, i - 1)["b"], F.lit(0)) + 1,
        F.coalesce(F.get(s, i)["a"], F.length(text)) - F.coalesce(F.get(s, i - 1)["b"], F.lit(0))))
    return (j.withColumn(text_col, F.when(s.isNull(), text).otherwise(F.array_join(between, "")))
            .select(*docs.columns, "_x_spans"))
