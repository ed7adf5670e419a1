"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is read as two 32-bit segments.  Of at most three
differing bits one segment holds at most one (pigeonhole).  The first 23 bits
of a segment are decoded in the perfect (23, 12) Golay code; a word and all
its one-bit neighbours have at most six nearest codewords (one, when the word is
within two bits of its own), and two words one bit apart share one of them.  So
a segment gives the keys (codeword index, its other 9 bits) for an error among
the 23, and (its 23 bits) for an error among the 9: about 13 keys for a
fingerprint, and every linked pair meets under one.

Rows of a key are compared by XOR and bit count inside tasks, and only edges
that join something are written: a bucket of n fingerprints gives O(n) edges.
Buckets above ``BLOCK`` rows are cut into blocks, and every pair of blocks is a
task of its own - exact at any size.  Groups are connected components
by large-star / small-star rounds, written to the shared folder each round.

Only distinct fingerprints are keyed, so exact copies cost one row.

Defined cases: null and empty texts have fingerprint 0 and are linked like any
other; a text with fewer words than the shingle length is one shingle; repeated
rows are documents of their own with equal results (``keep_one`` keeps one of
equal rows); a null id takes part, but a component's id is its smallest
non-null id (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmark.llm.common import text_or_empty
from contentmark.session import materialize

SHINGLE, MAX_BITS, SEED = 3, 3, 42
# Generator polynomial and sizes of the binary Golay code.
GOLAY_POLY, GOLAY_N, GOLAY_CHECK = 0xC75, 23, 11
BLOCK = 8192       # rows of a key compared in one task
NEIGHBOURS = 16    # groups up to one more are compared by shifting the batch


def fingerprint_text(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, as an unsigned integer."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(
            starts[:len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        h = np.array(hashes[k:k + 8192], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            fps = [fingerprint_text(t or "", shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                names=["id", "h", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, h, fp): id, text digest and fingerprint (a signed long holding
    the 64 bits) per row."""
    t = docs.select(F.col(id_col).cast("bigint").alias("id"),
                    F.col(text_col).cast("string").alias("text"),
                    F.xxhash64(text_or_empty(F.col(text_col))).alias("h"))
    return t.mapInArrow(_fingerprints(shingle), "id bigint, h bigint, fp bigint")


def golay_tables():
    """(remainder of the 12 high bits, error pattern by syndrome)."""
    import itertools

    import numpy as np

    def remainder(v: int) -> int:
        for i in range(GOLAY_N - 1, GOLAY_CHECK - 1, -1):
            if v >> i & 1:
                v ^= GOLAY_POLY << (i - GOLAY_CHECK)
        return v
    high = np.array([remainder(k << GOLAY_CHECK) for k in range(1 << (GOLAY_N - GOLAY_CHECK))], np.int64)
    error = np.zeros(1 << GOLAY_CHECK, np.int64)
    for weight in range(1, 4):
        for bits in itertools.combinations(range(GOLAY_N), weight):
            e = sum(1 << b for b in bits)
            error[remainder(e)] = e
    return high, error


def golay_keys(words, tables):
    """Nearest-codeword indices of 23-bit words and of their one-bit
    neighbours: an (n, 24) array, repeats replaced by -1."""
    import numpy as np

    high, error = tables
    flips = np.concatenate(([0], 1 << np.arange(GOLAY_N))).astype(np.int64)
    near = words[:, None] ^ flips[None, :]
    syndrome = high[near >> GOLAY_CHECK] ^ (near & ((1 << GOLAY_CHECK) - 1))
    index = np.sort((near ^ error[syndrome]) >> GOLAY_CHECK, axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return index


def segment_keys(fps, tables):
    """(row, key) arrays of all keys of unsigned 64-bit fingerprints."""
    import numpy as np

    rows, keys = [], []
    for seg in (0, 1):
        part = (fps >> np.uint64(32 * seg) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        coded, rest = part >> 9, part & 511
        index = golay_keys(coded, tables)
        r, c = np.nonzero(index >= 0)
        rows += [r, np.arange(len(fps))]
        keys += [(2 * seg << 32) | (index[r, c] << 9) | rest[r], (2 * seg + 1 << 32) | coded]
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches):
    import numpy as np
    import pyarrow as pa
    tables = golay_tables()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 16384):
            part = fps[k:k + 16384]
            rows, keys = segment_keys(part.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


def _grow(fps, max_bits: int):
    """Edges (member, first) joining all linked fingerprints of one group:
    each is compared once with those not yet reached."""
    import numpy as np
    left = np.unique(fps)
    out = []
    while len(left):
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(left ^ u) <= max_bits
            if near.any():
                hit = left[near]
                left = left[~near]
                queue.extend(hit)
                out.append(np.stack((hit, np.full(len(hit), first)), axis=1))
    return out


def _links(max_bits: int):
    """Per partition, rows sorted by (key, block pair): verified edges."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def edges(key, fp):
            found = []
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            sizes = np.diff(cuts)
            small = np.repeat(sizes <= NEIGHBOURS + 1, sizes)
            k, f = key[small], fp[small]
            for d in range(1, NEIGHBOURS + 1):
                same = k[d:] == k[:-d]
                if not same.any():
                    break
                ok = same & (np.bitwise_count(f[d:] ^ f[:-d]) <= max_bits) & (f[d:] != f[:-d])
                found.append(np.stack((f[d:][ok], f[:-d][ok]), axis=1))
            for g in np.flatnonzero(sizes > NEIGHBOURS + 1):
                found += _grow(fp[cuts[g]:cuts[g + 1]], max_bits)
            if not found:
                return None
            e = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(e[:, 0]).view(np.int64)),
                 pa.array(np.ascontiguousarray(e[:, 1]).view(np.int64))], names=["u", "v"])
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            rows = np.concatenate((rest, rows))
            whole = rows[:, :2]
            last = np.flatnonzero((whole != whole[-1]).any(axis=1))
            end = last[-1] + 1 if len(last) else 0   # the last group may go on
            rest = rows[end:]
            if end:
                done = rows[:end]
                group = np.cumsum(np.concatenate(([0], (done[1:, :2] != done[:-1, :2]).any(axis=1))))
                out = edges(group, np.ascontiguousarray(done[:, 2]).view(np.uint64))
                if out:
                    yield out
        if len(rest):
            out = edges(np.zeros(len(rest), np.int64), np.ascontiguousarray(rest[:, 2]).view(np.uint64))
            if out:
                yield out
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect
    all pairs within ``max_bits`` bits; at most 3, the reach of the code."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two Golay segments find pairs of at most 3 differing bits")
    keyed = materialize(fps.select("fp").distinct().mapInArrow(_emit_keys, "key bigint, fp bigint"),
                        "golay-keys")
    big = (keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
           .select(F.col("key").alias("k2"), F.ceil(F.col("n") / block).cast("int").alias("parts")))
    cut = keyed.join(big, F.col("key") == F.col("k2"), "left").drop("k2")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: (
        F.least(o, mine) * F.col("parts") + F.greatest(o, mine)).cast("bigint"))
    spread = (cut.withColumn("pair", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("bigint")))
                                               .otherwise(pairs)))
              .select("key", "pair", "fp"))
    return (spread.repartition("key", "pair").sortWithinPartitions("key", "pair")
            .mapInArrow(_links(max_bits), "u bigint, v bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of its component, for every
    node that has an edge and isn't the root."""
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"),
                                                 F.least("u", "v").alias("lo")).distinct(), "cc")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now
        both = (e.select(F.col("hi").alias("n"), F.col("lo").alias("m"))
                .unionAll(e.select(F.col("lo").alias("n"), F.col("hi").alias("m"))))
        least = both.groupBy("n").agg(F.min("m").alias("mm")).withColumn("mm", F.least("mm", "n"))
        large = (both.where("m > n").join(least, "n")
                 .select(F.col("m").alias("hi"), F.col("mm").alias("lo")).distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("mm"))
        joined = large.join(low, "hi")
        small = (joined.where("lo <> mm").select(F.col("lo").alias("hi"), F.col("mm").alias("lo"))
                 .unionAll(low.select("hi", F.col("mm").alias("lo"))).distinct())
        e = materialize(small, "cc")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, h (text digest), fp, component_id (smallest
    id among all documents reachable over links)."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(classes, max_bits))
    rooted = (classes.join(roots, classes["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("f")).select("id", "h", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the smallest id (then
    text digest).  Of equal rows one stays; documents without an id stay one
    for each component of such documents alone."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(F.struct(
        F.coalesce(F.col("id"), F.lit((1 << 63) - 1)).alias("i"), "id", "h")).alias("best"))
    roots = components(links(classes, max_bits))
    best = (classes.join(roots, classes["fp"] == roots["node"], "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best")))
    best = best.select(F.col("best.id").alias("_x_id"), F.col("best.h").alias("_x_h"))
    times = fps.groupBy("id", "h").agg(F.count(F.lit(1)).alias("_x_n"))
    stay = materialize(best.join(times, F.col("_x_id").eqNullSafe(F.col("id")) & (F.col("_x_h") == F.col("h")))
                       .select("_x_id", "_x_h", "_x_n"), "keepers")
    kept = docs.withColumn("_x_g", F.xxhash64(text_or_empty(F.col(text_col)))).join(
        stay, F.col(id_col).cast("bigint").eqNullSafe(F.col("_x_id")) & (F.col("_x_g") == F.col("_x_h")))
    once = kept.where("_x_n = 1")
    again = kept.where("_x_n > 1").dropDuplicates(["_x_id", "_x_h"])
    return once.unionByName(again).select(*docs.columns)
