"""MinHash near-duplicates with tensored banding.

A document is its set of distinct 2-word shingles.  Two collections of ``SIDE``
sketches, each of ``ROWS`` minhashes, are computed; the table keys are all
SIDE x SIDE pairs of a left and a right sketch.  So 2 * SIDE * ROWS minhashes
give SIDE^2 tables of 2 * ROWS rows (72 instead of 864).  Two sets of
similarity s meet if any left and any right sketch agree: all but
2 (1 - s^ROWS)^SIDE of them (0.0004 at 0.8, under 0.00002 from 0.85 on).

Only distinct sets are keyed, and only sketches that another set shares are
combined, which drops most documents and loses no pair.  Candidates of a
table key are then verified on full sets without writing out all pairs:

* rounds of chains - neighbours of a bucket in a seeded order, sorted by set
  size at first - are verified by a join with the sets; verified links are
  contracted to components, and buckets inside one component are done;
* what is left in mixed buckets is swept: every pair of different components
  is compared in tasks by an XOR bitmap, whose Hamming distance bounds
  the difference of two sets from below, and every pair that the bound does
  not exclude is verified.  Buckets above ``BLOCK`` rows are cut into blocks, each pair
  of blocks a task of its own.

So each pair that shares a key is linked, in one component already or refuted.

Defined cases: words are split at ASCII white space, A-Z lower-cased; a text of
one word is one shingle; null and blank texts have no set, link with nothing and
are their own component; repeated rows and equal sets share a component; a
null id takes part, but a component's id is its smallest non-null id (null if it
has none); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentmark.llm.common import join_heavy, text_or_empty
from contentmark.llm.golay_simhash import components
from contentmark.session import materialize

SHINGLE, SHARE = 2, 80      # words of a shingle, per cent of the union
SIDE, ROWS, SEED = 12, 3, 42
BLOCK = 4096                # rows of a key handled in one task
PROGRESS = 20               # a chain round goes on if it merges one root in so many


def shingle_hashes(text: str, k: int = SHINGLE):
    """Sorted distinct 64-bit hashes of a text's shingles and their number
    (counted on the words, not on hashes)."""
    import numpy as np
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64), 0
    codes = {}
    for w in words:
        codes.setdefault(w, len(codes))
    hashed = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in codes), np.uint64, len(codes))
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    k = min(k, len(words))
    group = ids[:len(ids) - k + 1]
    for j in range(1, k):   # number the distinct shingles of j + 1 words
        firsts, group = np.unique(group * len(codes) + ids[j:len(ids) - k + 1 + j], return_inverse=True)
    if k > 1:
        where = np.zeros(len(firsts), np.int64)
        where[group] = np.arange(len(group))
    else:
        where = np.zeros(1, np.int64)
    x = np.full(len(where), k, np.uint64)
    for j in range(k):      # wrapping products
        x = (x ^ hashed[ids[where + j]]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.unique(x), len(where)


def _coefficients():
    import numpy as np
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64)


def sketches(x, starts):
    """Sketches of the sets laid end to end in ``x``: (sets, 2 * SIDE) longs; the
    lowest five bits are the sketch's place."""
    import numpy as np
    out = np.zeros((len(starts), 2 * SIDE), np.uint64)
    for k, (a, b) in enumerate(zip(*_coefficients())):
        low = np.minimum.reduceat(x * a + b, starts)
        s = k // ROWS
        out[:, s] = (out[:, s] ^ low ^ np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, s] ^= out[:, s] >> np.uint64(31)
    return ((out << np.uint64(5)) | np.arange(2 * SIDE, dtype=np.uint64)).view(np.int64)


def bitmap(x) -> bytes:
    """Parity of the hashes at each place of a bitmap of two bits a shingle or more."""
    import numpy as np
    bits = max(256, 1 << int(2 * len(x) - 1).bit_length())
    place = (x & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _measure(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = [shingle_hashes(t or "", shingle) for t in batch.column(1).to_pylist()]
                some = [x for x, _ in sets if len(x)]
                rows = iter(())
                if some:
                    starts = np.cumsum([0] + [len(x) for x in some[:-1]])
                    rows = iter(sketches(np.concatenate(some), starts).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([n for _, n in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(x.tobytes()) if n else None for x, n in sets], pa.binary()),
                     pa.array([next(rows) if n else None for _, n in sets], pa.list_(pa.int64())),
                     pa.array([bitmap(x) if n else None for x, n in sets], pa.binary())],
                    names=["id", "h", "n", "sid", "sk", "bits"])
    return run


def _set_rows(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                sets = [shingle_hashes(t or "", shingle)[0] for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                    names=["cid", "n", "s"])
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(text_or_empty(F.col(text_col))).alias("h"))


def bucket_members(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, cid, n, parts): the table rows of keys that several sets share;
    ``parts`` is the number of blocks of the key."""
    values = classes.select("cid", "n", F.explode("sk").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("_x_n")).where("_x_n > 1").select("value")
    own = (values.join(shared, "value").groupBy("cid", "n").agg(F.collect_list("value").alias("vs"))
           .withColumn("left", F.filter("vs", lambda v: v.bitwiseAND(31) < SIDE))
           .withColumn("right", F.filter("vs", lambda v: v.bitwiseAND(31) >= SIDE)))
    # a digest of both sketches over the places of both
    tensor = F.flatten(F.transform("left", lambda a: F.transform("right", lambda b: F.xxhash64(a, b).bitwiseAND(
        F.lit(-1024)).bitwiseOR(F.shiftleft(a.bitwiseAND(31), 5)).bitwiseOR(b.bitwiseAND(31)))))
    keyed = materialize(own.select("cid", "n", F.explode(tensor).alias("key")), "tensor-keys")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_x_n")).where("_x_n > 1")
    parts = counts.select("key", F.ceil(F.col("_x_n") / block).cast("int").alias("parts"))
    return materialize(keyed.join(parts, "key").select("key", "cid", "n", "parts"), "buckets")


def _chain(members: DataFrame, order: list, extra: str | None = None) -> DataFrame:
    """(u, v): neighbours in the order, inside each block of a key, and the
    first rows of neighbouring blocks; of different roots, if there are any."""
    cols = ["cid", "n"] + ([extra] if extra else [])
    rows = members.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).withColumn("me", F.struct(*cols))
    rows = rows.withColumn("at", F.struct(*order))
    inside = Window.partitionBy("key", "part").orderBy("at")
    near = rows.select("me", F.lag("me").over(inside).alias("last"))
    firsts = rows.where("parts > 1").groupBy("key", "part").agg(F.min_by("me", "at").alias("me"))
    across = firsts.select("me", F.lag("me").over(Window.partitionBy("key").orderBy("part")).alias("last"))
    both = near.unionAll(across).where("last is not null")
    if extra:
        both = both.where(f"me.{extra} <> last.{extra}")
    sized = both.where(F.least("me.n", "last.n") * 100 >= F.greatest("me.n", "last.n") * SHARE)
    return sized.select(F.least("me.cid", "last.cid").alias("u"), F.greatest("me.cid", "last.cid").alias("v")).distinct()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have ``SHARE`` per cent of their union in common."""
    a = sets.select(F.col("cid").alias("u"), F.col("n").alias("nu"), F.col("s").alias("su"))
    b = sets.select(F.col("cid").alias("v"), F.col("n").alias("nv"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return (pairs.join(a, "u").join(b, "v")
            .where(100 * both >= SHARE * (F.col("nu") + F.col("nv") - both)).select("u", "v"))


def _popcounts(a, b):
    import numpy as np
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _pairs_left(key, cid, n, root, bits, sk):
    """Pairs of one bucket with different roots that size and bitmap allow and
    that share no earlier key."""
    import numpy as np
    places = key >> 5 & 31, (key & 31) - SIDE
    order = np.argsort(n, kind="stable")
    width = {}
    for i in order:
        width.setdefault(len(bits[i]), []).append(i)
    out = []
    for w, rows in sorted(width.items()):
        mine = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), -1)
        twice = width.get(2 * w, [])   # a map of twice the width, folded
        rows, own = np.array(rows), len(rows)
        if twice:
            wide = np.frombuffer(b"".join(bits[i] for i in twice), np.uint64).reshape(len(twice), -1)
            half = wide.shape[1] // 2
            mine = np.concatenate((mine, wide[:, :half] ^ wide[:, half:]))
            rows = np.concatenate((rows, twice))
        size, group = n[rows], root[rows]
        for i in range(own):
            last = np.searchsorted(size, size[i] * 100 // SHARE, side="right")
            js = np.arange(i + 1, last)
            js = js[group[js] != group[i]]
            if len(js):
                # |A - B| + |B - A| >= Hamming distance; a link allows (1 - SHARE) / (1 + SHARE) of the sizes
                fits = _popcounts(mine[js], mine[i]) * (100 + SHARE) <= (size[js] + size[i]) * (100 - SHARE)
                js = js[fits]
                same = sk[rows[js]] == sk[rows[i]]
                first = (same[:, :SIDE].argmax(axis=1) == places[0]) & (same[:, SIDE:].argmax(axis=1) == places[1])
                out += [(cid[rows[i]], cid[rows[j]]) for j in js[first]]
    return out


def _sweep(batches):
    """Rows (key, pair, cid, n, root, bits, sk) sorted by key and block pair."""
    import numpy as np
    import pyarrow as pa

    def pairs(rows):
        cid, n, root = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
        if (root == root[0]).all():
            return []
        return _pairs_left(rows[0][0], cid, n, root, [r[5] for r in rows], np.array([r[6] for r in rows], np.int64))

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()),
                                           pa.array([max(p) for p in found], pa.int64())], names=["u", "v"])
    held, found = [], []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if held and row[:2] != held[0][:2]:
                found += pairs(held)
                held = []
                if len(found) > 4096:
                    yield batch(found)
                    found = []
            held.append(row)
    if held:
        found += pairs(held)
    if found:
        yield batch(found)


def sweep_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs (u, v) of mixed buckets that size and bitmap do not refute."""
    mine = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: (
        F.least(o, mine).cast("bigint") * F.col("parts") + F.greatest(o, mine)))
    rows = members.join(classes.select("cid", "bits", "sk"), "cid").withColumn("pair", F.explode(pairs))
    return (rows.select("key", "pair", "cid", "n", "root", "bits", "sk").repartition("key", "pair")
            .sortWithinPartitions("key", "pair").mapInArrow(_sweep, "u bigint, v bigint").distinct())


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with their roots."""
    rows = members.drop("root").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "root", F.coalesce("root", "cid"))
    rows = materialize(rows, "rooted-buckets")
    mixed = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    return materialize(rows.join(mixed, "key"), "mixed-buckets")


def roots_of(classes: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of every distinct set that links to a smaller one."""
    edges = materialize(verify(_chain(members, ["n", "cid"]), sets), "links")
    roots, turn = components(edges), 0
    while True:
        turn += 1
        members = _mixed(members, roots)
        left = members.select("root").distinct().count()
        if not left:
            return roots
        chain = verify(_chain(members, [F.xxhash64("cid", F.lit(turn)), "cid"], "root"), sets)
        more = materialize(chain, "links")
        if more.count() * PROGRESS < left:
            break
        roots = components(more.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    swept = verify(sweep_pairs(members, classes), sets)
    return components(swept.unionAll(more).unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: id, h (text digest), n_shingles, component_id."""
    t = _texts(docs, id_col, text_col)
    every = materialize(t.mapInArrow(_measure(shingle), "id bigint, h bigint, n bigint, sid binary, "
                                                         "sk array<bigint>, bits binary"), "minhash-docs")
    classes = every.where("sid is not null").groupBy("sid").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "h")).alias("one"), F.first("n").alias("n"),
        F.first("sk").alias("sk"), F.first("bits").alias("bits"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "minhash-sets")
    members = bucket_members(classes, block)
    need = members.select("cid").distinct().join(classes.select("cid", "one", "n"), "cid").select(
        "cid", "n", F.col("one.id").alias("_x_id"), F.col("one.h").alias("_x_h"))
    held = t.join(need, F.col("id").eqNullSafe(F.col("_x_id")) & (F.col("h") == F.col("_x_h")))
    sets = materialize(held.select("cid", "text", "n").dropDuplicates(["cid"])
                       .mapInArrow(_set_rows(shingle), "cid bigint, n bigint, s array<bigint>"), "shingle-sets")
    roots = roots_of(classes, members, sets)
    rooted = materialize(classes.select("sid", "cid", "least").join(
        roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_set = join_heavy(rooted.select("sid", "root"), named, "root").select("sid", "component_id")
    some = join_heavy(every.where("sid is not null").select("id", "h", "n", "sid"), materialize(by_set, "by-set"), "sid")
    alone = every.where("sid is null").withColumn("component_id", F.col("id"))
    cols = ["id", "h", F.col("n").alias("n_shingles"), "component_id"]
    return some.select(*cols).unionAll(alone.select(*cols))
