"""Packing by lexical retrieval: every window is filled with neighbours.

Documents are tokenised where they lie, and their ids are written once.  Document
counts of all terms and the mean length are Spark aggregates over the whole
table.  Every document is routed by the ``ROUTE_TERMS`` shared terms that weigh most in
it (BM25 weights with those corpus statistics): a range shuffle by them brings
documents together wherever they lay in the input.  The key ends with a digest
and a row number, so a common term or a large group of copies is split evenly.

A task gathers its sorted documents into shards of about ``SHARD_TOKENS`` tokens.
A shard has a BM25 inverted index over token ids (all posting lists; idf and mean
length are the corpus's), with one entry for equal texts; entries whose documents
are all used leave it.  The shard's next unused document is the
seed of a window; all its terms score every entry, and the unused
neighbours, best first, fill the window until it is full; the document at the
end of a window is cut and its rest is the next seed.  When retrieval gives
nothing, the next unused document follows, so windows are always full.  The
last window of a partition is cut into lengths that are powers of two, which need
no padding.

A seed queries its own shard only: documents whose heaviest terms differ lie in other
shards and are not its candidates.  Memory is bounded by the shard.  A document
longer than a shard makes a shard of its own.

Tokenisation splits at white space first (no token of these vocabularies crosses
it) and asks the tokenizer once for each distinct piece.

Defined cases: null text is empty and has only the end id; repeated rows are
documents of their own; a null id stays null in its pieces; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmark.llm.tokens import worker_tokenizer
from contentmark.session import materialize

WINDOW = 2048
SHARD_TOKENS = 1 << 20
SHARDS_PER_PART = 4
SAMPLE_PER_PART = 100      # documents that place the bounds of the ranges
ROUTE_TERMS = 3
K1, B = 1.2, 0.75
# Nothing is cut: every term of a seed is scored, however many documents have it.
QUERY_TERMS, MAX_POSTING_SHARE = None, 1.0
SEQUENCES_PER_PART = 1 << 32
END_ID = 1
# Rows of the table of ids that hold a total of their task instead of a term's count.
N_DOCS, N_TOKENS = -1, -2


class Statistics:
    """Documents, mean length and documents by term of a corpus."""

    def __init__(self, counts: dict):
        import numpy as np
        self.n_docs, self.n_tokens = counts.get(N_DOCS, 0), counts.get(N_TOKENS, 0)
        self.mean = max(1.0, self.n_tokens / max(1, self.n_docs))
        self.df = np.zeros(max(counts, default=0) + 1 if counts else 1, np.int64)
        for term, n in counts.items():
            if term >= 0:
                self.df[term] = n

    @classmethod
    def of(cls, docs) -> Statistics:
        import numpy as np
        counts = {N_DOCS: len(docs), N_TOKENS: sum(map(len, docs))}
        if docs:
            terms, df = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
            counts |= dict(zip(terms.tolist(), df.tolist()))
        return cls(counts)

    def idf(self, terms):
        import numpy as np
        df = self.df[terms]
        return np.log(1 + (self.n_docs - df + 0.5) / (df + 0.5))

    def norm(self, lengths):
        return K1 * (1 - B + B * lengths / self.mean)


class Index:
    """BM25 inverted index of one shard: posting lists by term, over entries
    (distinct texts).  Weights are those of the corpus that ``stats`` describes, by
    default the shard."""

    def __init__(self, docs, stats: Statistics | None = None):
        import numpy as np
        stats = stats or Statistics.of(docs)
        entry: dict[bytes, int] = {}
        self.entry = [entry.setdefault(d.tobytes(), len(entry)) for d in docs]
        self.members: list[list[int]] = [[] for _ in entry]
        for i, e in enumerate(self.entry):
            self.members[e].append(i)
        self.unused = [m[::-1] for m in self.members]      # next one last
        self.alive, self.indexed, self.gone = np.ones(len(entry), bool), len(entry), 0
        texts = [docs[m[0]] for m in self.members]
        lengths = np.array([len(d) for d in texts], float)
        norm = stats.norm(lengths)
        if texts:
            term = np.concatenate(texts).astype(np.int64)
            key = np.repeat(np.arange(len(texts), dtype=np.int64), lengths.astype(np.int64)) | term << 32
            key.sort()
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
            tf = np.diff(np.append(new, len(key)))
            key = key[new]
        else:
            key, tf = np.zeros(0, np.int64), np.zeros(0, np.int64)
        term, self.doc = key >> 32, key & 0xFFFFFFFF
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), term[1:] != term[:-1])))
        self.start = np.append(start, len(key))
        df = np.diff(self.start)
        at = np.repeat(np.arange(len(df)), df)
        self.weight = np.repeat(stats.idf(term[start]), df) * tf * (K1 + 1) / (tf + norm[self.doc])
        # the terms of every entry, as query; a term of one document finds only that
        copies = np.array([len(m) for m in self.members], np.int64)
        row = np.flatnonzero(np.bincount(at, copies[self.doc], len(df))[at] > 1)
        row = row[np.argsort(self.doc[row], kind="stable")]
        self.q_term = at[row]
        self.q_start = np.searchsorted(self.doc[row], np.arange(len(texts) + 1))

    def entries(self, i: int) -> Iterator[int]:
        """Entries sharing terms with document i, best first."""
        import numpy as np
        e = self.entry[i]
        q = self.q_term[self.q_start[e]:self.q_start[e + 1]]
        spans = list(zip(self.start[q].tolist(), self.start[q + 1].tolist()))
        if not spans:
            return
        hits = np.concatenate([self.doc[a:b] for a, b in spans])
        gain = np.concatenate([self.weight[a:b] for a, b in spans])
        if 8 * len(hits) < len(self.members):
            found, at = np.unique(hits, return_inverse=True)
            total = np.bincount(at, gain, len(found))
        else:
            total = np.bincount(hits, gain, len(self.members))
            found = np.flatnonzero(total)
            total = total[found]
        some = 64      # sorted in growing parts, as a window takes few
        while len(found):
            now = total >= (np.partition(total, -some)[-some] if some < len(found) else 0)
            best, score = found[now], total[now]
            yield from best[np.lexsort((best, -score))].tolist()
            found, total, some = found[~now], total[~now], 4 * some

    def neighbours(self, i: int) -> list[int]:
        """Documents sharing terms with document i, best first."""
        return [d for e in self.entries(i) for d in self.members[e]]

    def next_of(self, i: int) -> Iterator[int]:
        """The unused among the neighbours; each is to be used before the next."""
        for e in self.entries(i):
            while self.unused[e]:
                yield self.unused[e][-1]

    def use(self, i: int) -> None:
        """Document i, the first unused one of its entry, is used."""
        e = self.entry[i]
        self.unused[e].pop()
        if not self.unused[e]:
            self.alive[e] = False
            self.gone += 1
            if 4 * self.gone > self.indexed:
                self._compact()

    def _compact(self) -> None:
        import numpy as np
        keep = self.alive[self.doc]
        self.start = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[self.start]
        self.doc, self.weight = self.doc[keep], self.weight[keep]
        self.indexed, self.gone = self.indexed - self.gone, 0


def order_by_retrieval(docs, fill: int = 0, window: int = WINDOW,
                       stats: Statistics | None = None) -> Iterator[int]:
    """Order in which the documents of a shard enter the windows, the first of
    which holds ``fill`` ids already.  The document cut at a window's end seeds
    the next window; without one, or without unused neighbours, the next unused
    document is the seed."""
    index = Index(docs, stats)
    used = bytearray(len(docs))
    queue: Iterator[int] = iter(())
    upcoming = 0
    while True:
        k = next(queue, None)
        seed = k is None
        if seed:
            while upcoming < len(docs) and used[upcoming]:
                upcoming += 1
            if upcoming == len(docs):
                return
            k = upcoming
        used[k] = 1
        index.use(k)
        yield k
        crossed = fill + len(docs[k]) >= window
        fill = (fill + len(docs[k])) % window
        if seed or crossed:
            queue = index.next_of(k) if fill else iter(())


def _read_ids(batch, at: int):
    """The id arrays of a batch; column ``at`` has the bytes, the next one the counts."""
    import numpy as np
    for raw, n in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()):
        yield np.frombuffer(raw, f"<u{len(raw) // n}")


def _tokenise(path: str, end_id: int):
    """(doc_id, ids, n, null) for every document - ids in two bytes where the
    vocabulary allows - and at the end of a task (null, null, count, term)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        encode = worker_tokenizer(path)
        size = max(encode.tokenizer.get_vocab_size(), end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        counts, docs, tokens = np.zeros(size, np.int64), 0, 0
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]

        def table(*cols):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["doc_id", "ids", "n", "term"])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                raws, sizes, found = [], [], []
                for k, raw in enumerate(encode([t or "" for t in some.column(1).to_pylist()])):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype(kind)
                    found.append(ids.astype(np.int64) << 16 | k)
                    raws.append(ids.tobytes())
                    sizes.append(len(ids))
                pairs = np.concatenate(found)
                if size <= 1 << 16:
                    pairs = pairs.astype(np.uint32)
                pairs.sort()
                pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
                counts += np.bincount(pairs >> 16, minlength=size)
                docs, tokens = docs + len(sizes), tokens + sum(sizes)
                yield table(some.column(0).to_pylist(), raws, sizes, [None] * len(sizes))
        terms = np.flatnonzero(counts)
        totals = [*counts[terms].tolist(), docs, tokens]
        yield table([None] * len(totals), [None] * len(totals), totals, [*terms.tolist(), N_DOCS, N_TOKENS])
    return run


def route(ids, stats: Statistics) -> list[int]:
    """The ``ROUTE_TERMS`` terms of a document with the largest BM25 weights
    among those that other documents share, heaviest first (-1: none)."""
    import numpy as np
    terms, tf = np.unique(ids, return_counts=True)
    shared = stats.df[terms] > 1
    terms, tf = terms[shared].astype(np.int64), tf[shared]
    weight = stats.idf(terms) * tf * (K1 + 1) / (tf + stats.norm(len(ids)))
    top = terms[np.lexsort((terms, -weight))[:ROUTE_TERMS]].tolist()
    return top + [-1] * (ROUTE_TERMS - len(top))


def _routed(stats: Statistics, bounds: list[tuple] | None = None):
    """Adds the route and the number of the range it falls in."""
    def run(batches):
        from bisect import bisect_right

        import pyarrow as pa
        names = ["doc_id", "ids", "n", "digest", "row", *[f"r{k}" for k in range(ROUTE_TERMS)], "part"]
        for batch in batches:
            routes = [route(ids, stats) for ids in _read_ids(batch, 1)]
            keys = zip(routes, batch.column(3).to_pylist(), batch.column(4).to_pylist())
            part = [bisect_right(bounds or [], (*r, d, row)) for r, d, row in keys]
            cols = [pa.array([r[k] for r in routes], pa.int64()) for k in range(ROUTE_TERMS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, pa.array(part, pa.int32())], names=names)
    return run


def _pack(stats: Statistics, window: int, shard_tokens: int):
    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        state = {"seq": part * SEQUENCES_PER_PART}
        tail: list[tuple] = []   # pieces of the open window: (id, start, ids, doc_tokens)

        def sequence(pieces):
            """Rows of one finished sequence."""
            rows, off = [], 0
            for i, start, ids, total in pieces:
                rows.append((i, start, len(ids), zlib.crc32(ids.tobytes()), total, state["seq"], off))
                off += len(ids)
            state["seq"] += 1
            return rows

        def place(shard):
            """Cut a shard's documents, in retrieval order, at the windows."""
            nonlocal tail
            rows = []
            fill = sum(len(p[2]) for p in tail)
            for k in order_by_retrieval([d for _, d in shard], fill, window, stats):
                i, ids = shard[k][0], shard[k][1].astype("<u4")
                at = 0
                while at < len(ids):
                    take = min(len(ids) - at, window - fill)
                    tail.append((i, at, ids[at:at + take], len(ids)))
                    at, fill = at + take, fill + take
                    if fill == window:
                        rows += sequence(tail)
                        tail, fill = [], 0
            return rows

        def last():
            """The open window, cut into powers of two."""
            rows, pieces = [], list(tail)
            left = sum(len(p[2]) for p in pieces)
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                now = []
                while room:
                    i, start, ids, total = pieces.pop(0)
                    now.append((i, start, ids[:room], total))
                    if len(ids) > room:
                        pieces.insert(0, (i, start + room, ids[room:], total))
                    room -= len(now[-1][2])
                rows += sequence(now)
            return rows

        def table(rows):
            cols = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
        shard, size = [], 0
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), _read_ids(batch, 1)):
                shard.append((i, ids))
                size += len(ids)
                if size >= shard_tokens:
                    yield table(place(shard))
                    shard, size = [], 0
        yield table(place(shard) + last())
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Every id of every document lies in one piece."""
    t = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = materialize(t.mapInArrow(_tokenise(tokenizer_path, end_id),
                                     "doc_id bigint, ids binary, n bigint, term bigint"), "pack-ids")
    # one row per term of the vocabulary
    counts = table.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()
    stats = Statistics({r["term"]: r["n"] for r in counts})
    order = [*[f"r{k}" for k in range(ROUTE_TERMS)], "digest", "row"]
    kinds = "doc_id bigint, ids binary, n bigint, " + ", ".join(f"{k} bigint" for k in ["digest", "row", *order[:-2]])
    rows = table.where("term is null").select("doc_id", "ids", "n", F.xxhash64("ids").alias("digest"),
                                              F.monotonically_increasing_id().alias("row"))
    # as a range shuffle does, but only the sample is routed twice
    parts = -(-stats.n_tokens // (SHARDS_PER_PART * shard_tokens)) or 1
    share = min(1.0, parts * SAMPLE_PER_PART / max(1, stats.n_docs))
    some = rows.sample(share, seed=42) if parts > 1 else rows.limit(0)
    sample = sorted(tuple(r) for r in some.mapInArrow(_routed(stats), kinds + ", part int").select(*order).collect())
    bounds = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    routed = rows.mapInArrow(_routed(stats, bounds), kinds + ", part int")
    return (routed.repartitionById(parts, F.col("part")).sortWithinPartitions(*order).select("doc_id", "ids", "n")
            .mapInArrow(_pack(stats, window, shard_tokens),
                        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                        "sequence_id bigint, offset bigint"))
