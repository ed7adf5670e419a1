"""Token files as wavelet matrices.

Documents in ascending id order are tokenised and cut into shards of about
``SHARD_TOKENS`` ids.  A shard's ids are stored as one wavelet matrix: a bit
plane per id bit, each plane the stable partition of the one before, with a rank
directory.  From the bytes alone it answers ``access`` (id at a place),
``rank`` / ``count`` (how often an id occurs) and ``select`` (where its k-th
occurrence is) in one step per plane.

Format of a shard (little-endian): ``WMX1``, u32 planes, u64 ids; per plane u64
zeros, then the packed bits (bit 0 first) and u32 ones before each 512-bit block.
Shards are rows of a Parquet table (part, shard, at, doc_ids,
doc_lengths, n_tokens, matrix; at: ids before it in its part), so any store Spark writes to will do, and a lost task is
written again.

Documents are ordered by a range shuffle (no one-task sort); only token counts
per partition are summed in one place.

Defined cases: null text is empty (its end id alone); repeated rows are documents
of their own, equal ids in the order of a text digest; null ids come first; an
empty table gives no rows; a document longer than a shard is a shard of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentmark.llm.common import text_or_empty
from contentmark.llm.tokens import worker_tokenizer
from contentmark.session import materialize

SHARD_TOKENS = 1 << 18
MAGIC, BLOCK = b"WMX1", 512
END_ID = 2


class WaveletMatrix:
    """Succinct sequence of unsigned integers below 2 ** planes."""

    def __init__(self, n, zeros, bits, ranks):
        self.n, self.zeros, self.bits, self.ranks = n, zeros, bits, ranks

    @classmethod
    def build(cls, ids, planes: int):
        import numpy as np
        kind = np.uint16 if planes <= 16 else np.uint32
        ids = np.asarray(ids).astype(kind)
        zeros, bits, ranks = [], [], []
        for k in range(planes - 1, -1, -1):
            bit = (ids & kind(1 << k)).astype(bool)
            zeros.append(len(ids) - int(bit.sum()))
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8))
            ones = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1)
            bits.append(packed)
            ranks.append(np.concatenate(([0], np.cumsum(ones))).astype("<u4"))
            ids = np.concatenate((ids[~bit], ids[bit]))
        return cls(len(ids), zeros, bits, ranks)

    def to_bytes(self) -> bytes:
        import struct
        out = [MAGIC, struct.pack("<IQ", len(self.zeros), self.n)]
        for z, b, r in zip(self.zeros, self.bits, self.ranks):
            out += [struct.pack("<Q", z), b.tobytes(), r.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes):
        import struct

        import numpy as np
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        planes, n = struct.unpack_from("<IQ", raw, 4)
        blocks = -(-n // BLOCK)
        at, zeros, bits, ranks = 16, [], [], []
        for _ in range(planes):
            zeros.append(struct.unpack_from("<Q", raw, at)[0])
            bits.append(np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at + 8))
            ranks.append(np.frombuffer(raw, "<u4", blocks + 1, at + 8 + blocks * BLOCK // 8))
            at += 8 + blocks * BLOCK // 8 + 4 * (blocks + 1)
        return cls(n, zeros, bits, ranks)

    def _bit(self, plane: int, i: int) -> int:
        return int(self.bits[plane][i >> 3]) >> (i & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        part = int.from_bytes(self.bits[plane][block * BLOCK // 8:-(-i // 8)].tobytes(), "little")
        return int(self.ranks[plane][block]) + (part & (1 << i - block * BLOCK) - 1).bit_count()

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for p in range(len(self.zeros)):
            b, ones = self._bit(p, i), self._ones(p, i)
            out = out << 1 | b
            i = self.zeros[p] + ones if b else i - ones
        return out

    def _range(self, symbol: int, a: int, b: int) -> tuple[int, int]:
        for p in range(len(self.zeros)):
            oa, ob = self._ones(p, a), self._ones(p, b)
            if symbol >> len(self.zeros) - 1 - p & 1:
                a, b = self.zeros[p] + oa, self.zeros[p] + ob
            else:
                a, b = a - oa, b - ob
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of an id among the first i places."""
        a, b = self._range(symbol, 0, i)
        return b - a

    def count(self, symbol: int, a: int = 0, b: int | None = None) -> int:
        x, y = self._range(symbol, a, self.n if b is None else b)
        return y - x

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        start, end = self._range(symbol, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError("no such occurrence")
        i = start + k
        for p in range(len(self.zeros) - 1, -1, -1):
            bit = symbol >> len(self.zeros) - 1 - p & 1
            i = self._select_bit(p, bit, i - self.zeros[p] if bit else i)
        return i

    def decode(self):
        """All ids in order: planes are undone from the last to the first."""
        import numpy as np
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for p in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.bits[p], count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(out)
            up[~bit] = out[:self.zeros[p]]
            up[bit] = out[self.zeros[p]:] | kind(1 << len(self.zeros) - 1 - p)
            out = up
        return out


def _encode(path: str, end_id: int, shard_tokens: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        encode = worker_tokenizer(path)
        planes = max(encode.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length()
        end = np.array([end_id], "<u4").tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        ids, texts, size, at = [], [], 0, 0

        def table():
            lengths = [len(t) // 4 for t in texts]
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(texts), "<u4"), planes).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([at], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([sum(lengths)], pa.int64()), pa.array([matrix], pa.binary())],
                names=["part", "shard", "at", "doc_ids", "doc_lengths", "n_tokens", "matrix"])
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(),
                              encode([t or "" for t in batch.column(1).to_pylist()])):
                ids.append(i)
                texts.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= shard_tokens:
                    yield table()
                    ids, texts, size, shard, at = [], [], 0, shard + 1, at + size
        if ids:
            yield table()
    return run


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the token files of all documents; returns the shard table."""
    t = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64(text_or_empty(F.col("text")))]
    placed = t.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(*order)
    shards = placed.mapInArrow(_encode(tokenizer_path, end_id, shard_tokens),
                               "part int, shard bigint, at bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
                               "n_tokens bigint, matrix binary")
    return materialize(shards, "token-shards")


def _decode(batches):
    import zlib

    import numpy as np
    import pyarrow as pa
    for batch in batches:
        for start, ids, lengths, raw in zip(*(c.to_pylist() for c in batch.columns)):
            data = WaveletMatrix.from_bytes(raw).decode().astype("<u4").tobytes()
            ends = np.cumsum(np.array(lengths, np.int64))
            at = ends - lengths
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(at + start), pa.array(lengths, pa.int64()),
                 pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document of a shard table: doc_id, start (ids before it), n_tokens
    and ids_crc32, from the decoded matrices."""
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the writing job
    offsets = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    return (shards.join(F.broadcast(offsets), F.col("part") == F.col("p"))
            .withColumn("start", F.col("at") + F.col("off"))
            .select("start", "doc_ids", "doc_lengths", "matrix")
            .mapInArrow(_decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
