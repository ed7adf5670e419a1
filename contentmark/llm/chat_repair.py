"""Conversation repair by integer-minimum dynamic programming.

A conversation should read ``(s?(ua)+)?`` in role initials.  Rows are kept,
given the role user or assistant, or deleted, and empty turns may be inserted;
the cheapest edits win, and of equally cheap ones the ASCII-least string of
their initials (D, I, K, R; the *audit*).

Every path of the edit graph has one integer as its weight: the cost in the
high digits, below it one octal digit for each audit letter in its place (D=1,
I=2, K=3, R=4).  Appending an edit is ``8 w + letter`` plus its cost above
all letters, so the smaller integer is the cheaper path or, at equal cost, the
smaller audit; at the end audits of different lengths are padded with zero
digits to one width, so a prefix is the smaller string.  The plain minimum of
integers at each node (role state, number of inserted turns) decides everything.

Rows are streamed, one pass over sorted partitions.  Two exact reductions keep a
conversation of any length in small memory.  A node dearer than the cheapest
by over ``2 * insert + delete`` cannot be on a best path (any continuation can
be followed from the cheapest node by inserting two turns at most and deleting
one system row).  Leading letters that all remaining nodes share are
written out and dropped from the weights.  Each node carries a running SHA-256 of
its repaired text instead of the text itself.

Defined cases: a null conversation is one conversation; any other null is one
space (a null turn sorts first and is left out of gaps); rows of one turn are
ordered by role, then text; texts are hashed as UTF-8; equal rows are
duplicates; a conversation that loses all rows keeps its line with zeros, the
empty audit and the digest of the empty string; a role is told by its first
character as it stands; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ROLES = {"u": "user", "a": "assistant"}
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)   # role states: what stands last
STEP = {"s": ((EMPTY, SYSTEM),), "u": ((EMPTY, USER), (SYSTEM, USER), (ASSISTANT, USER)),
        "a": ((USER, ASSISTANT),)}
SETTLE = 32   # rows between two looks for letters that all nodes share


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5   # of a truncated row that is not deleted


class Repair:
    """The nodes reached after the rows seen so far."""

    def __init__(self, costs: Costs):
        import hashlib
        self.costs, self.rows, self.done, self.base = costs, 0, [], 0
        self.nodes = {(EMPTY, 0): (0, hashlib.sha256())}   # (state, inserted): weight, text

    def _length(self, inserted: int) -> int:
        return 3 * (self.rows - len(self.done) + inserted)

    def _cost(self, node) -> int:
        return self.nodes[node][0] >> self._length(node[1])

    def _insert(self) -> None:
        """Inserted turns, in order of their number, while a best path may have them."""
        margin = 2 * self.costs.insert + self.costs.delete
        bound = min(map(self._cost, self.nodes)) + margin
        todo = sorted({t for _, t in self.nodes})
        while todo:
            t = todo.pop(0)
            bits = self._length(t + 1)
            for role, steps in (("u", STEP["u"]), ("a", STEP["a"])):
                best = min(((self.nodes[p, t][0], p) for p, _ in steps if (p, t) in self.nodes), default=None)
                if best is None:
                    continue
                w = (best[0] << 3) + INSERT + (self.costs.insert << bits)
                node = steps[0][1], t + 1
                if w >> bits <= bound and (node not in self.nodes or w < self.nodes[node][0]):
                    text = self.nodes[best[1], t][1].copy()
                    text.update(("" if best[1] == EMPTY else "\n").encode() + f"{ROLES[role]}:".encode())
                    self.nodes[node] = w, text
                    if t + 1 not in todo:
                        todo.append(t + 1)
        self.nodes = {n: x for n, x in self.nodes.items() if self._cost(n) <= bound}

    def add(self, role: str, text: str, fault: int) -> None:
        self._insert()
        edits = [(None, DELETE, self.costs.delete)]
        if fault not in (BLANK, DUPLICATE):
            more = self.costs.truncated if fault == TRUNCATED else 0
            if role[:1] in STEP:
                edits.append((role[:1], KEEP, more))
            edits += [(r, REROLE, more + self.costs.rerole) for r in ROLES]
        best = {}
        for (state, t), (w, _) in self.nodes.items():
            bits = self._length(t) + 3
            for to, letter, cost in edits:
                for a, b in STEP[to] if to else ((state, state),):
                    if a == state:
                        new = (w << 3) + letter + (cost << bits)
                        if (b, t) not in best or new < best[b, t][0]:
                            best[b, t] = new, state, to, letter
        self.rows += 1
        body = (":" + text).encode("utf-8", "surrogatepass")
        nodes = {}
        for (b, t), (w, a, to, letter) in best.items():
            sha = self.nodes[a, t][1]
            if letter != DELETE:
                sha = sha.copy()
                sha.update((("" if a == EMPTY else "\n") + (role if letter == KEEP else ROLES[to])).encode(
                    "utf-8", "surrogatepass") + body)
            nodes[b, t] = w, sha
        self.nodes = nodes
        if self.rows % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        """Write out the letters that all nodes share, take off their common cost."""
        most = max(self._length(t) for _, t in self.nodes)
        least = min(self._length(t) for _, t in self.nodes)
        letters = {n: w & ((1 << self._length(n[1])) - 1) for n, (w, _) in self.nodes.items()}
        padded = [x << (most - self._length(n[1])) for n, x in letters.items()]
        apart = -(-(min(padded) ^ max(padded)).bit_length() // 3) * 3
        shared = min(most - apart, least) // 3
        costs = {n: self._cost(n) for n in self.nodes}
        low = min(costs.values())
        prefix = padded[0] >> (most - 3 * shared)
        kept = {n: (self._length(n[1]) - 3 * shared) for n in self.nodes}
        self.nodes = {n: (((costs[n] - low) << kept[n]) | (letters[n] & ((1 << kept[n]) - 1)), self.nodes[n][1])
                      for n in self.nodes}
        self.base += low
        self.done += [prefix >> 3 * k & 7 for k in range(shared - 1, -1, -1)]

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the best path."""
        self._insert()
        ends = [n for n in self.nodes if n[0] in (EMPTY, ASSISTANT)]
        width = max(self._length(t) for _, t in ends)
        w, end = min((self.nodes[n][0] << (width - self._length(n[1])), n) for n in ends)
        digits = self.done + [w >> 3 * k & 7 for k in range(width // 3 - 1, -1, -1)]
        audit = "".join(LETTERS[d] for d in digits).rstrip("\0")
        return self.base + (w >> width), audit, self.nodes[end][1].hexdigest()


class Conversation:
    """Counts and repair of one conversation, row by row in order."""

    def __init__(self, costs: Costs):
        self.repair = Repair(costs)
        self.seen, self.faults, self.illegal = set(), [0, 0, 0, 0], 0
        self.last = self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn, role: str, text: str) -> None:
        import hashlib
        words = text.strip(" \t\n\x0b\f\r")
        r = role.encode("utf-8", "surrogatepass")
        key = hashlib.blake2b(b"%d:" % len(r) + r + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        fault = (BLANK if not words else DUPLICATE if key in self.seen
                 else TRUNCATED if words[-1] not in ".!?" else 0)
        self.seen.add(key)
        self.faults[fault] += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:   # turns arrive in order
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        cost, audit, digest = self.repair.result()
        return (gaps, *self.faults[1:], self.illegal, cost, audit, digest)


OUT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
       "audit string, repaired_sha256 string")


def _stream(costs: Costs, names: list[str]):
    """Rows (conv, there, turn, role, text) sorted by conversation and order;
    ``there`` is false for a row that only names its conversation."""
    def run(batches):
        import pyarrow as pa
        kind = now = None
        started, out = False, []

        def flush():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]],
                 pa.array(cols[7], pa.string()), pa.array(cols[8], pa.string())], names=names)
        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                for c, there, turn, role, text in zip(*[part.column(j).to_pylist() for j in range(5)]):
                    if not started or c != now:
                        if started:
                            out.append((now, *conv.row()))
                        started, now, conv = True, c, Conversation(costs)
                    if there:
                        conv.add(turn, role, text)
                if len(out) >= 1024:
                    yield flush()
                    out = []
        if started:
            out.append((now, *conv.row()))
            yield flush()
    return run


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, there, turn, role, text): the rows after damage by
    ``crc32(conv_id:turn) % 20`` (0 drops the row, 1 empties its text, 2 removes
    its sentence marks, 3 repeats it, 4 makes it a user's).  A dropped row
    stays as a line with ``there`` false, so its conversation is still named."""
    def spaced(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(F.col(conv_col)), F.lit(":"), spaced(F.col(turn_col)))) % 20
    text = spaced(F.col(text_col))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), (kind != 0).alias("there"), F.col(turn_col).cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(spaced(F.col(role_col))).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"))
    return rows.withColumn("_x_time", F.explode("times")).drop("times", "_x_time")


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One line per conversation of ``damage``-shaped rows: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = rows.select("conv_id", "there", "turn", "role", "text")
    key = rows.schema["conv_id"]
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    schema = StructType([StructField("conv_id", key.dataType)] + StructType.fromDDL(OUT).fields)
    return ordered.mapInArrow(_stream(costs, schema.names), schema)


def apply_audits(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position from 0, role, text)."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    own = rows.where("there").withColumn("i", F.row_number().over(order)).select(
        F.col("conv_id").alias("c"), "i", F.col("role").alias("own"), "text")
    letters = repaired.select("conv_id", F.posexplode(F.split("audit", "")).alias("k", "letter")).where("letter <> ''")
    so_far = Window.partitionBy("conv_id").orderBy("k")
    letters = letters.withColumn("i", F.sum((F.col("letter") != "I").cast("int")).over(so_far))
    took = letters.where("letter <> 'I'").join(
        own.withColumnRenamed("i", "j"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("i") == F.col("j")))
    kept = (took.where("letter <> 'D'").select("conv_id", "k", "letter", "own", "text")
            .unionAll(letters.where("letter = 'I'").select("conv_id", "k", "letter", F.lit(None).cast("string"), F.lit(""))))
    kept = kept.withColumn("position", F.row_number().over(so_far) - 1)
    head = F.first(F.when(F.col("letter") == "K", F.col("own"))).over(so_far.rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    system = F.coalesce(F.substring(F.first("own").over(so_far), 1, 1) == "s", F.lit(False)) & (
        F.first("letter").over(so_far) == "K") & head.isNotNull()
    turn = (F.col("position") - system.cast("int")) % 2
    return kept.select("conv_id", "position", F.when(F.col("letter") == "K", F.col("own"))
                       .when(turn == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), "text")
