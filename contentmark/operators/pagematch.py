"""Write-back (R3-R10) of pages of ordinary size, page by page.

A page's packed tree and text and its blocks meet in one task and are matched there: one
shuffle by page, no rows per occurrence or ancestor.  Rows are sorted by page and read
as a stream, so a task holds one page and one Arrow batch.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import contentmark
from contentmark.operators.htmltree import unpack_tree

# Ship the package with the task closures, so executors need no install.
cloudpickle.register_pickle_by_value(contentmark)

PIECE = 1 << 22     # characters of a page's text and blocks matched in one piece
WORK = 1 << 32      # characters of its text, or elements, times blocks
HITS, COUNTS, RESOLVED, LABELS = "hits", "counts", "resolved", "labels"
BKEY = ("page_id", "part", "pos")
TIERS = (1, 2, 3, 4, 5, 6)
_ROWS = 32768
_SLICE = 1024     # rows made Python objects at a time
# ``^"|"$`` as Java reads it: its ``$`` also stands before a last line end
_OUTER = re.compile(r'^"|"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)')


class Page:
    def __init__(self, text: str, bare: str, tree: bytes, tags: str):
        self.text, self.bare = text, bare
        self.tags, self.parents, self.k0, self.k1, _, self.starts, self.owner = unpack_tree(tree, tags)
        self._chain = self._covered = (None, None)
        self._lengths, self._keys = None, {}

    def places(self, needle: str) -> set:
        """(innermost element around it, is it in one run) of the needle's occurrences.  A
        start is looked for only where the runs that the occurrence begins and ends in change."""
        text, starts, owner, n = self.text, self.starts, self.owner, len(needle)
        out, p = set(), text.find(needle)
        while p >= 0:
            a = bisect_right(starts, p) - 1
            a_end = starts[a + 1] if a + 1 < len(starts) else len(text)
            x = owner[a]
            if p + n <= a_end:
                b_end = a_end
                out.add((x, True))
            else:
                b = bisect_right(starts, p + n - 1) - 1
                b_end = starts[b + 1] if b + 1 < len(starts) else len(text)
                y = owner[b]
                while x != y:       # an element comes after its ancestors
                    if x > y:
                        x = self.parents[x]
                    else:
                        y = self.parents[y]
                out.add((x, False))
            p = text.find(needle, max(p + 1, min(a_end, b_end - n + 1)))
        return out

    def covered(self, needle: str) -> tuple:
        """By tag, the elements whose own run holds the needle and those whose text does.  Each
        element is met once, however many occurrences it covers.  Kept for the next target."""
        if self._covered[0] != needle:
            if needle == "":        # it is in every text
                own, around = {x for x in self.owner if x >= 0}, range(len(self.tags))
            else:
                own, around = set(), set()
                for x, one in self.places(needle):
                    if one and x >= 0:
                        own.add(x)
                    while x >= 0 and x not in around:
                        around.add(x)
                        x = self.parents[x]
            by_tag = {}, {}
            for found, xs in zip(by_tag, (own, around)):
                for x in xs:
                    found.setdefault(self.tags[x], []).append(x)
            self._covered = needle, by_tag
        return self._covered[1]

    def below(self, want: tuple) -> list:
        """Of every element: do its ancestors hold the tags ``want`` in order, root first?  An
        element goes on from what its parent has found of them."""
        if self._chain[0] != want:
            n, found, out = len(want), [], []
            for tag, parent in zip(self.tags, self.parents):
                k = found[parent] if parent >= 0 else 0
                out.append(k == n)
                found.append(k + 1 if k < n and want[k] == tag else k)
            self._chain = want, out
        return self._chain[1]

    def first_tiers(self, target, tiers=(1, 2, 3, 4)) -> list:
        """(tier, element) by containment."""
        t_tag, t_parent, chain, needle = target[:4]
        if needle is None:
            return []
        own, around = self.covered(needle)
        hits, mine = [], around.get(t_tag, ())
        if 1 in tiers:
            hits += [(1, x) for x in own.get(t_tag, ())]
        if 2 in tiers:
            hits += [(2, x) for x in around.get(t_parent, ())]
        if 3 in tiers and t_parent is not None:
            hits += [(3, x) for x in mine if self.parents[x] >= 0 and self.tags[self.parents[x]] == t_parent]
        if 4 in tiers and mine:
            below = self.below(chain[:-1])
            hits += [(4, x) for x in mine if below[x]]
        return hits

    def equal_tiers(self, target) -> list:
        """(tier, element) by equality of the whole text."""
        t_tag, t_parent, _, _, joined = target
        if joined is None:
            return []
        key = "".join(_OUTER.sub("", joined).split())
        n = len(key)
        if self._lengths is None:
            self._lengths = {}
            for x, (a, b) in enumerate(zip(self.k0, self.k1)):
                self._lengths.setdefault(b - a, []).append(x)
        if n not in self._keys:
            self._keys[n] = keys = {}
            for x in self._lengths.get(n, ()):
                keys.setdefault(self.bare[self.k0[x]:self.k1[x]], []).append(x)
        same = self._keys[n].get(key, ())
        return [(5, x) for x in same if self.tags[x] == t_tag] + [(6, x) for x in same if self.tags[x] == t_parent]

    def every_tier(self, target) -> list:
        return [*self.first_tiers(target), *self.equal_tiers(target)]

    def cascade(self, target) -> list:
        """The hits of the deciding tier; a tier is looked at if those before leave it open."""
        first = self.first_tiers(target, (1,))
        if len(first) == 1:
            return first
        for tier in (3, 4) if first else (2, 3, 4):
            hits = self.first_tiers(target, (tier,))
            if len(hits) == 1:
                return hits
        hits = self.equal_tiers(target)
        tier = 5 if sum(t == 5 for t, _ in hits) == 1 else 6
        return [h for h in hits if h[0] == tier]


def _rows_of(emit: str, page: Page | None, blocks: list):
    """Result rows of one page; blocks: (part, pos, label, target).  Equal targets are matched once."""
    match = (lambda t: ()) if page is None else page.every_tier if emit in (HITS, COUNTS) else page.cascade
    # by needle and chain, of which a page keeps the last
    found = {t: match(t) for t in sorted({b[3] for b in blocks}, key=lambda t: (t[3] or "", t[2] is None, repr(t[2])))}
    labels = {}
    for part, pos, label, target in sorted(blocks, key=lambda b: [(x is not None, x or 0) for x in b[:2]]) \
            if emit == LABELS else blocks:
        hits = found[target]
        if emit == LABELS:      # later blocks override earlier ones
            for _, x in hits:
                labels[x] = label
        elif emit == COUNTS:
            n = [0] * len(TIERS)
            for tier, _ in hits:
                n[tier - 1] += 1
            yield part, pos, *n
        else:
            for tier, x in hits:
                yield part, pos, tier, x
    yield from labels.items()


def _match_batches(batches, emit: str, names: list):
    schema, out, ids = None, [], []
    page_id, page, blocks = None, None, []

    def flush():
        cols = [pa.array(ids, schema.types[0]),
                *[pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * (len(names) - 1), schema.types[1:])]]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def done():
        for row in _rows_of(emit, page, blocks):
            ids.append(page_id)
            out.append(row)

    for batch in (b.slice(k, _SLICE) for b in batches for k in range(0, b.num_rows, _SLICE)):
        if schema is None:
            kinds = {"tier": pa.int32(), "pre": pa.int32(), **{f"n{t}": pa.int64() for t in TIERS}}
            schema = pa.schema([pa.field(c, kinds.get(c) or batch.schema.field(c).type) for c in names])
        for key, text, bare, tree, tags, part, pos, label, tag, parent, chain, needle, joined in zip(*(
                batch.column(c).to_pylist() for c in _COLUMNS)):
            if key != page_id:
                if blocks:
                    done()
                page_id, page, blocks = key, None, []
                if len(out) >= _ROWS:
                    yield flush()
                    ids, out = [], []
            if tree is not None:
                page = Page(text, bare, tree, tags)
            else:
                blocks.append((part, pos, label, (tag, parent, None if chain is None else tuple(chain), needle, joined)))
    if blocks:
        done()
    if out:
        yield flush()


_COLUMNS = ("page_id", "text", "wtext", "tree", "tags", "part", "pos", "label", "t_tag", "t_parent", "chain",
            "needle", "joined")


def match_pages(docs: DataFrame, targets: DataFrame, emit: str) -> DataFrame:
    """Blocks (``targets``: page_id, part, pos, label, t_tag, t_parent, chain, needle, joined)
    matched to the elements of their page (``docs``: its ``doc`` row, once).

    ``hits``: (page_id, part, pos, tier, pre) of every tier; ``counts``: n1 .. n6 of every block;
    ``resolved``: the hits of the deciding tier; ``labels``: (page_id, pre, label)."""
    names = ["page_id", "pre", "label"] if emit == LABELS else [*BKEY, *(
        [f"n{t}" for t in TIERS] if emit == COUNTS else ["tier", "pre"])]
    of = {"tier": T.IntegerType(), "pre": T.IntegerType(), **{f"n{t}": T.LongType() for t in TIERS}}
    types = T.StructType([T.StructField(c, of.get(c) or targets.schema[c].dataType) for c in names])
    docs = docs.where(F.col("page_id").isNotNull())
    rows = docs.select("page_id", "text", "wtext", "tree", "tags").unionByName(
        targets.select(*[c for c in _COLUMNS if c not in ("text", "wtext", "tree", "tags")]), allowMissingColumns=True)
    rows = rows.repartition("page_id").sortWithinPartitions("page_id")
    return rows.select(*_COLUMNS).mapInArrow(lambda batches: _match_batches(batches, emit, names), types)
