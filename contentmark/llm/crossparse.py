"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text accepts exactly the
substrings of that text.  A document is parsed against it greedily: the
longest match from a place is one phrase, the next phrase starts where it ends.
Fewest phrases per character win - the text is cheapest to say in pieces of that
language (Ziv & Merhav's cross-parsing).

The automata read at most ``TRAIN_CHARS`` characters of labelled text per
language, pieces of at most ``PIECE_CHARS`` at seeded places of the whole texts of the
``TRAIN_PIECES`` documents with the smallest digests (the documented bound of the fit).  Prediction reads whole texts: they are cut
into segments of ``SEGMENT`` characters parsed in step, vectorised over all
segments of a batch; a cut adds at most one phrase, to every language alike.

All trained characters are told apart.  Up to ``MAX_CLASSES`` of them, an automaton
is a dense step table; with more (Han, kana, Hangul) a hash table of its transitions.

Text is folded before use: lower case, runs of other characters than letters
and marks (the Unicode categories L and M: Thai or Devanagari vowels are marks)
become one blank.  Letter-like numbers and symbols (``Ⅷ ½ ²``) are no letters.

Defined cases: null text and texts without a letter give ``und`` with score 0;
without any labelled language every text is ``und``; ties go to the smaller
language name; repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmark.llm.common import text_or_empty

TRAIN_CHARS, PIECE_CHARS, TRAIN_PIECES = 60_000, 2_000, 400
SEGMENT = 256
MAX_CLASSES = 255      # classes of a dense step table; with more letters it is sparse
UNKNOWN = "und"


def fold(text: str) -> str:
    import regex
    kept = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip()
    return kept if regex.search(r"\p{L}", kept) else ""


def automaton(text: str):
    """Suffix automaton as (transitions, states): a list of dicts."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def table(text: str, letters: str):
    """Dense step table of a language: entry ``state * classes + class`` is
    ``2 * next_row + new_phrase``, with the restart after a failed match
    already taken."""
    import numpy as np
    nxt = automaton(text)
    k = len(letters) + 1           # class 0: any other character
    code = {c: i + 1 for i, c in enumerate(letters)}
    step = np.full((len(nxt), k), -1, np.int32)
    for s, to in enumerate(nxt):
        for c, t in to.items():
            if c in code:
                step[s, code[c]] = t
    start = step[0].copy()
    restart = np.where(start < 0, 1, 2 * start * k + 1).astype(np.int32)   # 1: row 0, one phrase
    return np.where(step < 0, restart[None, :], 2 * step * k).astype(np.int32).ravel()


class SparseSteps:
    """The steps of ``table`` for many letters: an open-addressing hash table from
    ``state * classes + class`` to the entry; others restart."""

    def __init__(self, text: str, letters: str):
        import numpy as np
        k = len(letters) + 1
        code = {c: i + 1 for i, c in enumerate(letters)}
        nxt = automaton(text)
        pairs = np.array([(s * k + code[c], 2 * t * k) for s, to in enumerate(nxt) for c, t in to.items()
                          if c in code], np.int64).reshape(-1, 2)
        self.restart = np.ones(k, np.int64)
        for c, t in nxt[0].items():
            if c in code:
                self.restart[code[c]] = 2 * t * k + 1
        self.k = k
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits, np.int64)
        left, at = pairs, self._place(pairs[:, 0])
        while len(left):
            free = self.key[at] < 0
            self.key[at[free]] = left[free, 0]          # one of those that meet stays
            here = self.key[at] == left[:, 0]
            self.value[at[here]] = left[here, 1]
            left, at = left[~here], at[~here] + 1 & self.mask

    def _place(self, key):
        import numpy as np
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def take(self, want):
        import numpy as np
        out = self.restart[want % self.k]
        rest, at = np.arange(len(want)), self._place(want)
        while len(rest):
            key = self.key[at]
            here = key == want[rest]
            out[rest[here]] = self.value[at[here]]
            more = ~here & (key >= 0)
            rest, at = rest[more], at[more] + 1 & self.mask
        return out


def steps_of(text: str, letters: str):
    return table(text, letters) if len(letters) < MAX_CLASSES else SparseSteps(text, letters)


def _sample_text(labelled: DataFrame, seed: int) -> DataFrame:
    """(lang, pieces): of the ``TRAIN_PIECES`` documents of a language with the
    smallest digests, pieces up to the bound.  The rank limit is applied in
    every partition before the shuffle, so a hot language costs no more."""
    place = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id"), F.col("text")),
                   F.greatest(F.length("text") - F.lit(PIECE_CHARS - 1), F.lit(1)))
    some = labelled.select("lang", F.xxhash64(F.lit(seed), F.col("id"), F.col("text")).alias("d"),
                           F.substring(F.col("text"), place.cast("int") + 1, F.lit(PIECE_CHARS)).alias("piece"))
    by_digest = Window.partitionBy("lang").orderBy("d", "piece")
    some = some.withColumn("n", F.row_number().over(by_digest)).where(F.col("n") <= TRAIN_PIECES)
    before = F.sum(F.length("piece")).over(by_digest.rowsBetween(Window.unboundedPreceding, -1))
    return (some.withColumn("at", F.coalesce(before, F.lit(0))).where(F.col("at") < TRAIN_CHARS)
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "piece"))).alias("ps"))
            .select("lang", F.transform("ps", lambda p: p["piece"]).alias("pieces")))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", seed: int = 42) -> dict:
    """The folded training texts: {"texts": {lang: text}, "letters": str}.
    Only rows for which ``learn`` holds and the language is known are read."""
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), text_or_empty(F.col(text_col)).alias("text"),
        F.col(lang_col).cast("string").alias("lang")).where(F.length("text") > 0)
    texts = {r["lang"]: " ".join(map(fold, r["pieces"])) for r in _sample_text(rows, seed).collect()}
    letters = "".join(sorted(set().union(*texts.values())))
    return {"texts": {k: texts[k] for k in sorted(texts)}, "letters": letters}


def phrases(flat, sizes, steps):
    """Phrases of every segment.  ``flat``: classes of all segments (padded
    rows, one per segment), ``sizes``: their lengths, longest first."""
    import numpy as np
    state = np.zeros(len(sizes), np.int64 if isinstance(steps, SparseSteps) else np.int32)
    count = np.zeros(len(sizes), np.int32)
    alive = np.searchsorted(-sizes, -np.arange(1, flat.shape[0] + 1), side="right")
    for i in range(flat.shape[0]):
        n = alive[i]
        if not n:
            break
        v = steps.take(state[:n] + flat[i, :n])
        count[:n] += v & 1
        state[:n] = v >> 1
    return count


def _predict(model):
    letters, texts = model["letters"], model["texts"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        langs = list(texts)
        tables = [steps_of(texts[g], letters) for g in langs]
        code = np.zeros(0x110000, np.int32)
        for i, c in enumerate(letters):
            code[ord(c)] = i + 1
        for batch in batches:
            folded = [fold(t) if t else "" for t in batch.column(1).to_pylist()]
            best = [UNKNOWN] * len(folded)
            score = [0.0] * len(folded)
            some = [k for k, t in enumerate(folded) if t] if langs else []
            for k in range(0, len(some), 1024):
                rows = some[k:k + 1024]
                for r, b, s in zip(rows, *parse([folded[r] for r in rows], tables, code)):
                    best[r], score[r] = langs[b], s
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best), pa.array(score, pa.float64())],
                names=["id", "lang_pred", "score"])
    return run


def parse(folded, tables, code):
    """(index of the winning table, score) for each folded text."""
    import numpy as np
    flat = code[np.frombuffer("".join(folded).encode("utf-32-le"), "<u4")]
    size = np.array([len(t) for t in folded])
    owner, start, length = [], [], []
    at = 0
    for k, n in enumerate(size.tolist()):
        cuts = np.arange(0, n, SEGMENT)
        owner.append(np.full(len(cuts), k))
        start.append(at + cuts)
        length.append(np.minimum(SEGMENT, n - cuts))
        at += n
    owner, start, length = map(np.concatenate, (owner, start, length))
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    place = np.minimum(start[None, :] + np.arange(length[0])[:, None], len(flat) - 1)
    rows = flat[place]
    used = np.stack([np.bincount(owner, phrases(rows, length, t) + 1, len(folded)) for t in tables])
    first = used.argmin(axis=0)
    least = used.min(axis=0)
    # share of the winner among e^-(excess phrases): 1 when far ahead
    weight = np.exp(-np.minimum(50.0, used - least))
    return first.tolist(), (1 / weight.sum(axis=0)).tolist()


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row, from its whole text."""
    t = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return t.mapInArrow(_predict(model), f"id {kind}, lang_pred string, score double")
