"""Token ids of whole texts by the tokenizers library, distinct parts once.

The vocabularies used here (byte-level BPE, and lower-case BPE with word ends)
split a text by a pattern before any merge, so its ids are the ids of the parts
in order.  Plain Latin texts are split many at a time, by the classes of their
characters as arrays; Arrow finds the distinct parts, and the tokenizer's BPE
model encodes each of them once.  Any other text is cut at white space, which no part crosses, and its distinct pieces
go through the whole tokenizer, as character classes might differ between two
regular-expression engines.  A text that holds the name of a special token, such
as ``<|endoftext|>``, goes through the tokenizer whole: as in a plain call, the
name gives the special id.  Tests compare all ways with plain calls on whole texts.
"""

from __future__ import annotations

import re
from array import array

# The Unicode White_Space characters (tokenizers' \\s).
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+"
PLAIN = r"[ \t\n\r!-~\xa1-\u012f\u0131-\u024f]*"
# Letters and numbers of PLAIN, as ranges.
LETTERS = ("AZ", "az", "\xaa\xaa", "\xb5\xb5", "\xba\xba", "\xc0\xd6", "\xd8\xf6", "\xf8\u024f")
NUMBERS = ("09", "\xb2\xb3", "\xb9\xb9", "\xbc\xbe")
END, LETTER, NUMBER, SYMBOL, SPACE = range(5)      # classes of characters; END is between texts
# The pre-tokenizer's patterns are, with the classes L and N,
# 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\sLN]+|\s+(?!\S)|\s+ (byte level) and the following.
WORD_PATTERN_IN_FILE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHUNK = 1 << 20        # characters split at a time, or one longer text
GENERATION = 150_000   # parts remembered before the older half is let go


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


def _classes():
    import numpy as np
    out = np.full(0x250, SYMBOL, np.uint8)
    for kind, ranges in ((LETTER, LETTERS), (NUMBER, NUMBERS)):
        for first, last in ranges:
            out[ord(first):ord(last) + 1] = kind
    out[[ord(c) for c in " \t\n\r"]] = SPACE
    out[0] = END
    return out


def _starts(c, kind, single: bool):
    """Where the parts of plain texts begin, as a mask over their characters ``c``
    (classes ``kind``).  ``single``: the word pattern, whose numbers are parts of
    one character and whose spaces join no part."""
    import numpy as np
    start = np.append(True, kind[1:] != kind[:-1]) | (kind == END)
    if single:
        start |= kind == NUMBER
    else:
        # of the spaces before a part the last one is apart; a blank joins the part
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
        start[last] = True
        start[last[c[last] == 32] + 1] = False
    # contractions: an apostrophe that begins a part, with one or two letters
    at = np.flatnonzero(start & (c == 39))
    one, two = (np.append(c, [0, 0]).astype(np.uint32)[at + k] for k in (1, 2))
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = np.isin(one << 16 | two, [ord(x) << 16 | ord(y) for x, y in ("re", "ve", "ll")])
    start[at[short | long] + 1] = False
    after = np.concatenate((at[short] + 2, at[long] + 3))
    start[after[after < len(c)]] = True
    return start


class PieceTokenizer:
    """Callable: list of texts -> list of ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        own = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.lower = spec["normalizer"] is not None
        known = own == ([WORD_PATTERN_IN_FILE] if self.lower else [])
        self.classes = _classes()
        self.pieces = re.compile(PIECES).findall
        self.plain = re.compile(PLAIN).fullmatch if known else lambda text: None
        added = spec["added_tokens"]
        # names looked for in the normalized text might hide in any text
        hidden = any(a["normalized"] for a in added)
        names = "" if hidden else "|".join(re.escape(a["content"]) for a in added) or "(?!)"
        self.special = re.compile(names).search
        self.letters = dict(enumerate(byte_letters()))
        del self.letters[1]     # stands between parts
        # parts and pieces in use, and those before them
        self.parts: dict[str, bytes] = {}
        self.parts_before: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merge(self, parts: list[str]) -> list[bytes]:
        """Ids of parts by the BPE model; ends, and the word pattern's spaces, have none."""
        lower, tokenize = self.lower, self.model.tokenize
        mapped = "\1".join(parts).encode().decode("latin-1").translate(self.letters).split("\1")
        return [b"" if p == "\0" or lower and p.isspace() else array("I", [t.id for t in tokenize(m)]).tobytes()
                for p, m in zip(parts, mapped)]

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts: remembered ones, and the others merged now."""
        unseen = [p for p in parts if p not in self.parts]
        before = self.parts_before
        self.parts.update((p, before[p]) for p in unseen if p in before)
        unseen = [p for p in unseen if p not in before]
        if unseen:
            self.parts.update(zip(unseen, self._merge(unseen)))
        return list(map(self.parts.__getitem__, parts))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: each is followed by an ``END``, whose part has no ids."""
        import numpy as np
        import pyarrow as pa
        joined = "\0".join(texts) + "\0"
        c = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        kind = self.classes[c]
        at = np.flatnonzero(_starts(c, kind, self.lower))
        ends = np.flatnonzero(kind[at] == END)
        data = joined.encode()
        # every character takes one byte, or two from U+0080 on
        place = at + np.append(0, np.cumsum(c >= 128))[at]
        parts = pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(np.append(place, len(data)).astype(np.int64)), pa.py_buffer(data))
        found = parts.dictionary_encode()
        ids = self._known(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = found.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = size[which]
        upto = np.cumsum(n)
        source = np.repeat((np.cumsum(size) - size)[which] - (upto - n), n) + np.arange(upto[-1])
        out = np.frombuffer(b"".join(ids), "<u4")[source].tobytes()
        cut = [0, *(4 * upto[ends]).tolist()]
        return [out[a:b] for a, b in zip(cut, cut[1:])]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        self.cache.update((p, self.older[p]) for p in new if p in self.older)
        unseen = [p for p in new if p not in self.cache]
        self.cache.update(zip(unseen, self._whole(unseen)))

    def _forget(self) -> None:
        if len(self.parts) + len(self.cache) > GENERATION:
            self.parts_before, self.parts = self.parts, {}
            self.older, self.cache = self.cache, {}

    def _encode(self, text: str) -> bytes:
        if self.special(text):
            return self._whole([text])[0]
        pieces = self.pieces(text)
        self._learn([p for p in set(pieces) if p not in self.cache])
        return b"".join(map(self.cache.__getitem__, pieces))

    def _chunks(self, texts: list[str]):
        """(places, texts) of plain texts, some at a time; (place, None) of any other."""
        places, some, size = [], [], 0
        for k, text in enumerate(texts):
            low = text.lower() if self.lower else text
            if self.special(text) or not self.plain(low):
                yield [k], None
                continue
            places.append(k)
            some.append(low)
            size += len(low)
            if size >= CHUNK:
                yield places, some
                places, some, size = [], [], 0
        if some:
            yield places, some

    def __call__(self, texts: list[str]) -> list[bytes]:
        import gc
        out: list[bytes] = [b""] * len(texts)
        on = gc.isenabled()
        gc.disable()   # only strings and short lists are made below
        try:
            for places, some in self._chunks(texts):
                self._forget()
                for k, ids in zip(places, self._plain(some) if some else [self._encode(texts[places[0]])]):
                    out[k] = ids
        finally:
            if on:
                gc.enable()
        return out


def worker_tokenizer(path: str) -> PieceTokenizer:
    """The worker's tokenizer of a vocabulary, with the parts it remembers.  This
    package travels by value, so its own globals last for a task; an imported module
    lasts as long as the worker, which serves many tasks."""
    import tokenizers
    held = vars(tokenizers).setdefault("_contentmark_held", {})
    if path not in held:
        held[path] = PieceTokenizer(path)
    return held[path]
