"""Per-page HTML tokeniser / tree builder used inside the shredding task.

This is the only per-row Python in the engine.  It turns one HTML string into
flat token rows (one per start tag, end tag, text run, comment, declaration)
that carry the tree position of their node, so every later step is a
DataFrame expression.  Tree-building rules follow the lenient "html.parser"
behaviour of the common Python soup libraries:

* no implied tags; ``<p>`` inside ``<p>`` nests;
* void elements close at once, and one later end tag of that name is ignored;
* an end tag pops to the nearest open element of that name and is ignored if
  none is open; whatever is still open closes at the end of input;
* ``script`` / ``style`` bodies are raw text (no entity decoding);
* adjacent text pieces form one text run; a run of only ASCII white space
  becomes a single newline or space (outside ``pre`` / ``textarea``).

Raw token text is sliced from the source by position, so concatenating
``raw`` in token order gives back the input byte for byte; a run's text comes
from the parser's events, so markup it skips is in ``raw`` alone.
"""

from __future__ import annotations

import html as _html
from array import array
from collections import Counter
from html.entities import html5 as _HTML5
from html.parser import HTMLParser

# Elements that never take children (HTML void elements plus the
# obsolete names the soup builders also treat as empty).
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid",
    "spacer",
])
# Elements whose white-space-only text is kept verbatim.
PRESERVE_WS_TAGS = frozenset(["pre", "textarea"])
ASCII_WS = " \t\n\r\f"
# Facts made for those that ask for them: a run's text with folded white space where that
# differs; of an element inside body with text of its own its text block; of a page its
# packed tree (``unpack_tree``) and the tags of its elements.
FACTS = ("norm", "text_seq", "tag_seq", "class_seq", "tree", "tags")


class _Builder(HTMLParser):
    def __init__(self, src: str):
        super().__init__(convert_charrefs=False)
        self.src = src
        self._base = self._at = 0  # offsets of the parser's buffer and of the current token
        self.events = []  # (offset, kind, payload)
        self._pending_text = None  # pieces of the current text run

    def goahead(self, end):
        self._base = self._at = len(self.src) - len(self.rawdata)
        super().goahead(end)

    def updatepos(self, i, j):
        self._at = self._base + j    # offsets are all that is wanted; no lines are counted
        return j

    def _off(self) -> int:
        return self._at

    def _flush_text(self):
        self._pending_text = None

    def _text(self, piece):
        if self._pending_text is None:
            self._pending_text = []
            self.events.append((self._off(), "text", (bool(self.cdata_elem), self._pending_text)))
        self._pending_text.append(piece)

    def handle_data(self, data):
        self._text(data)

    def handle_entityref(self, name):
        # only whole names are entities; any other stays text, without its semicolon
        self._text(_HTML5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        self._text(_html.unescape(f"&#{name};"))

    def handle_starttag(self, tag, attrs):
        self._flush_text()
        self.events.append((self._off(), "start", (tag, attrs, False)))

    def handle_startendtag(self, tag, attrs):
        self._flush_text()
        self.events.append((self._off(), "start", (tag, attrs, True)))

    def handle_endtag(self, tag):
        self._flush_text()
        self.events.append((self._off(), "end", tag))

    def handle_comment(self, data):
        self._flush_text()
        self.events.append((self._off(), "comment", None))

    def handle_decl(self, decl):
        self._flush_text()
        self.events.append((self._off(), "decl", None))

    def handle_pi(self, data):
        self._flush_text()
        self.events.append((self._off(), "decl", None))

    def unknown_decl(self, data):
        self._flush_text()
        self.events.append((self._off(), "decl", None))


def _attr_map(attrs):
    out = {}
    for k, v in attrs:
        out[k] = "" if v is None else v
    return out


def _path(nodes, pre):
    """Node rows from the root down to ``pre``."""
    out = []
    while pre >= 0:
        out.append(nodes[pre])
        pre = nodes[pre]["parent"]
    return out[::-1]


def _block(nodes, pre):
    """Tags and non-empty class strings of the path from the outermost ``body`` down to
    ``pre``, or None outside of one."""
    line = _path(nodes, pre)
    tags = [nd["tag"] for nd in line]
    if "body" not in tags:
        return None
    at = tags.index("body")
    return {"tag_seq": tags[at:], "class_seq": [c for c in (" ".join(nd["classes"]) for nd in line[at:]) if c]}


def page_rows(src: str, paths=("path", "path_tags", "path_cls"), facts=()):
    """The token rows of one page, one by one, as dicts of the columns they have (see schema.DOM).

    What is held for a page is linear in its length: a node knows its parent
    and extent.  With ``paths`` (names of path columns), a row's path columns are
    put together as it is handed out, and belong to that row alone; so are the
    sequences of a text block.  ``facts`` names the columns of ``FACTS`` to make."""
    rows, nodes = _tree(src or "", facts)
    blocks = "text_seq" in facts
    if not paths and not blocks:
        yield from rows
        return
    for r in rows:
        start = r["kind"] == "start"
        if blocks and start and "text_seq" in r:
            r = {**r, **(_block(nodes, r["node"]) or {"text_seq": None})}
        if paths:
            line = None if r["node"] is None or not (start or "path" in paths) else _path(nodes, r["node"])
            r = {**r, "path": [nd["node"] for nd in line] if line and "path" in paths else None,
                 "path_tags": [nd["tag"] for nd in line] if start and "path_tags" in paths else None,
                 "path_cls": [" ".join(nd["classes"]) for nd in line] if start and "path_cls" in paths else None}
        yield r


_BLANK = dict.fromkeys(("parent", "last", "attrs", "classes", "own_text", "n_children", "string_i", "text", "text_no",
                        "c0", "c1", "s0", "s1", "end_i", "w0", "w1", "k0", "k1", "wtext"))


def shred_html(src: str):
    """``page_rows`` as a list, with every column.  A null page is an empty one: its ``doc``
    row alone."""
    return [{**_BLANK, **r} for r in page_rows(src)]


def _pack_tree(nodes, runs) -> bytes:
    """Elements and text runs of a page as 32-bit numbers: how many there are, the
    elements' parents and key spans, the runs' tokens, places in the page's text and
    owners (-1: none)."""
    out = array("i", (len(nodes), len(runs)))
    for rows, names in ((nodes, ("parent", "k0", "k1")), (runs, ("i", "c0"))):
        for name in names:
            out.extend([r[name] for r in rows])
    out.extend([-1 if r["node"] is None else r["node"] for r in runs])
    return out.tobytes()


def unpack_tree(tree: bytes, tags: str):
    """(tags, parents, k0, k1 of the elements; tokens, places and owners of the runs)."""
    a = array("i")
    a.frombytes(tree)
    n, m = a[0], a[1]
    cut, lists = 2, []
    for size in (n, n, n, m, m, m):
        lists.append(a[cut:cut + size].tolist())
        cut += size
    return tags.split(" ") if n else [], *lists


def _tree(src: str, facts=()):
    """(token rows without paths, node rows in document order) of one page."""
    b = _Builder(src)
    b.feed(src)
    b.close()
    events = b.events
    n = len(src)
    # bytes the parser reports nothing for (such as "</>") belong to the token
    # before them, at the start of the page to the first one
    if events and events[0][0] > 0:
        events[0] = (0, *events[0][1:])
    elif n and not events:
        events = [(0, "decl", None)]
    rows = []
    stack = []        # open node rows
    nodes = []        # node rows in pre order
    runs = []         # rows of text runs
    children = []     # by pre: list of ("t", row) / ("n", row) / ("c", row)
    swallow = Counter()  # void names whose next end tags are ignored
    is_open = {}      # names of the open nodes
    content, plain, bare = [], [], []  # all runs / runs outside script, style /
    c_off = s_off = w_off = 0          # the latter without white space

    def close(nd):  # subtree text of nd ends here
        nd["c1"], nd["s1"], nd["w1"] = c_off, s_off, w_off

    offsets = [e[0] for e in events[1:]]
    offsets.append(n)
    preserved = 0     # open elements whose white space is kept
    for k, ((off, kind, payload), end) in enumerate(zip(events, offsets)):
        owner = stack[-1] if stack else None
        if owner is None:
            row = {"i": k, "kind": kind, "raw": src[off:end], "node": None, "tag": None, "depth": None}
        else:
            row = {"i": k, "kind": kind, "raw": src[off:end], "node": owner["node"], "tag": owner["tag"],
                   "depth": owner["depth"]}
        if kind == "start":
            tag, attrs, self_closing = payload
            pre = len(nodes)
            amap = _attr_map(attrs)
            cls = amap.get("class")
            row["node"], row["tag"], row["last"] = pre, tag, pre
            row["parent"], row["depth"] = (-1, 0) if owner is None else (owner["node"], owner["depth"] + 1)
            row["attrs"] = amap
            row["classes"] = [] if cls is None else cls.split()
            row["c0"], row["s0"], row["w0"] = c_off, s_off, w_off
            nodes.append(row)
            children.append([])
            if owner is not None:
                children[owner["node"]].append(("n", row))
            if self_closing:
                close(row)
            elif tag in VOID_TAGS:
                swallow[tag] += 1
                close(row)
            else:
                stack.append(row)
                is_open[tag] = is_open.get(tag, 0) + 1
                preserved += tag in PRESERVE_WS_TAGS
        elif kind == "end":
            tag = payload
            row["tag"] = tag
            if swallow.get(tag):
                swallow[tag] -= 1
                row["node"] = row["depth"] = None
            elif not is_open.get(tag):
                row["node"] = row["depth"] = None
            else:  # closes all nodes down to the nearest one of that name
                while True:
                    nd = stack.pop()
                    is_open[nd["tag"]] -= 1
                    preserved -= nd["tag"] in PRESERVE_WS_TAGS
                    close(nd)
                    if nd["tag"] == tag:
                        break
                row["node"], row["depth"] = nd["node"], nd["depth"]
                nd["end_i"] = k
        elif kind == "text":
            rawtext, pieces = payload
            text = pieces[0] if len(pieces) == 1 else "".join(pieces)
            if not rawtext and not preserved and text.strip(ASCII_WS) == "":
                text = "\n" if "\n" in text else " "
            if rawtext:
                row["kind"] = "rawtext"
            row["text"] = text
            content.append(text)
            row["c0"] = c_off
            c_off += len(text)
            if not rawtext:
                plain.append(text)
                s_off += len(text)
                w = "".join(text.split())
                bare.append(w)
                w_off += len(w)
            row["text_no"] = len(runs)
            runs.append(row)
            if owner is not None:
                children[owner["node"]].append(("t", row))
        elif owner is not None:  # comment / decl: special strings, children but never text
            children[owner["node"]].append(("c", row))
        rows.append(row)
    for nd in stack:  # never closed: the subtree runs to the end of input
        close(nd)
    # key span of each element in the white-space-free plain text: its
    # subtree text without one leading and one trailing double quote
    bare_text = "".join(bare)
    for nd in nodes:
        a, b = nd["w0"], nd["w1"]
        if b > a and bare_text[a] == '"':
            a += 1
        if b > a and bare_text[b - 1] == '"':
            b -= 1
        nd["k0"], nd["k1"] = a, b
    # subtree extent, own text, child count and the ".string" text run
    blocks = "text_seq" in facts
    for nd in reversed(nodes):
        pre = nd["node"]
        kids = children[pre]
        nd["n_children"] = len(kids)
        own = [r for t, r in kids if t == "t"]
        nd["own_text"] = "".join([r["text"] for r in own])
        if blocks and own:
            seq = [t for t in [r["text"].strip() for r in own if r["kind"] == "text"] if t]
            if seq:
                nd["text_seq"] = seq
        last = pre
        for t, r in kids:
            if t == "n" and r["last"] > last:
                last = r["last"]
        nd["last"] = last
        if len(kids) == 1:
            t, r = kids[0]
            if t == "t":
                nd["string_i"] = r["i"]
            elif t == "n":
                nd["string_i"] = r.get("string_i")
    if "norm" in facts:
        for r in runs:
            norm = " ".join(r["text"].split())
            r["norm"] = None if norm == r["text"] else norm
    rows.append({"i": -1, "kind": "doc", "raw": "", "node": None, "tag": None, "depth": None,
                 "own_text": "".join(plain), "text": "".join(content), "wtext": bare_text})
    if "tree" in facts:    # tag names hold no blank
        rows[-1].update(tree=_pack_tree(nodes, runs), tags=" ".join([nd["tag"] for nd in nodes]))
    return rows, nodes
