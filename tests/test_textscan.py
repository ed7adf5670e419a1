"""The anchor index against plain substring search."""

import random

import pytest

from conftest import shredded_dom
from contentmark.operators import textscan


def plain(text, needle):
    out, p = [], text.find(needle)
    while p >= 0:
        out.append(p)
        p = text.find(needle, p + 1)
    return out


def run_places(spark, pages, needles):
    *_, page_text, dom = shredded_dom(spark, *pages)
    nd = spark.createDataFrame(needles, "page_id bigint, needle string")
    got = sorted((r["page_id"], r["needle"], r["p"]) for r in textscan.places(dom, nd).collect())
    content = {r["page_id"]: r["content"] for r in page_text.collect()}
    want = sorted({(i, n, p) for i, n in needles if n for p in plain(content[i], n)})
    return got, want, content


def test_places_match_plain_search(spark):
    rng = random.Random(7)
    words = ["lorem", "é", "a", "aa", "naïve", "x😀y", "ipsum", "1", "22", "-", "dolor sit"]
    pages = []
    for n in (3, 40, 400, 2500):
        body = " ".join(rng.choice(words) for _ in range(n)).replace(" a ", "</p><p>a <i>b</i> ", 40)
        pages.append(f"<body><p>{body}</p><script>var a = 'aa';</script></body>")
    pages += ["<body>" + "ab" * 3000 + "</body>", "<body></body>", "x"]
    *_, page_text, dom = shredded_dom(spark, *pages)
    content = {r["page_id"]: r["content"] for r in page_text.collect()}
    needles = [(i, n) for i in range(len(pages)) for n in ("", "a", "aa", "zz", "😀", "x" * 700)]
    for i, text in content.items():
        for n in (1, 2, 3, 4, 5, 7, 8, 11, 15, 16, 17, 30, 100, 511, 512, 513, 1024, 1025, 3000):
            for _ in range(2):
                if len(text) >= n:
                    a = rng.randrange(len(text) - n + 1)
                    needles.append((i, text[a:a + n]))
                    needles.append((i, text[a:a + n - 1] + "!"))
    needles += [(4, "ab" * k) for k in (1, 5, 20, 600, 3000)]
    got, want, _ = run_places(spark, pages, needles)
    assert got == want


@pytest.mark.parametrize("n", [50, 1000])
def test_blocks_with_a_common_start(spark, n):
    items = [f"Item of a list whose first words are always the same {k}" for k in range(n)]
    page = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    got, want, _ = run_places(spark, [page], [(0, x) for x in items])
    assert got == want and len(got) >= n


def test_ordinary_pages_need_no_index(spark, monkeypatch):
    """Runs and covering elements are the same in one piece and by the index;
    pages of ordinary size are not indexed."""
    rng = random.Random(11)
    pieces = ["<p>", "</p>", "<b>", "</b>", "<ul><li>", "</ul>", "ab", "aab", "a", " ", "<i></i>", "&#1;", "é", "😀"]
    pages = ["<body>" + "".join(rng.choice(pieces) for _ in range(60)) + "</body>" for _ in range(12)]
    pages += ["ab<p>ab</p>ab", "<p>" + "ab" * 1500 + "</p>ab", "", "<b></b>"]
    *_, dom = shredded_dom(spark, *pages)
    rows = [(i, n) for i in range(len(pages) + 1) for n in ("", "a", "b", "ab", "aba", "b a", "aa", "é😀", "ab" * 400)]
    nd = spark.createDataFrame(rows + [(None, "a"), (0, None)], "page_id bigint, needle string")

    def found():
        return sorted((tuple(r) for r in textscan.occurrences(dom, nd).collect()), key=repr)

    with monkeypatch.context() as m:
        m.setattr(textscan, "PIECE", 0)
        indexed = found()
    with monkeypatch.context() as m:
        m.setattr(textscan, "WORK", 2000)      # the long page by the index, the others in one piece
        mixed = found()
    monkeypatch.setattr(textscan, "places", None)
    assert found() == indexed == mixed and len(indexed) > 50
