"""Semantic block-tag names <-> HTML tag names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default semantic name -> HTML tag map (names not listed map
# to themselves).
SEMANTIC_NAME_TAG_MAP = {
    "primary headline": "h1",
    "secondary headline": "h2",
    "tertiary headline": "h3",
    "quaternary headline": "h4",
    "quinary headline": "h5",
    "senary headline": "h6",
    "navigation": "nav",
    "section": "section",
    "menu item": "menuitem",
    "block quotation": "blockquote",
    "description details": "dd",
    "description list": "dl",
    "description term": "dt",
    "division": "div",
    "figure caption": "figcaption",
    "paragraph": "p",
    "list item": "li",
    "ordered list": "ol",
    "unordered list": "ul",
    "anchor": "a",
}


def _map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def html_tag(c, mapping: dict | None = None) -> Column:
    """Semantic name -> HTML tag; unknown names map to themselves."""
    c = F.col(c) if isinstance(c, str) else c
    m = _map_literal(mapping or SEMANTIC_NAME_TAG_MAP)
    return F.coalesce(F.try_element_at(m, c), c)


def html_tags(c, mapping: dict | None = None) -> Column:
    """Array form of ``html_tag``."""
    c = F.col(c) if isinstance(c, str) else c
    m = _map_literal(mapping or SEMANTIC_NAME_TAG_MAP)
    return F.transform(c, lambda x: F.coalesce(F.try_element_at(m, x), x))
