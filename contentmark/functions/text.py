"""Scalar string / array column functions (all built-in Spark expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() / str.strip() treat as
# white space, as one regex class that Java and RE2 (DuckDB) read alike.
WS_CLASS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS = WS_CLASS + "+"
# The same characters as Spark's functions take them: one by one, and as a class that
# printable ASCII leaves at its first test.
WS_CHARS = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000))
_WS = f"[[^!-~]&&{WS_CLASS}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c) -> Column:
    """``' '.join(s.split())``: fold white-space runs to one blank, trim."""
    # a single blank is left alone: most texts have no other white space inside
    return F.trim(F.regexp_replace(_c(c), f"{_WS}{{2,}}|[[^ -~]&&{WS_CLASS}]", " "))


def remove_ws(c) -> Column:
    """``''.join(s.split())``."""
    return F.regexp_replace(_c(c), _WS + "+", "")


def strip_ws(c) -> Column:
    """``s.strip()`` (Unicode white space at both ends)."""
    c, chars = _c(c), F.lit(WS_CHARS)
    edge = F.contains(chars, F.substring(c, 1, 1)) | F.contains(chars, F.substring(c, -1, 1))
    return F.when(edge, F.btrim(c, chars)).otherwise(c)


def strip_brackets(c) -> Column:
    """B1: ``s[1:-1]`` - drop the outer brackets of a list-like string."""
    c = _c(c)
    return F.when(F.length(c) >= 2, F.regexp_extract(c, r"(?s)^.(.*).$", 1)
                  ).otherwise(F.lit(""))


def parse_seq(c) -> Column:
    """B2: list-like string -> array: strip brackets, ``', '`` -> ``','``,
    split on ``','`` (commas inside items split too, as in the contract)."""
    return F.split(F.replace(strip_brackets(c), F.lit(", "), F.lit(",")), ",")


def render_seq(c) -> Column:
    """Inverse of ``parse_seq`` for display: ``'[' || join(c, ', ') || ']'``."""
    return F.concat(F.lit("["), F.array_join(_c(c), ", "), F.lit("]"))


def strip_quotes(c) -> Column:
    """R2: drop one leading and one trailing double quote."""
    return F.regexp_replace(_c(c), r'^"|"$', "")
