"""Decoding of HTML and text bytes to strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte-order marks and the encodings they announce.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"),
         (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
DECLARED = (rb"""^\s*<\?xml[^>]*\bencoding\s*=\s*["']([\w.:-]+)""",
            rb"""(?i)<\s*meta[^>]+charset\s*=\s*["']?([^>"'\s/;]+)""")


def decode_windows_1252(content: Column) -> Column:
    """Bytes as windows-1252; its five unassigned bytes stay control
    characters.  Differs from ISO-8859-1 in 0x80-0x9F only."""
    assigned = [i for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore")]
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, assigned)),
                       bytes(assigned).decode("cp1252"))


def decode_html_bytes(raw: bytes) -> str:
    """A page's bytes as text: the encoding of a byte-order mark, else the
    declared one, else UTF-8, else windows-1252 - the first that fits."""
    import re

    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw[len(mark):].decode(name, "replace")
    names = ["utf-8", "cp1252"]
    for pattern in DECLARED:
        found = re.search(pattern, raw)
        if found:
            names.insert(0, found.group(1).decode("ascii", "replace"))
            break
    for name in names:
        try:
            return raw.decode(name)
        except (LookupError, ValueError):   # no such encoding, or the bytes don't fit it
            continue
    return raw.decode("cp1252", "replace")


def decode_html(content: Column) -> Column:
    """``decode_html_bytes`` as an Arrow-batched column (null stays null)."""
    @F.pandas_udf("string")
    def run(pages):
        return pages.map(lambda raw: None if raw is None else decode_html_bytes(raw))
    return run(content)
