"""Text of lines whose bytes are UTF-8, Windows-1252 or ISO-8859-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Windows-1252 has at bytes 80-9F, in byte order. The five
# bytes it leaves undefined are absent.
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"

UTF8, CP1252, LATIN1 = "utf-8", "cp1252", "iso-8859-1"


def latin1(raw: Column) -> Column:
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def as_cp1252(latin: Column) -> Column:
    """Text decoded as ISO-8859-1 → the same bytes read as Windows-1252."""
    return F.translate(latin, CP1252_BYTES, CP1252_CHARS)


def is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw)


def decode_line(raw: Column, encoding: Column) -> Column:
    """Text of a raw line in the encoding found for its file."""
    return (
        F.when(encoding == CP1252, as_cp1252(latin1(raw)))
        .when(encoding == LATIN1, latin1(raw))
        .otherwise(raw)
    )
