"""Text expressions used throughout; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, no-break spaces included.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)


def strip(c: Column) -> Column:
    """Without outer white space."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | (strip(c) == "")


def word(c: Column) -> Column:
    """A name compared regardless of case and outer blanks."""
    return F.lower(strip(c))


def unix_lines(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def sha(*parts: Column) -> Column:
    """SHA-256 (hex) of the parts with a NUL between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A content-addressed id: prefix and the first 32 hex digits of the parts' SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(sha(*parts), 1, 32))
