"""Column expressions with the semantics of Python's string functions.

Offsets and lengths count code points, as Spark's ``length`` and ``substring`` do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for Python: Unicode's and the four separators U+001C to U+001F. Prefix patterns with (?U).
WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def word_count(c: Column) -> Column:
    """Number of runs without white space, long."""
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("long")


def cut(c: Column, start: Column, end: Column) -> Column:
    """c[start:end] for 0 <= start; a negative length gives an empty string."""
    return F.substring(c, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def find(text: Column, part: Column, start: Column | int = 0) -> Column:
    """Offset of ``part`` at or after ``start``, or null."""
    start = F.lit(start) if isinstance(start, int) else start
    at = F.call_function("locate", part, text, (start + 1).cast("int")).cast("long")
    return F.when(at > 0, at - 1)


def escape_html(c: Column) -> Column:
    """The five special characters, & first, then line ends as <br> and a line end."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("\n", "<br>\n")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def normalize_arabic(c: Column) -> Column:
    """Marks U+064B to U+065F and U+0670 go; alef forms, ta marbuta and alef maqsura become their plain letters."""
    return F.translate(F.regexp_replace(c, "[ً-ٰٟ]", ""), "أإآٱةى", "ااااهي")


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, "[ً-ٰٟ]", "")


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted array; null if it is empty."""
    return sorted_at(values, 1, 2)


def sorted_at(values: Column, num: int, den: int) -> Column:
    """The element at num * n // den of the sorted array (0 based)."""
    ordered = F.sort_array(values)
    at = F.floor(F.size(values) * num / den).cast("int")
    return F.when(F.size(values) > 0, F.get(ordered, at))
