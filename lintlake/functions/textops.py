"""Text functions on columns that behave like Python's str methods, and like `re` without flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of str.splitlines().
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
#: What str.strip() takes off.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def unicode_regex(pattern: str) -> str:
    """A Java pattern whose \\w, \\s, \\b and \\d know Unicode, as Python's do."""
    return "(?U)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(unicode_regex(pattern))


def split_lines(code: Column) -> Column:
    """The lines of a text; a final line end starts no further line, an empty text has none."""
    parts = F.split(code, LINE_END, -1)
    last = F.element_at(parts, -1) == ""
    return F.when(last, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def indent(text: Column) -> Column:
    """Number of blank characters before the first other one; of all characters in a blank text."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(_BLANKS)))


def around(lines: Column, i: Column, first: int, last: int) -> Column:
    """Lines i + first to i + last (i from 0), those that exist, joined by newlines."""
    low = F.greatest(F.lit(0), i + first)
    size = F.greatest(F.lit(0), F.least(F.size(lines), i + last + 1) - low)
    return F.array_join(F.slice(lines, low + 1, size), "\n")


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | text.startswith(p)
    return found


def line_count(code: Column) -> Column:
    """Newline characters plus one, whatever the text ends with."""
    return F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1
