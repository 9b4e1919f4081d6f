"""Column helpers that pin the application's string and number semantics.

The application trims and splits text with JavaScript rules (``trim()``,
``/\\s+/``), whose whitespace class is wider than Java's ``\\s`` (which Spark
regexes use) and wider than Spark's ``trim`` (spaces only).  Everything here is
a plain ``Column`` expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript whitespace set (ECMAScript WhiteSpace + LineTerminator):
# TAB, LF, VT, FF, CR, SPACE, NBSP, OGHAM SPACE MARK, U+2000..U+200A, LINE SEPARATOR,
# PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE, BOM.
JS_WS_CLASS = r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
JS_WS_RUN = JS_WS_CLASS + "+"
# The same set as a Python string, for trimming parameters on the driver.
JS_WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim_py(s: str | None) -> str:
    return (s or "").strip(JS_WS_CHARS)


# Paragraph separator of the chunker: newline, any whitespace, newline.
BLANK_LINE_SEP = r"\n" + JS_WS_CLASS + r"*\n"
LINE_SEP = "\n"  # a literal newline: Java splits on it without a regex


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """``String.prototype.trim`` (NULL stays NULL).

    ``trim(str, chars)`` strips a character set natively on UTF8String (no
    regex); about 5x faster than the equivalent regexp_replace.
    """
    return F.trim(col_(c), F.lit(JS_WS_CHARS))


_SPACES = " " * len(JS_WS_CHARS)


def js_word_count(c: Column | str) -> Column:
    """``s.split(/\\s+/).length`` of an already trimmed string (''.split → [''] → 1).

    Every JS whitespace character is mapped to ' ' (``translate``), then the
    string is split on the single character ' ' (Java's non-regex fast path)
    and empty tokens are dropped.
    """
    t = F.translate(col_(c), JS_WS_CHARS, _SPACES)
    return F.greatest(F.size(F.array_remove(F.split(t, " ", -1), "")), F.lit(1))


def js_parse_int(c: Column | str) -> Column:
    """``parseInt(x)``: leading whitespace, optional sign, digits; else NULL (NaN)."""
    s = F.regexp_extract(col_(c).cast("string"), r"^" + JS_WS_CLASS + r"*([+-]?[0-9]+)", 1)
    return F.when(s == "", F.lit(None).cast("bigint")).otherwise(s.try_cast("bigint"))


def js_int_or(c: Column | str, default: int) -> Column:
    """``parseInt(x) || default`` — NaN and 0 both fall to the default."""
    v = js_parse_int(c)
    return F.when(v.isNull() | (v == 0), F.lit(default).cast("bigint")).otherwise(v)


def nullif_empty(c: Column | str) -> Column:
    """JS ``x || null`` for strings: '' and NULL become NULL."""
    c = col_(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def pg_desc(c: Column | str) -> Column:
    """Postgres ``ORDER BY c DESC`` (NULLS FIRST)."""
    return col_(c).desc_nulls_first()


def pg_asc(c: Column | str) -> Column:
    """Postgres ``ORDER BY c ASC`` (NULLS LAST)."""
    return col_(c).asc_nulls_last()
