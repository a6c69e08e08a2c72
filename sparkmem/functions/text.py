"""String column expressions with Python ``str`` semantics.

Python's ``str.strip``/``str.split``/``str.splitlines`` treat more code points
as whitespace or line breaks than Spark's ``trim`` does, so the classes are
spelled out here once and reused by every job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() is true.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
# Java-regex character class of the same set.
PY_WS_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# Line boundaries of str.splitlines().
PY_LINEBREAK = "\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
# Python's \w for str patterns: letters, numbers and underscore.
PY_WORD_CLASS = "[\\p{L}\\p{N}_]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove Python whitespace from both ends."""
    return F.trim(_c(c), F.lit(PY_WHITESPACE))


def count_occurrences(text_lc, query_lc) -> Column:
    """``text.count(query)``: non-overlapping occurrences, left to right."""
    t, q = _c(text_lc), _c(query_lc)
    return F.floor((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).cast("long")


def render_tags(tags) -> Column:
    """``str(list_of_str)`` for plain tags: ``['a', 'b']``; empty list ``[]``."""
    t = _c(tags)
    return F.when(F.size(t) > 0, F.concat(F.lit("['"), F.array_join(t, "', '"), F.lit("']"))) \
        .otherwise(F.lit("[]"))


def py_split_words(c) -> Column:
    """``str.split()``: runs of Python whitespace, no empty items."""
    stripped = py_strip(c)
    return F.when(F.length(stripped) == 0, F.array().cast("array<string>")) \
        .otherwise(F.split(stripped, f"{PY_WS_CLASS}+"))


def py_splitlines(c) -> Column:
    """``str.splitlines()`` (a trailing line break yields no extra empty line)."""
    col = _c(c)
    parts = F.split(col, PY_LINEBREAK)
    ends_with_break = col.rlike(f"(?:{PY_LINEBREAK})$")
    return F.when(F.length(col) == 0, F.array().cast("array<string>")) \
        .when(ends_with_break, F.slice(parts, 1, F.size(parts) - 1)) \
        .otherwise(parts)
