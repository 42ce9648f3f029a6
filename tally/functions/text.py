"""Text expressions with Python ``str`` semantics, written as built-in Spark
functions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.isspace() treats as whitespace (ASCII controls 0x09-0x0D,
# 0x1C-0x1F, space, NEL, NBSP and the Unicode space separators), as a literal
# set for btrim (no regex).
_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
             + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading and trailing whitespace of every kind
    (a character-set trim, no regex)."""
    return F.btrim(c, F.lit(_WS_CHARS))


def is_blank(c: Column) -> Column:
    """Null, or empty after stripping (the sync's emptiness test)."""
    return c.isNull() | (py_strip(c) == "")


# Cased letters (Python title() starts a word at a cased letter that follows
# anything that is not a cased letter).
_CASED = "\\p{Lu}\\p{Ll}\\p{Lt}"
_WORD_START = f"(?<=[^{_CASED}])(?=[{_CASED}])"
_MARK = "\ue000 "  # private-use character + space, removed again below


def py_title(c: Column) -> Column:
    """``str.title()``: upper-case the first letter of each run of cased
    letters, lower-case the rest. ``initcap`` alone starts words after a space
    only, so ``bkk-2a o'neil`` would become ``Bkk-2a O'neil``; a mark + space
    is put before every letter run that follows a non-letter, ``initcap``
    runs, and the marks are taken out. All three are codegen'd built-ins.
    Null stays null.
    """
    marked = F.regexp_replace(c, _WORD_START, _MARK)
    return F.regexp_replace(F.initcap(marked), _MARK, "")
