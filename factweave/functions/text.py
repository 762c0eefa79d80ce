"""Text keys shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java pattern of white space in the Unicode sense.
WS = r"(?U)\s"
# Characters that show nothing, besides white space.
UNSEEN = r"[\s\p{Z}\p{Cf}\p{Cc}]"


def mention_key(c: Column) -> Column:
    """Trimmed, without one leading ``@``, lower case, inner white space collapsed."""
    trimmed = F.regexp_replace(c, rf"{WS}+", " ")
    return F.trim(F.lower(F.regexp_replace(F.trim(trimmed), r"^@", "")))


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(F.regexp_replace(c, rf"{WS}+", "") == "", F.lit(True))


def thread_key(c: Column) -> Column:
    """``seconds.micros`` of a thread id in any spelling, else null.

    Spellings: blanks, ``p`` + 16 digits, zeros missing at the end of the fraction.
    """
    t = F.regexp_replace(c, rf"{UNSEEN}+", "")
    t = F.regexp_replace(t, r"^[pP](\d{10})(\d{6})$", "$1.$2")
    filled = F.concat(F.left(t, F.lit(10)), F.lit("."), F.rpad(F.substring(t, 12, 6), 6, "0"))
    return F.when(t.rlike(r"^\d{10}(\.\d{0,6})?$"), filled)
