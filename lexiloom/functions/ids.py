"""Entity and property ids as they are written in dirty tables, read as JVM-side column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every decimal digit of the basic plane that is not ASCII, with the ASCII digit of the same value, and
#: the full-width letters that ids use.
_DIGITS = [(chr(c), str(unicodedata.decimal(chr(c)))) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
_LETTERS = [(unicodedata.lookup(f"FULLWIDTH LATIN {k} LETTER {x}"), x) for x in "PQ" for k in ("CAPITAL", "SMALL")]
_MARKS = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (0xFF5C, 0xFF0F, 0xFF3F, 0xFF1A, 0xFF03)]
#: Characters that never belong to an id: spaces of every kind, controls and format characters.
_NOTHING = "".join(chr(c) for c in range(sys.maxunicode + 1) if c < 0x10000 and unicodedata.category(chr(c)) in ("Cf", "Zs", "Zl", "Zp", "Cc"))
_FROM = "".join(a for a, _ in _DIGITS + _LETTERS + _MARKS) + _NOTHING
_TO = "".join(b for _, b in _DIGITS + _LETTERS + _MARKS)


def plain(c: Column) -> Column:
    """Upper case without spaces and invisible characters, digits of any script as ASCII."""
    return F.upper(F.when(c.rlike(r"^[!-~]*$"), c).otherwise(F.translate(c, _FROM, _TO)))


def read_id(c: Column, kind: str) -> Column:
    """The id in a column of ids of one kind ('Q' or 'P'), as kind and number without leading zeros.

    The number may stand alone, in brackets or behind a prefix (`wd:`, a path). Null, empty and
    unreadable values, and ids of the other kind, give null.
    """
    n = F.regexp_extract(plain(c), rf"^(?:.*[/:#<(\[])?{kind}?0*([0-9]+)[>)\]]?$", 1)
    return F.when(F.coalesce(n, F.lit("")) != "", F.concat(F.lit(kind), n))


_FACT = r"^(?:FACT:)?<?(?:[A-Z]*:)?Q?0*([0-9]+)>?[|/_;,]+<?(?:[A-Z]*:)?P?0*([0-9]+)>?[|/_;,]+<?(?:[A-Z]*:)?Q?0*([0-9]+)>?(?:#.*)?$"


def read_fact_id(c: Column) -> tuple[Column, Column, Column]:
    """Subject, property and object id of a composite fact id; three nulls where it can't be read."""
    p = plain(c)
    parts = [F.regexp_extract(p, _FACT, i) for i in (1, 2, 3)]
    return tuple(F.when(F.coalesce(n, F.lit("")) != "", F.concat(F.lit(k), n)) for k, n in zip("QPQ", parts))
