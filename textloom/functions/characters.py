"""Character properties as Column expressions; XID classes are spelt out for Java's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROPERTIES = {
    "alpha": r"\p{IsAlphabetic}",
    "lower": r"\p{IsLowercase}",
    "upper": r"\p{IsUppercase}",
    "num": r"\p{N}",
    "space": r"\p{IsWhite_Space}",
    "xid_start": r"\p{L}\p{Nl}",
    "xid_continue": r"\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}",
}


def char_class(*names: str, every: bool = False) -> str:
    """A regular-expression class of characters with any (or every) of the properties."""
    parts = [f"[{PROPERTIES[n]}]" for n in names]
    return f"[{'&&'.join(parts)}]" if every else f"[{''.join(PROPERTIES[n] for n in names)}]"


def has_properties(char: Column, *names: str) -> Column:
    """Does a one-character string have every property?"""
    return char.rlike(f"^{char_class(*names, every=True)}$")


def count_characters(text: Column, *names: str, every: bool = False) -> Column:
    """Characters of a text with any (or every) of the properties."""
    return F.length(F.regexp_replace(text, f"[^{char_class(*names, every=every)}]", "")).cast("long")
