"""Choosing and replacing spans of a token array, inside the row.

Both compounding and the indexed dictionary find, per position, a matching
expression's length; the chosen spans are the leftmost-longest ones that do not
overlap. A left-to-right choice has no array expression that is linear, but a
regular expression has: lengths are written as one character per position
(``0`` where nothing starts), and a pattern with one alternative per length
consumes a span at a time."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character per length, ``0`` for no match; lengths 2 to 30.
DIGITS = "0123456789abcdefghijklmnopqrst"
INSIDE = "_"


def length_digit(length: Column) -> Column:
    """The character of a length (0 to 30)."""
    return F.substring(F.lit(DIGITS), length + 1, 1)


def _consume(longest: int) -> str:
    # possessive counts: no backtracking, whatever the text
    spans = [f"{DIGITS[n]}.{{0,{n - 1}}}+" for n in range(2, longest + 1)]
    return "|".join([*spans, "[0-9a-z]"])


def chosen_marks(lengths: Column, longest: int) -> Column:
    """``ARRAY<STRING>``, one mark per position: ``0`` free, the digit of the
    length where a chosen span starts, ``_`` inside one. ``lengths`` is the
    string of length digits."""
    if not 2 <= longest < len(DIGITS):
        raise ValueError(f"lengths must be between 2 and {len(DIGITS) - 1}")
    pieces = F.regexp_extract_all(lengths, F.lit(_consume(longest)), 0)
    marks = F.transform(pieces, lambda p: F.concat(F.substring(p, 1, 1),
                                                   F.repeat(F.lit(INSIDE), F.length(p) - 1)))
    return F.split(F.array_join(marks, ""), "")


def sparse_lengths(matches: Column, size: Column) -> Column:
    """The string of length digits from sorted ``ARRAY<STRUCT<pos, len>>`` (pos
    from 1, unique) of an array of ``size`` positions."""
    before = F.concat(F.array(F.lit(0)), F.transform(matches, lambda m: m["pos"]))
    parts = F.filter(F.zip_with(matches, before, lambda m, q: F.concat(
        F.repeat(F.lit("0"), m["pos"] - q - 1), length_digit(m["len"]))), lambda p: p.isNotNull())
    last = F.coalesce(F.try_element_at(matches, F.lit(-1))["pos"], F.lit(0))
    return F.concat(F.array_join(parts, ""), F.repeat(F.lit("0"), size - last))


def merge_marked(tokens: Column, marks: Column, sep: str) -> Column:
    """Tokens with each chosen span joined into one token."""
    def at(i):
        mark = F.element_at(marks, i)
        span = F.instr(F.lit(DIGITS), mark) - 1
        return F.when(mark == "0", F.element_at(tokens, i)) \
            .when(mark != INSIDE, F.array_join(F.slice(tokens, i, span), sep))
    n = F.size(tokens)
    return F.when(n > 0, F.array_compact(F.transform(F.sequence(F.lit(1), n), at))) \
        .otherwise(F.array().cast("array<string>"))
