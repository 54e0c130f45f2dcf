"""Regular expressions of the tokenizer and pattern helpers.

The plain pattern text runs in Java regex (Spark) and RE2 (the SQL oracle):
only constructs both engines read the same way are used (Unicode classes,
alternation tried left to right, no look-around, no back-references).

Java repeats a group of variable length by recursion, so a word of thousands
of parts (``a'a'a'...``, ``1.1.1...``) would overflow an executor's stack. Spark therefore
runs the possessive form of each pattern, which Java repeats in a loop. It
matches the same text: no part can give up a character that what follows it
could take.
"""
from __future__ import annotations

import re

from ..options import TextOptions

# Building blocks of the token pattern.
LETTER_OR_DIGIT = r"[\p{L}\p{N}]"
WORD_CHAR = r"[\p{L}\p{M}\p{N}_]"
WORD_PART = r"_*" + LETTER_OR_DIGIT + WORD_CHAR + "*"
URL = r"https?://\S+"
TAG = r"[@#]" + WORD_PART
DECIMAL = r"\p{N}+(?:[.,]\p{N}+)+"
# The same in possessive form, for Java.
WORD_PART_JAVA = r"_*+" + LETTER_OR_DIGIT + WORD_CHAR + "*+"
DECIMAL_JAVA = r"\p{N}++(?:[.,]\p{N}++)++"
NUMBER_TOKEN_JAVA = r"^\p{N}++(?:[.,]\p{N}++)*+$"
# A token of only digits, optionally with decimal separators (removed by T7).
NUMBER_TOKEN = r"^\p{N}+(?:[.,]\p{N}+)*$"
URL_PREFIXES = ("http://", "https://")


def word_pattern(split_hyphens: bool, java: bool = False) -> str:
    joiners = "['’]" if split_hyphens else "['’-]"
    part, many = (WORD_PART_JAVA, ")*+") if java else (WORD_PART, ")*")
    return part + "(?:" + joiners + part + many


def other_class(opts: TextOptions) -> str | None:
    """Single-character tokens left after the switches: punctuation and/or
    symbols. Marks, separators and control characters never form tokens."""
    keep = []
    if not opts.remove_punct:
        keep.append(r"\p{P}")
    if not opts.remove_symbols:
        keep.append(r"\p{S}")
    if not keep:
        return None
    return "[" + "".join(keep) + "]"


def token_pattern(opts: TextOptions, java: bool = False) -> str:
    """Alternatives in order: URL, tag (when kept), decimal number, word,
    single punctuation/symbol character (when kept).

    URLs are always matched as one piece so that, when removed, no fragments
    of them are left behind; numbers likewise."""
    alts = [URL]
    if not opts.remove_twitter:
        alts.append(TAG)
    alts.append(DECIMAL_JAVA if java else DECIMAL)
    alts.append(word_pattern(opts.remove_hyphens, java))
    other = other_class(opts)
    if other:
        alts.append(other)
    return "|".join(alts)


def number_word(split_hyphens: bool) -> str:
    """A word of the word alternative made of digits only: digits not
    followed by a character that would extend the word (Java look-ahead;
    used only by the Spark side, see ``kept_token_pattern``)."""
    joiners = "['’]" if split_hyphens else "['’-]"
    return r"\p{N}++(?![\p{L}\p{M}\p{N}_]|" + joiners + r"_*[\p{L}\p{N}])"


def kept_token_pattern(opts: TextOptions) -> str:
    """``token_pattern`` with the removed classes folded in: URLs (when
    removed) and numbers (when removed) are alternatives outside capture
    group 1, so extracting group 1 gives ``''`` for them and the kept tokens
    otherwise. Alternatives that can start at the same character keep their
    relative order, so every match is the one ``token_pattern`` makes; only
    the class filters on each token disappear."""
    dropped, kept = [], []
    (dropped if opts.remove_url else kept).append(URL)
    if not opts.remove_twitter:
        kept.append(TAG)
    if opts.remove_numbers:
        dropped += [DECIMAL_JAVA, number_word(opts.remove_hyphens)]
    else:
        kept.append(DECIMAL_JAVA)
    kept.append(word_pattern(opts.remove_hyphens, java=True))
    other = other_class(opts)
    if other:
        kept.append(other)
    return "|".join(dropped + ["(" + "|".join(kept) + ")"])


def glob_to_regex(pattern: str) -> str:
    """Anchored, case-insensitive regex for a glob (``*`` any run, ``?`` one
    character); every other character is literal."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append(quote_regex(ch))
    return "(?iu)^" + "".join(out) + "$"


_META = set(r"\.^$|?*+()[]{}")


def quote_regex(text: str) -> str:
    """Escape regex metacharacters one by one (both engines read ``\\x`` for a
    literal punctuation character; ``\\Q…\\E`` is avoided on purpose)."""
    return "".join("\\" + c if c in _META else c for c in text)


def sql_string(text: str) -> str:
    """ANSI SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


WORD_EXTRACT = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|_+", re.UNICODE)


def query_words(text: str) -> list[str]:
    """Words of a short query string (driver side, one string)."""
    return [w for w in WORD_EXTRACT.findall(text or "") if w.strip("_")]
