"""Operator 2, quality rules: line-first cleaning.

Every line (split at ``\\n``) is judged by three rules; failing lines are removed,
and a document that loses more than ``max_lost`` of its word characters is
rejected. Words are runs of characters other than ``\\x20`` and ``\\x09-\\x0D``.

* punctuation: no word ends a sentence, fewer than one in 100 words does, more
  than one symbol of ``#*$%&|<>`` per 10 words, or over a quarter of the words
  hold repeated exclamation or question marks;
* navigation: over a tenth of the words are separators;
* boilerplate: a fixed phrase of notices, or over half of the words repeat the
  word before them.

All of it happens in the row, without a shuffle.

Cases: null text has no words; lines without a word are neutral; a text without
words loses nothing (but fails the base rules); very long lines are judged
whole; repeated rows are judged alike; extra columns are ignored; an empty
table gives an empty result."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ["|", "»", "›", "•", "·", "/", ">", "::"]
SENTENCE_END = r"[.!?…][\x22\x27)\]»”’]*$"
SHOUT = r"[!?]{2}"
PHRASES = [
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "accept cookies", "enable javascript", "click here", "sign up for our newsletter",
    "subscribe to our newsletter", "powered by", "skip to content", "share this article", "lorem ipsum",
]

RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines long, n_removed_lines long, lost_chars long, cleaned string")

_symbol = re.compile(f"[{re.escape(SYMBOLS)}]".encode())
_end = re.compile(SENTENCE_END)
_shout = re.compile(SHOUT)
_lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_phrase = re.compile("|".join(map(re.escape, PHRASES)).encode())
_separators = {s.encode() for s in SEPARATORS}


def chars(words: bytes) -> int:
    """Code points of UTF-8 bytes."""
    data = np.frombuffer(words, np.uint8)
    return int(((data & 0xC0) != 0x80).sum())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """The three rules on a line with words."""
    n = len(words)
    # only words that hold a mark are decoded
    ends = sum(1 for w in words if (w[-1] in b".!?\"')]" or w[-1] > 127) and _end.search(w.decode("utf-8", "replace")))
    if ends == 0 or ends * 100 < n or len(_symbol.findall(line)) * 10 > n:
        return True
    if b"!!" in line or b"??" in line or b"!?" in line or b"?!" in line:
        if sum(1 for w in words if _shout.search(w.decode("utf-8", "replace"))) * 4 > n:
            return True
    if sum(1 for w in words if w in _separators) * 10 > n:
        return True
    if _phrase.search(line.translate(_lower)):
        return True
    return sum(1 for a, b in zip(words, words[1:]) if a == b) * 2 > n


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) == n:
        return 0
    base = len(ids)
    if base < 1 << 21:
        key = (w[:-2] * base + w[1:-1]) * base + w[2:]
    else:
        pair = np.unique(w[:-1] * base + w[1:], return_inverse=True)[1]
        key = pair[:-1] * base + w[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k:n - 2 + k] |= twice
    return int(cover.sum())


def judge(text: str | None, max_lost: float) -> tuple:
    data = (text or "").encode()
    words = data.split()
    n_words, word_chars = len(words), chars(b"".join(words))
    n_symbols = len(_symbol.findall(data))
    repeats = repeat_words(words)
    base_failed = n_words < 50 or 100 * repeats > 50 * n_words
    seen: set[bytes] = set()
    dup = lines = removed = lost = 0
    left = []
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, own):
            removed += 1
            lost += chars(b"".join(own))
        else:
            left.append(line)
    kept = not base_failed and lost <= max_lost * word_chars
    cleaned = b"\n".join(left).decode("utf-8", "replace")
    return n_words, word_chars, n_symbols, dup, repeats, base_failed, kept, lines, removed, lost, cleaned


def clean_lines(docs: DataFrame, max_lost: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
                with_text: bool = True) -> DataFrame:
    """One row per document with its counts, the verdict, and (``cleaned``, if
    ``with_text``) the lines that passed."""
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()]
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches):
        for b in batches:
            rows = [judge(t.as_py(), max_lost) for t in b.column(1)]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            if not with_text:
                columns[-1] = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, RESULT)
