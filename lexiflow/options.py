"""Token options: the switches of the corpus explorer, with its defaults."""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TextOptions:
    """Switches of the token chain (order of application is fixed, see
    ``operators.tokens.clean_tokens``)."""

    lowercase: bool = True
    remove_numbers: bool = True
    remove_punct: bool = True
    remove_symbols: bool = True
    remove_hyphens: bool = True      # True: split words at inner hyphens
    remove_url: bool = True
    remove_twitter: bool = False     # False: '#tag' and '@user' stay one token
    ngrams: tuple[int, ...] = (1,)
    stopwords: tuple[str, ...] = ()
    stem_language: str | None = None
    min_termfreq: int = 0
    dictionary: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    dictionary_type: str = "glob"    # glob | regex | fixed

    def __post_init__(self):
        if not self.ngrams:
            raise ValueError("at least one n-gram size is required")
        if any(not (1 <= k <= 5) for k in self.ngrams):
            raise ValueError("n-gram sizes must be between 1 and 5")
        if self.dictionary_type not in ("glob", "regex", "fixed"):
            raise ValueError("dictionary_type must be glob, regex or fixed")
        if self.remove_twitter and not self.remove_punct:
            # punctuation kept: the '@'/'#' marks are kept too
            object.__setattr__(self, "remove_twitter", False)


RAW = TextOptions(lowercase=False, remove_numbers=False, remove_punct=False,
                  remove_symbols=False, remove_hyphens=False, remove_url=False,
                  remove_twitter=False)
"""Library-default tokenization: nothing removed, case kept."""
