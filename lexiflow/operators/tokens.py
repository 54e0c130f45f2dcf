"""Tokenization and token transforms.

Tokens stay an ``ARRAY<STRING>`` column in the document row: every step is a
narrow projection with higher-order functions (no explode, no shuffle, no
Python). Each step is materialised as its own column so that the next step
refers to an attribute, never re-evaluates the previous expression.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fence
from ..functions.patterns import (NUMBER_TOKEN_JAVA, URL_PREFIXES, glob_to_regex, kept_token_pattern,
                                  token_pattern)
from ..options import RAW, TextOptions



def _empty() -> Column:
    return F.array().cast("array<string>")


def tokens_expr(text: Column | str, opts: TextOptions = TextOptions()) -> Column:
    """Word tokens of a text column after the removal switches.

    One regex pass: removed URLs and numbers are matched outside the capture
    group and come out as ``''`` (dropped by an equality test), so no
    per-token regex filter runs. ``token_pattern`` with the explicit filters
    below is the same tokenizer written for engines without look-ahead (the
    SQL oracle)."""
    text = F.col(text) if isinstance(text, str) else text
    if opts.remove_url or opts.remove_numbers:
        toks = F.regexp_extract_all(text, F.lit(kept_token_pattern(opts)), 1)
        toks = F.filter(toks, lambda t: t != "")
    else:
        toks = F.regexp_extract_all(text, F.lit(token_pattern(opts, java=True)), 0)
    if opts.lowercase:
        toks = F.transform(toks, F.lower)
    return F.coalesce(toks, _empty())


def tokens_expr_filtered(text: Column | str, opts: TextOptions = TextOptions()) -> Column:
    """Reference form of ``tokens_expr``: extract all tokens, then filter the
    removed classes token by token."""
    text = F.col(text) if isinstance(text, str) else text
    toks = F.regexp_extract_all(text, F.lit(token_pattern(opts, java=True)), 0)
    drops = []
    if opts.remove_url:
        drops.append(lambda t: t.startswith(URL_PREFIXES[0]) | t.startswith(URL_PREFIXES[1]))
    if opts.remove_numbers:
        drops.append(lambda t: t.rlike(NUMBER_TOKEN_JAVA))
    if drops:
        def keep(t):
            cond = drops[0](t)
            for d in drops[1:]:
                cond = cond | d(t)
            return ~cond
        toks = F.filter(toks, keep)
    if opts.lowercase:
        toks = F.transform(toks, F.lower)
    return F.coalesce(toks, _empty())


def tokenize(df: DataFrame, opts: TextOptions = TextOptions(), text_col: str = "text",
             out_col: str = "tokens", keep_text: bool = False) -> DataFrame:
    """Add the token array of ``text_col`` (the text is dropped unless kept)."""
    out = df.withColumn(out_col, fence(tokens_expr(text_col, opts)))
    return out if keep_text or text_col == out_col else out.drop(text_col)


def remove_stopwords_expr(tokens: Column | str, stopwords: Iterable[str],
                          tokens_lowercased: bool = False) -> Column:
    """Drop tokens that match a stop word (case-insensitively); neighbours close
    up. Duplicates in the token array are all removed or all kept. With
    ``tokens_lowercased`` plain words are compared as they are. Words with
    ``*`` or ``?`` are globs."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    stops = sorted({s.lower() for s in stopwords if s is not None and s != ""})
    if not stops:
        return tokens
    return F.filter(tokens, lambda t: ~matches_words(t, stops, tokens_lowercased))


def matches_words(token: Column, words: Sequence[str], lowercased: bool = False) -> Column:
    """Does a token match one of the words? Words with ``*`` or ``?`` are globs
    (one anchored regex for all of them), the others are compared whole."""
    low = token if lowercased else F.lower(token)
    plain = [w for w in words if not any(c in w for c in "*?")]
    globs = [glob_to_regex(w)[len("(?iu)^"):-1] for w in words if any(c in w for c in "*?")]
    found = low.isin(plain) if plain else F.lit(False)
    return found | token.rlike("(?iu)^(?:" + "|".join(globs) + ")$") if globs else found


def _gram(tokens: Column, k: int, sep: str):
    # one-parameter lambda: PySpark reads a second parameter as the index;
    # the k parts are read in place (no slice array per n-gram)
    return lambda i: F.concat_ws(sep, *[F.element_at(tokens, i + j) for j in range(k)])


def ngrams_expr(tokens: Column | str, sizes: Sequence[int] = (1,), sep: str = "_") -> Column:
    """n-grams of all requested sizes, smaller sizes first; documents shorter
    than a size give no n-gram of that size."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    sizes = sorted(set(sizes))
    if not sizes:
        raise ValueError("no n-gram size chosen")
    parts = []
    for k in sizes:
        if k == 1:
            parts.append(tokens)
            continue
        grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), _gram(tokens, k, sep))
        parts.append(F.when(F.size(tokens) >= k, grams).otherwise(_empty()))
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))


# ---------------------------------------------------------------- dictionary

def _single_pattern_pred(pattern: str, valuetype: str):
    """Predicate builder ``t -> Column`` for one word pattern, case-insensitive.
    Globs with only a leading or trailing ``*`` become prefix/suffix tests
    (no regex); other globs become anchored regexes."""
    low = pattern.lower()
    if valuetype == "fixed":
        return ("eq", low)
    if valuetype == "regex":
        return ("re", pattern)
    wild = any(c in pattern for c in "*?")
    if not wild:
        return ("eq", low)
    body = low.strip("*")
    if "?" not in low and "*" not in body and body:
        if low.startswith("*") and low.endswith("*"):
            return ("contains", body)
        if low.endswith("*"):
            return ("prefix", body)
        if low.startswith("*"):
            return ("suffix", body)
    return ("re", glob_to_regex(pattern))


def word_matcher(patterns: Sequence[str], valuetype: str):
    """``t -> Column``: does token ``t`` match any of the word patterns."""
    eqs, tests, regexes = [], [], []
    for p in patterns:
        kind, v = _single_pattern_pred(p, valuetype)
        if kind == "eq":
            eqs.append(v)
        elif kind == "re":
            regexes.append(v if valuetype != "regex" else "(?iu)(?:" + v + ")")
        else:
            tests.append((kind, v))

    def pred(t: Column) -> Column:
        lt = F.lower(t)
        conds = []
        if eqs:
            conds.append(lt.isin(sorted(set(eqs))) if len(eqs) > 1 else lt == F.lit(eqs[0]))
        for kind, v in tests:
            if kind == "prefix":
                conds.append(lt.startswith(v))
            elif kind == "suffix":
                conds.append(lt.endswith(v))
            else:
                conds.append(lt.contains(v))
        for r in regexes:
            conds.append(t.rlike(r))
        out = conds[0]
        for c in conds[1:]:
            out = out | c
        return out
    return pred


def _split_value(value: str) -> list[str]:
    return [w for w in value.split() if w]


def dictionary_lookup(df: DataFrame, dictionary, valuetype: str = "glob",
                      tokens_col: str = "tokens", out_col: str | None = None) -> DataFrame:
    """Non-exclusive dictionary lookup.

    Per key, matches are leftmost-longest and do not overlap; a match is
    replaced by the upper-cased key at its first position and its other
    tokens are dropped; a token matched by several keys yields every key, in
    dictionary order; other tokens stay. Patterns are a literal config typed
    by the user, evaluated in the row: no join, no shuffle.
    """
    out_col = out_col or tokens_col
    entries = [(k, [v for v in vals if v and v.strip()]) for k, vals in _entries(dictionary)]
    entries = [(k, vals) for k, vals in entries if vals]
    if not entries:
        return df.withColumn(out_col, F.col(tokens_col)) if out_col != tokens_col else df
    tok = F.col(tokens_col)
    single = all(len(_split_value(v)) == 1 for _, vals in entries for v in vals)
    if single:
        preds = [(k.upper(), word_matcher(vals, valuetype)) for k, vals in entries]
        if len(preds) == 1:
            key, pred = preds[0]
            # one key: a token is replaced in place, no per-token array
            return df.withColumn(out_col, fence(F.transform(
                tok, lambda t: F.when(pred(t), F.lit(key)).otherwise(t))))
        any_match = word_matcher([v for _, vals in entries for v in vals], valuetype)

        def keys_of(t):
            return F.array_compact(F.array(*[F.when(p(t), F.lit(k)) for k, p in preds]))
        # the per-key array is only built for tokens that match some pattern
        return df.withColumn(out_col, fence(F.flatten(F.transform(
            tok, lambda t: F.when(any_match(t), keys_of(t)).otherwise(F.array(t))))))
    return _dictionary_lookup_general(df, entries, valuetype, tokens_col, out_col)


def _entries(dictionary):
    if isinstance(dictionary, dict):
        items = dictionary.items()
    else:
        items = dictionary
    out = []
    for k, vals in items:
        vals = [vals] if isinstance(vals, str) else list(vals)
        out.append((str(k), vals))
    return out


def _match_len(tok: Column, n: Column, by_len: dict, valuetype: str):
    """``i -> length`` of the longest value of a key matching at ``i`` (0: none)."""
    lens = sorted(by_len, reverse=True)

    def match_len(i):
        branches = None
        for ln in lens:
            conds = None
            for words in by_len[ln]:
                c = None
                for j, w in enumerate(words):
                    p = word_matcher([w], valuetype)
                    cj = F.coalesce(p(F.try_element_at(tok, i + j)), F.lit(False)) if j else \
                        p(F.element_at(tok, i))
                    c = cj if c is None else (c & cj)
                if ln > 1:
                    c = (i + (ln - 1) <= n) & c
                conds = c if conds is None else (conds | c)
            branches = F.when(conds, F.lit(ln)) if branches is None else branches.when(conds, F.lit(ln))
        return branches.otherwise(F.lit(0))
    return match_len


def _greedy_step(lcol: str):
    def step(acc, i):
        ln = F.element_at(F.col(lcol), i)
        return F.when((ln > 0) & (i > acc["last"]), F.struct(
            (i + ln - 1).alias("last"),
            F.concat(acc["spans"], F.array(F.struct(i.alias("s"), (i + ln - 1).alias("e"))))
            .alias("spans"))).otherwise(acc)
    return step


def _long_match(lcol: str):
    return lambda i: F.element_at(F.col(lcol), i) >= 2


def _inside(scol: str, i: Column) -> Column:
    return F.exists(F.col(scol), lambda sp: (sp["s"] < i) & (i <= sp["e"]))


def _dictionary_lookup_general(df, entries, valuetype, tokens_col, out_col):
    """Dictionary with multi-word values. Per key, the longest match length
    at each position is an array; only positions where a multi-word value
    matches can block later positions, so the greedy left-to-right choice
    (a fold) runs over those few candidates and yields the chosen multi-word
    spans. A position then starts a match of the key when some value matches
    there and it lies inside no chosen span of that key. Keys with only
    single-word values are tested on the token itself."""
    tok = F.col(tokens_col)
    n = F.size(tok)
    positions = F.sequence(F.lit(1), n)
    tmp_cols = []
    work = df
    keys = []  # (KEY, start(i) -> Column, inside(i) -> Column | None)
    span_t = "array<struct<s:int,e:int>>"
    for idx, (key, vals) in enumerate(entries):
        words = [_split_value(v) for v in vals]
        if all(len(w) == 1 for w in words):
            pred = word_matcher([w[0] for w in words], valuetype)
            keys.append((key.upper(), (lambda i, pred=pred: pred(F.element_at(tok, i))), None))
            continue
        by_len: dict[int, list[list[str]]] = {}
        for w in words:
            by_len.setdefault(len(w), []).append(w)
        lcol, ccol, scol = f"__dl{idx}", f"__dc{idx}", f"__ds{idx}"
        work = work.withColumn(lcol, F.when(n > 0, F.transform(positions, _match_len(tok, n, by_len, valuetype)))
                               .otherwise(F.array().cast("array<int>")))
        work = work.withColumn(ccol, F.when(n > 0, F.filter(positions, _long_match(lcol)))
                               .otherwise(F.array().cast("array<int>")))
        init = F.struct(F.lit(0).alias("last"), F.array().cast(span_t).alias("spans"))
        work = work.withColumn(scol, F.aggregate(F.col(ccol), init, _greedy_step(lcol),
                                                 lambda acc: acc["spans"]))
        tmp_cols += [lcol, ccol, scol]
        keys.append((key.upper(),
                     (lambda i, lcol=lcol, scol=scol: (F.element_at(F.col(lcol), i) >= 1) & ~_inside(scol, i)),
                     (lambda i, scol=scol: _inside(scol, i))))

    def at(i):
        here = F.array_compact(F.array(*[F.when(start(i), F.lit(k)) for k, start, _ in keys]))
        covered = F.size(here) > 0
        for _, _, inside in keys:
            if inside is not None:
                covered = covered | inside(i)
        return F.when(covered, here).otherwise(F.array(F.element_at(tok, i)))

    work = work.withColumn(out_col, fence(F.when(n > 0, F.flatten(F.transform(positions, at)))
                                          .otherwise(_empty())))
    return work.drop(*tmp_cols)


def clean_tokens(df: DataFrame, opts: TextOptions = TextOptions(), text_col: str = "text",
                 out_col: str = "tokens", keep_text: bool = False) -> DataFrame:
    """The whole token chain in its fixed order: tokenize and remove classes
    → lowercase → dictionary → stop words → n-grams (T1-T13)."""
    out = tokenize(df, opts, text_col, out_col, keep_text)
    if opts.dictionary:
        out = dictionary_lookup(out, opts.dictionary, opts.dictionary_type, out_col)
    if opts.stopwords:
        # lowercased tokens without upper-case dictionary keys need no lower()
        lowered = opts.lowercase and not opts.dictionary
        out = out.withColumn(out_col, fence(remove_stopwords_expr(out_col, opts.stopwords, lowered)))
    if tuple(sorted(set(opts.ngrams))) != (1,):
        out = out.withColumn(out_col, fence(ngrams_expr(out_col, opts.ngrams)))
    return out


WORD_OR_GAP = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"


def corpus_remove_words(df: DataFrame, words: Iterable[str], text_col: str = "text") -> DataFrame:
    """Remove whole words from the text before tokenization (S10),
    case-insensitively; everything between words is kept as it is. The text
    is cut into runs of word and non-word characters inside the row."""
    words = sorted({w.lower() for w in words if w})
    if not words:
        return df
    runs = F.regexp_extract_all(F.col(text_col), F.lit(WORD_OR_GAP), 0)
    kept = F.filter(runs, lambda r: ~F.lower(r).isin(words))
    return df.withColumn(text_col, F.array_join(kept, ""))


def raw_tokens(df: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """Library-default tokens: nothing removed, case kept (location kwic)."""
    return tokenize(df, RAW, text_col, out_col)
