"""Builders of the DuckDB oracle SQL text for the registered queries.

They mirror the Spark expressions of ``operators.tokens`` with DuckDB's
list functions and the same regular expressions (RE2 reads them as Java
does). Only used to write ``oracle_sql()`` strings."""
from __future__ import annotations

from ..functions.patterns import NUMBER_TOKEN, URL_PREFIXES, sql_string, token_pattern
from ..operators.tokens import _single_pattern_pred, _split_value
from ..options import TextOptions

DOC_DATE = "DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER)"


def docs_cte(labels: bool = False, lowercase_text: bool = False) -> str:
    text = "lower(text)" if lowercase_text else "text"
    if labels:
        return (f"docs AS (SELECT d.doc_id, {text.replace('text', 'd.text')} AS text, d.lang, d.source, "
                f"d.n_chars, {DOC_DATE.replace('doc_id', 'd.doc_id')} AS doc_date, l.quality, l.toxic "
                "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
    return (f"docs AS (SELECT doc_id, {text} AS text, lang, source, n_chars, {DOC_DATE} AS doc_date "
            "FROM documents)")


def tokens_sql(text: str, opts: TextOptions = TextOptions()) -> str:
    toks = f"regexp_extract_all({text}, {sql_string(token_pattern(opts))})"
    drops = []
    if opts.remove_url:
        drops.append(f"starts_with(t, '{URL_PREFIXES[0]}') OR starts_with(t, '{URL_PREFIXES[1]}')")
    if opts.remove_numbers:
        drops.append(f"regexp_matches(t, {sql_string(NUMBER_TOKEN)})")
    if drops:
        toks = f"list_filter({toks}, lambda t: NOT ({' OR '.join(drops)}))"
    if opts.lowercase:
        toks = f"list_transform({toks}, lambda t: lower(t))"
    return f"coalesce({toks}, []::VARCHAR[])"


def _word_pred_sql(patterns, valuetype: str, t: str) -> str:
    conds, eqs = [], []
    for p in patterns:
        kind, v = _single_pattern_pred(p, valuetype)
        if kind == "eq":
            eqs.append(v)
        elif kind == "prefix":
            conds.append(f"starts_with(lower({t}), {sql_string(v)})")
        elif kind == "suffix":
            conds.append(f"ends_with(lower({t}), {sql_string(v)})")
        elif kind == "contains":
            conds.append(f"contains(lower({t}), {sql_string(v)})")
        else:
            rx = v.replace("(?iu)", "(?i)") if valuetype != "regex" else "(?i)(?:" + v + ")"
            conds.append(f"regexp_matches({t}, {sql_string(rx)})")
    if eqs:
        conds.insert(0, f"lower({t}) IN ({', '.join(sql_string(e) for e in sorted(set(eqs)))})")
    return "(" + " OR ".join(conds) + ")"


def dictionary_sql(tok: str, dictionary, valuetype: str) -> str:
    entries = [(k, [v for v in vals if v and v.strip()]) for k, vals in dictionary]
    entries = [(k, v) for k, v in entries if v]
    single = all(len(_split_value(v)) == 1 for _, vals in entries for v in vals)
    if single:
        keys = ", ".join(f"CASE WHEN {_word_pred_sql(vals, valuetype, 't')} THEN "
                         f"{sql_string(k.upper())} END" for k, vals in entries)
        ks = f"list_filter([{keys}], lambda x: x IS NOT NULL)"
        return (f"flatten(list_transform({tok}, lambda t: CASE WHEN len({ks}) > 0 THEN {ks} "
                f"ELSE [t] END))")
    # general: per key, match length at each position, greedy spans by a fold
    span_exprs = []
    for k, vals in entries:
        by_len: dict[int, list[list[str]]] = {}
        for v in vals:
            w = _split_value(v)
            by_len.setdefault(len(w), []).append(w)
        branches = []
        for ln in sorted(by_len, reverse=True):
            alts = []
            for words in by_len[ln]:
                parts = [f"({f'i + {ln - 1} <= len({tok})' if ln > 1 else 'true'})"]
                for j, w in enumerate(words):
                    parts.append("coalesce(" + _word_pred_sql([w], valuetype, f"{tok}[i + {j}]") + ", false)")
                alts.append("(" + " AND ".join(parts) + ")")
            branches.append(f"WHEN {' OR '.join(alts)} THEN {ln}")
        lens = f"list_transform(range(1, len({tok}) + 1), lambda i: CASE {' '.join(branches)} ELSE 0 END)"
        fold = (f"list_reduce(list_prepend(0, {lens}), lambda acc, l, i: CASE WHEN i > 1 AND l > 0 "
                f"AND i - 1 > acc.last THEN {{'last': i - 1 + l - 1, 'spans': list_append(acc.spans, "
                f"{{'s': i - 1, 'e': i - 1 + l - 1}})}} ELSE acc END, "
                f"{{'last': 0, 'spans': []::STRUCT(s INTEGER, e INTEGER)[]}}).spans")
        span_exprs.append((k.upper(), fold))
    return span_exprs  # handled by the caller (needs a CTE per key)


def ngrams_sql(tok: str, sizes) -> str:
    parts = []
    for k in sorted(set(sizes)):
        if k == 1:
            parts.append(tok)
        else:
            parts.append(f"CASE WHEN len({tok}) >= {k} THEN list_transform(range(1, len({tok}) - {k - 2}), "
                         f"lambda i: array_to_string({tok}[i:i + {k - 1}], '_')) ELSE []::VARCHAR[] END")
    return parts[0] if len(parts) == 1 else "flatten([" + ", ".join(parts) + "])"


def stopwords_sql(tok: str, stops) -> str:
    lst = ", ".join(sql_string(s) for s in sorted({s.lower() for s in stops}))
    return f"list_filter({tok}, lambda t: lower(t) NOT IN ({lst}))"


def dfm_cte(src: str = "toks", extra: str = "") -> str:
    """Long dfm ``doc_id, term, n`` from a CTE with ``tokens``."""
    sel = f"doc_id{', ' + extra if extra else ''}"
    return (f"dfm AS (SELECT {sel}, term, CAST(count(*) AS BIGINT) AS n FROM "
            f"(SELECT {sel}, unnest(tokens) AS term FROM {src}) GROUP BY ALL)")


def freq_select(src: str = "dfm", ndocs: str = "(SELECT count(*) FROM docs)", limit: int | None = None) -> str:
    lim = f" LIMIT {limit}" if limit else ""
    return (f"SELECT term, CAST(sum(n) AS BIGINT) AS nb_terms, CAST(count(*) AS BIGINT) AS nb_docs, "
            f"round(count(*) / {ndocs} * 100, 2) AS prop_docs FROM {src} GROUP BY term "
            f"ORDER BY nb_terms DESC, term{lim}")


def query_sql(node, term_col) -> str:
    """SQL text of a parsed term query (same semantics as
    ``functions.query.result_column``)."""
    def go(n):
        if n.kind == "num":
            return str(n.value), "num"
        if n.kind == "term":
            return term_col(n.value.lower()), "num"
        if n.kind == "not":
            c, k = go(n.args[0])
            return f"(NOT {boo(c, k)})", "bool"
        if n.kind == "neg":
            c, k = go(n.args[0])
            return f"(-{num(c, k)})", "num"
        a, ka = go(n.args[0])
        b, kb = go(n.args[1])
        if n.value == "|":
            return f"({boo(a, ka)} OR {boo(b, kb)})", "bool"
        if n.value == "&":
            return f"({boo(a, ka)} AND {boo(b, kb)})", "bool"
        op = {"==": "=", "!=": "<>"}.get(n.value, n.value)
        kind = "num" if n.value in "+-*" else "bool"
        return f"({num(a, ka)} {op} {num(b, kb)})", kind

    def num(c, k):
        return c if k == "num" else f"CAST({c} AS BIGINT)"

    def boo(c, k):
        return c if k == "bool" else f"({c} <> 0)"
    c, k = go(node)
    return f"CAST({c} AS BIGINT)"


def hits_cte(query: str, cols: str = "doc_id, lang, source, n_chars, doc_date", src_docs: str = "docs",
             binary: bool = False) -> str:
    from ..functions.query import parse, query_terms
    node = parse(query)
    terms = query_terms(node)
    val = "1" if binary else "n"
    sums = ", ".join(f"sum(CASE WHEN term = {sql_string(t)} THEN {val} END) AS t{i}"
                     for i, t in enumerate(terms))
    idx = {t: i for i, t in enumerate(terms)}
    expr = query_sql(node, lambda t: f"coalesce(s.t{idx[t]}, 0)")
    inlist = ", ".join(sql_string(t) for t in terms)
    dcols = ", ".join(f"d.{c.strip()}" for c in cols.split(","))
    return (f"hits AS (SELECT {dcols}, {expr} AS n FROM {src_docs} d LEFT JOIN "
            f"(SELECT doc_id, {sums} FROM dfm WHERE term IN ({inlist}) GROUP BY doc_id) s "
            f"ON d.doc_id = s.doc_id)")
