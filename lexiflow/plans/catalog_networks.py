"""Registered queries of collocations, compounding, the indexed dictionary,
document similarity, term networks, the stored index, deep pages and stems by
rules, with DuckDB SQL where SQL can express them."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import collocations as C
from ..operators import doc_similarity as D
from ..operators import kwic as K
from ..operators import networks as N
from ..operators import search as Q
from ..operators import stats as A
from ..operators.dfm import dfm
from ..operators.dictionary_index import dictionary_lookup_indexed
from ..operators.pages import store_pages
from ..operators.stem_rules import stem_features_by_rules
from ..operators.svd import truncated_svd
from ..operators.table_view import table_filter
from ..operators.tokens import clean_tokens
from ..operators.topics import topic_model
from ..options import TextOptions
from ..session import materialize, storage_folder
from ..sources.profile import usable_docvars
from ..sources.token_index import build_index
from . import sql_text as S
from .catalog import (DEFAULT_SQL, DICT_GLOB, DICT_MULTI, DICT_REGEX, KW_COLS, PROFILE_COLS, Q_MAIN, Q_PAGE, RAW_TOK,
                      SEARCH_SQL, SQL, _raw_tokens, _sql, _toks_cte, load_corpus, load_dfm, register)

# Query parameters of the registered queries.
COMPOUNDS = ["of the", "in the", "the of the", "de la", "und die", "in"]
MIN_G2, MIN_GRAM = 30, 10
CASED = TextOptions(lowercase=False)


def _tokens(spark, sf, opts=TextOptions()):
    return clean_tokens(load_corpus(spark, sf), opts)


# ------------------------------------------------- collocations, compounds

def _cell(observed: str, product: str) -> str:
    return f"CASE WHEN {observed} > 0 THEN {observed} * ln({observed} * total / ({product})) ELSE 0 END"


#: The four cells of one cut, ``l`` and ``r`` the counts of its parts.
G2 = ("(CASE WHEN n * total >= l * r THEN 2 ELSE -2 END) * (" + " + ".join(
    [_cell("n", "l * r"), _cell("(l - n)", "l * (total - r)"), _cell("(r - n)", "(total - l) * r"),
     _cell("(total - l - r + n)", "(total - l) * (total - r)")]) + ")")


def _collocation_ctes(sizes, min_count: int, src: str = "toks") -> list[str]:
    ctes = [f"words AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS w, unnest(range(1, len(tokens) + 1)) AS p FROM {src})"]
    parts = []
    for size in sizes:
        cols = ", ".join(f"w{k}.w AS w{k}" for k in range(size))
        joins = " ".join(f"JOIN words w{k} ON w{k}.doc_id = w0.doc_id AND w{k}.p = w0.p + {k}" for k in range(1, size))
        names = ", ".join(f"w{k}" for k in range(size))
        ctes.append(f"g{size} AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n, count(DISTINCT doc_id) AS nb_docs "
                    f"FROM (SELECT w0.doc_id, {cols} FROM words w0 {joins}) GROUP BY {names})")
        cuts = []
        for cut in range(1, size):
            left, right = ([f"w{k}" for k in ks] for ks in (range(cut), range(cut, size)))
            cuts.append(
                f"SELECT {names}, n, nb_docs, sum(n) OVER (PARTITION BY {', '.join(left)}) AS l, "
                f"sum(n) OVER (PARTITION BY {', '.join(right)}) AS r, sum(n) OVER () AS total FROM g{size}")
        scored = " UNION ALL ".join(f"SELECT {names}, n, nb_docs, log2(n * total / (l * r)) AS pmi, {G2} AS g2 FROM ({c})"
                                    for c in cuts)
        parts.append(f"SELECT {' || chr(32) || '.join(names.split(', '))} AS expression, {size} AS size, n::BIGINT AS n, "
                     f"nb_docs::BIGINT AS nb_docs, round(arg_min(g2, {{'pmi': pmi, 'g2': g2}}), 4) AS g2, round(min(pmi), 4) AS pmi "
                     f"FROM ({scored}) WHERE n >= {min_count} GROUP BY {names}, n, nb_docs")
    return [*ctes, "colloc AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"]


TOKS = _toks_cte(cols="doc_id").replace("toks AS (", "toks AS MATERIALIZED (", 1)


@register("collocations", _sql(S.docs_cte(), TOKS, *_collocation_ctes((2, 3), 5), body="SELECT * FROM colloc"))
def q_collocations(spark, sf):
    return C.collocations(_tokens(spark, sf), (2, 3), 5)


@register("collocations_of_names", _sql(
    S.docs_cte(), _toks_cte(CASED, cols="doc_id").replace("toks AS (", "toks AS MATERIALIZED (", 1),
    *_collocation_ctes((2,), 2),
    body=r"SELECT * FROM colloc WHERE regexp_matches(expression, '^\p{Lu}[^ ]* \p{Lu}')"))
def q_collocations_of_names(spark, sf):
    return C.collocations(_tokens(spark, sf, CASED), (2,), 2, proper_nouns=True)


def _compound_ctes(listed: str, longest: int, src: str = "toks") -> list[str]:
    """``ctok``: tokens with the expressions of the list ``listed`` joined. The
    greedy choice is a fold over the places where an expression begins."""
    size = "CASE " + " ".join(
        f"WHEN p + {k - 1} <= len(tokens) AND list_contains((SELECT e FROM exprs), array_to_string(tokens[p:p + {k - 1}], ' ')) THEN {k}"
        for k in range(longest, 1, -1)) + " ELSE 0 END"
    return [
        f"exprs AS MATERIALIZED ({listed})",
        f"begins AS MATERIALIZED (SELECT doc_id, p, {size} AS size FROM (SELECT doc_id, tokens, "
        f"unnest(range(1, len(tokens))) AS p FROM {src}))",
        "cands AS (SELECT doc_id, list({'p': p, 'size': size} ORDER BY p) AS c FROM begins WHERE size > 0 GROUP BY doc_id)",
        "spans AS (SELECT doc_id, list_reduce(list_prepend({'last': 0, 'at': []::BIGINT[], 'size': []::BIGINT[]}, "
        "list_transform(c, lambda x: {'last': x.p, 'at': [x.p], 'size': [x.size]})), "
        "lambda a, x: CASE WHEN x.last > a.last THEN {'last': x.last + x.size[1] - 1, 'at': list_concat(a.at, x.at), "
        "'size': list_concat(a.size, x.size)} ELSE a END) AS s FROM cands)",
        "picked AS (SELECT doc_id, unnest(s.at) AS p, unnest(s.size) AS size FROM spans)",
        "covered AS (SELECT doc_id, unnest(range(p, p + size)) AS p FROM picked)",
        f"each AS (SELECT doc_id, unnest(tokens) AS w, unnest(range(1, len(tokens) + 1)) AS p FROM {src})",
        "cterm AS (SELECT doc_id, w AS term FROM each ANTI JOIN covered USING (doc_id, p) UNION ALL "
        f"SELECT doc_id, array_to_string(t.tokens[picked.p:picked.p + picked.size - 1], '_') FROM picked JOIN {src} t USING (doc_id))",
        "dfm AS (SELECT doc_id, term, count(*)::BIGINT AS n FROM cterm GROUP BY ALL)"]


_FIXED_LIST = "SELECT [" + ", ".join(f"'{e}'" for e in COMPOUNDS if " " in e) + "] AS e"


@register("compound_tokens", _sql(S.docs_cte(), TOKS, *_compound_ctes(_FIXED_LIST, 3), body=S.freq_select()))
def q_compound_tokens(spark, sf):
    return A.frequent_terms(dfm(C.compound_tokens(_tokens(spark, sf), COMPOUNDS)))


@register("frequent_terms_compounded", _sql(
    S.docs_cte(), TOKS, *_collocation_ctes((2, 3), MIN_GRAM),
    *_compound_ctes(f"SELECT list(expression) AS e FROM colloc WHERE g2 >= {MIN_G2}", 3), body=S.freq_select()))
def q_frequent_terms_compounded(spark, sf):
    """Terms after the collocations found in the corpus itself are joined."""
    toks = materialize(_tokens(spark, sf))
    found = materialize(C.collocations(toks, (2, 3), MIN_GRAM).where(F.col("g2") >= MIN_G2))
    return A.frequent_terms(dfm(C.compound_tokens(toks, found, longest=3)))


# ---------------------------------------------------- indexed dictionary

def _indexed(name: str, same_as: str, dictionary, valuetype: str):
    @register(name, SQL[same_as])
    def q(spark, sf):
        return A.frequent_terms(dfm(dictionary_lookup_indexed(_tokens(spark, sf), dictionary, valuetype)))
    return q


_indexed("dictionary_index_glob", "dictionary_glob", DICT_GLOB, "glob")
_indexed("dictionary_index_regex", "dictionary_regex", DICT_REGEX, "regex")
_indexed("dictionary_index_multiword", "dictionary_multiword", DICT_MULTI, "fixed")


def load_large_dictionary(spark, sf):
    """A dictionary of thousands of values from the conversations: their words
    and pairs of neighbouring words, under keys by length."""
    toks = clean_tokens(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text"))
    tok = F.col("tokens")
    values = F.concat(tok, F.when(F.size(tok) > 1, F.transform(
        F.sequence(F.lit(1), F.size(tok) - 1), lambda i: F.concat_ws(" ", F.element_at(tok, i), F.element_at(tok, i + 1))))
        .otherwise(F.array().cast("array<string>")))
    value = toks.select(F.explode(values).alias("value")).distinct()
    number = (F.length("value") % 7).cast("int")
    return value.select(number.alias("key_no"), F.concat(F.lit("len"), number.cast("string")).alias("key"), "value")


@register("dictionary_index_large", _sql(
    S.docs_cte(), TOKS,
    "ctoks AS (SELECT " + S.tokens_sql("text") + " AS tokens FROM conversations)",
    "vals AS MATERIALIZED (SELECT DISTINCT v, length(v) % 7 AS k FROM (SELECT unnest(tokens) AS v FROM ctoks UNION ALL "
    "SELECT unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) FROM ctoks))",
    "each AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS w, unnest(list_concat(tokens[2:], [NULL])) AS nxt, "
    "unnest(range(1, len(tokens) + 1)) AS p FROM toks)",
    "hits AS (SELECT doc_id, p, k, max(size) AS size FROM (SELECT doc_id, p, k, 1 AS size FROM each JOIN vals ON v = w "
    "UNION ALL SELECT doc_id, p, k, 2 FROM each JOIN vals ON v = w || ' ' || nxt) GROUP BY ALL)",
    # values of two words: of neighbouring candidates the first, third, ... count
    "runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, k ORDER BY p) AS run FROM hits WHERE size = 2)",
    "pairs AS (SELECT doc_id, p, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k, run ORDER BY p) AS i FROM runs) WHERE i % 2 = 1)",
    "inside AS (SELECT doc_id, p + 1 AS p, k FROM pairs)",
    "starts AS (SELECT doc_id, p, k FROM hits ANTI JOIN inside USING (doc_id, p, k))",
    "covered AS (SELECT doc_id, p FROM starts UNION SELECT doc_id, p FROM inside)",
    "dterm AS (SELECT doc_id, 'LEN' || k AS term FROM starts UNION ALL "
    "SELECT doc_id, w FROM each ANTI JOIN covered USING (doc_id, p))",
    "dfm AS (SELECT doc_id, term, count(*)::BIGINT AS n FROM dterm GROUP BY ALL)", body=S.freq_select()))
def q_dictionary_index_large(spark, sf):
    return A.frequent_terms(dfm(dictionary_lookup_indexed(_tokens(spark, sf), load_large_dictionary(spark, sf), "fixed")))


# ------------------------------------------------------ document cosine

DFM_M = S.dfm_cte().replace("dfm AS (", "dfm AS MATERIALIZED (", 1)
CLASS_CTES = [
    S.docs_cte(), TOKS, DFM_M,
    "bag AS (SELECT doc_id, list({'term': term, 'n': n} ORDER BY term) AS bag FROM dfm GROUP BY doc_id)",
    "classes AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY bag) AS class_id, "
    "count(*) OVER (PARTITION BY bag) AS n_docs FROM bag)"]


@register("document_classes", _sql(*CLASS_CTES, body="SELECT doc_id, class_id, n_docs FROM classes"))
def q_document_classes(spark, sf):
    return D.document_classes(load_dfm(spark, sf))


@register("document_cosine", _sql(
    *CLASS_CTES,
    "df AS (SELECT term, log10((SELECT count(*) FROM docs) / count(*)) AS idf FROM dfm GROUP BY term)",
    "v AS (SELECT doc_id, n_docs, term, n * idf AS v FROM dfm JOIN classes USING (doc_id) JOIN df USING (term) "
    "WHERE doc_id = class_id AND idf > 0)",
    "u AS MATERIALIZED (SELECT doc_id, n_docs, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS w FROM v)",
    "pair AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, any_value(a.n_docs) AS n_a, any_value(b.n_docs) AS n_b, "
    "sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL)",
    body="SELECT doc_a, doc_b, n_a, n_b, round(cosine, 6) AS cosine FROM pair WHERE cosine >= 0.8 - 1e-9"))
def q_document_cosine(spark, sf):
    return D.document_cosine(load_dfm(spark, sf, materialize=True), 0.8)


# ------------------------------------------------------------- networks

def _edge_ctes(window: int, min_termfreq: int, min_count: int) -> list[str]:
    return [S.docs_cte(), TOKS,
            "each AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS w, unnest(range(1, len(tokens) + 1)) AS p FROM toks)",
            f"freq AS MATERIALIZED (SELECT w, count(*) AS f FROM each GROUP BY w HAVING count(*) >= {min_termfreq})",
            "near AS (SELECT a.doc_id, least(a.w, b.w) AS term_a, greatest(a.w, b.w) AS term_b FROM each a "
            f"JOIN (SELECT doc_id, w, p, unnest(range(1, {window + 1})) AS step FROM each) b ON a.doc_id = b.doc_id "
            "AND a.p = b.p - b.step AND a.w <> b.w)",
            "edges AS MATERIALIZED (SELECT term_a, term_b, n, nb_docs, round(n / sqrt(fa.f::DOUBLE * fb.f), 6) AS weight FROM "
            "(SELECT term_a, term_b, count(*) AS n, count(DISTINCT doc_id) AS nb_docs FROM near GROUP BY ALL) "
            f"JOIN freq fa ON fa.w = term_a JOIN freq fb ON fb.w = term_b WHERE n >= {min_count})"]


@register("cooccurrence_edges", _sql(*_edge_ctes(5, 10, 3), body="SELECT * FROM edges"))
def q_cooccurrence_edges(spark, sf):
    return N.cooccurrence_edges(_tokens(spark, sf), 5, min_termfreq=10, min_count=3)


@register("cooccurrence_tree")
def q_cooccurrence_tree(spark, sf):
    """The maximum spanning tree of the same edges (tested against Kruskal)."""
    return N.maximum_spanning_tree(N.cooccurrence_edges(_tokens(spark, sf), 5, min_termfreq=10, min_count=3))


def _association_sql(value: str, k: int = 10, min_docs: int = 20) -> str:
    return _sql(
        *DEFAULT_SQL[:2], DFM_M.replace("MATERIALIZED", "MATERIALIZED", 1),
        "tot AS MATERIALIZED (SELECT term, sum(n)::DOUBLE AS sx, sum(n * n)::DOUBLE AS sxx, count(*)::DOUBLE AS df "
        f"FROM dfm GROUP BY term HAVING count(*) >= {min_docs})",
        "kept AS MATERIALIZED (SELECT doc_id, term, n::DOUBLE AS x FROM dfm SEMI JOIN tot USING (term))",
        "pair AS (SELECT a.term AS a, b.term AS b, sum(a.x * b.x) AS sxy, count(*) AS common FROM kept a JOIN kept b "
        "ON a.doc_id = b.doc_id AND a.term <> b.term GROUP BY ALL)",
        "total AS (SELECT count(*)::DOUBLE AS nd FROM docs)",
        f"scored AS (SELECT a AS term, b AS other, common, round({value}, 4) AS value FROM pair JOIN tot ta ON ta.term = a "
        "JOIN tot tb ON tb.term = b, total)",
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY value DESC, other) AS rank FROM scored "
        "WHERE value IS NOT NULL)",
        body=f"SELECT term, rank, other, value, common AS nb_docs_common FROM ranked WHERE rank <= {k}")


CORRELATION = ("CASE WHEN nd * ta.sxx > ta.sx * ta.sx AND nd * tb.sxx > tb.sx * tb.sx THEN "
               "(nd * sxy - ta.sx * tb.sx) / sqrt((nd * ta.sxx - ta.sx * ta.sx) * (nd * tb.sxx - tb.sx * tb.sx)) END")


def _share_cell(observed: str, product: str) -> str:
    return f"CASE WHEN {observed} > 0 AND {product} > 0 THEN {observed} * ln({observed} * nd / ({product})) ELSE 0 END"


LOGLIK = "(CASE WHEN common * nd >= ta.df * tb.df THEN 2 ELSE -2 END) * (" + " + ".join(
    [_share_cell("common", "ta.df * tb.df"), _share_cell("(ta.df - common)", "ta.df * (nd - tb.df)"),
     _share_cell("(tb.df - common)", "(nd - ta.df) * tb.df"),
     _share_cell("(nd - ta.df - tb.df + common)", "(nd - ta.df) * (nd - tb.df)")]) + ")"


@register("term_associations", _association_sql(CORRELATION))
def q_term_associations(spark, sf):
    return N.term_associations(load_dfm(spark, sf, materialize=True), 10, min_docs=20)


@register("term_associations_loglik", _association_sql(LOGLIK))
def q_term_associations_loglik(spark, sf):
    return N.term_associations(load_dfm(spark, sf, materialize=True), 10, min_docs=20, method="loglik")


# ------------------------------------------------ stored index, deep pages

def _index(spark, sf):
    """The whole corpus, indexed in a new folder."""
    return build_index(_tokens(spark, sf), f"{storage_folder(spark)}/{uuid.uuid4().hex}")


@register("indexed_search_by_group", SQL["search_by_group"])
def q_indexed_search_by_group(spark, sf):
    return Q.search_by_group(_index(spark, sf).search(Q_MAIN), "lang")


@register("indexed_kwic", SQL["kwic_clean_tokens"])
def q_indexed_kwic(spark, sf):
    return _index(spark, sf).kwic(["que", "und"])


@register("indexed_cooccurring_docs", "SELECT * FROM (" + SQL["cooccurring_docs"] + ") WHERE nb_docs_common > 0")
def q_indexed_cooccurring_docs(spark, sf):
    return _index(spark, sf).cooccurring_docs("der")


DEEP_PAGE, PAGE_ROWS = 900, 20


@register("frequent_terms_deep_page", _sql(*DEFAULT_SQL, body=S.freq_select(limit=PAGE_ROWS)
                                           + f" OFFSET {(DEEP_PAGE - 1) * PAGE_ROWS}"))
def q_frequent_terms_deep_page(spark, sf):
    terms = A.frequent_terms(load_dfm(spark, sf))
    return store_pages(terms, F.desc("nb_terms"), "term").page(DEEP_PAGE, PAGE_ROWS)


@register("search_documents_deep_page", _sql(*SEARCH_SQL, S.hits_cte(Q_PAGE), body=(
    "SELECT doc_id, lang, n FROM hits WHERE n > 0 ORDER BY doc_id LIMIT 10 OFFSET 30")))
def q_search_documents_deep_page(spark, sf):
    hits = Q.search(load_dfm(spark, sf), Q_PAGE).where("n > 0").select("doc_id", "lang", "n")
    return store_pages(hits, "doc_id").page(4, 10)


# ----------------------------------------------------------- stems by rules

def _stems_by_rules(language: str):
    @register(f"stem_rules_{language}")
    def q(spark, sf):
        return A.frequent_terms(stem_features_by_rules(load_dfm(spark, sf, materialize=True), language))
    return q


for _language in ("english", "french", "german", "spanish"):
    _stems_by_rules(_language)


# ------------------------------------------------- topics, singular values

@register("topic_terms")
def q_topic_terms(spark, sf):
    """Top terms of five topics (no SQL; tested on planted topics)."""
    return topic_model(load_dfm(spark, sf, materialize=True), 5, rounds=5).topic_terms(10)


@register("svd_values")
def q_svd_values(spark, sf):
    """The five largest singular values of the counts (tested against numpy)."""
    values = truncated_svd(load_dfm(spark, sf, materialize=True), 5, iterations=4).values
    return spark.createDataFrame([(i, round(v, 4)) for i, v in enumerate(values, start=1)], "component long, value double")


# ------------------------------------------------------- phrases with globs

@register("kwic_phrase_glob", _sql(RAW_TOK, body=(
    f"SELECT {KW_COLS} FROM (SELECT doc_id, CAST(i AS BIGINT) AS \"from\", CAST(i + 1 AS BIGINT) AS \"to\", "
    "array_to_string(tokens[greatest(1, i - 7):i - 1], ' ') AS pre, array_to_string(tokens[i:i + 1], ' ') AS keyword, "
    "array_to_string(tokens[i + 2:i + 8], ' ') AS post FROM (SELECT doc_id, tokens, unnest(list_filter(range(1, len(tokens)), "
    "lambda i: starts_with(lower(tokens[i]), 'th') AND length(tokens[i + 1]) = 3 AND ends_with(lower(tokens[i + 1]), 'e'))) "
    "AS i FROM rt))")))
def q_kwic_phrase_glob(spark, sf):
    return K.kwic(_raw_tokens(spark, sf), phrase="th* ??e")


# --------------------------------------- column filters, strict docvar profile

@register("table_column_filters", _sql(*DEFAULT_SQL, "ft AS (" + S.freq_select() + ")", body=(
    "SELECT * FROM ft WHERE contains(lower(term), 'th') AND nb_docs BETWEEN 2 AND 50 AND nb_terms IN (3, 4, 5, 8, 13)")))
def q_table_column_filters(spark, sf):
    return table_filter(A.frequent_terms(load_dfm(spark, sf)),
                        filters={"term": "TH", "nb_docs": (2, 50), "nb_terms": [3, 4, 5, 8, 13]})


@register("docvar_profile_by_levels", "SELECT name, kind, n_distinct, n_distinct > 1 AND n_distinct < 100 AS usable FROM ("
          + SQL["docvar_profile"] + ")")
def q_docvar_profile_by_levels(spark, sf):
    """Only the number of levels decides, whatever the type."""
    return usable_docvars(load_corpus(spark, sf, labels=True), PROFILE_COLS, types_always=()).drop("col_order")
