"""Registered queries over the test tables, each with its DuckDB oracle SQL.

Inputs (§7.3 of the survey): ``documents`` (left join ``labels`` where the
docvars ``quality``/``toxic`` are used) is the corpus, with a derived date
docvar ``doc_date``; ``conversations`` gives the parsed token table. Every
query runs over the whole tables.
"""
from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import sql_string
from ..operators import dfm as M
from ..operators import kwic as K
from ..operators import parsed as P
from ..operators import search as Q
from ..operators import similarity as H
from ..operators import stats as A
from ..operators.filters import filter_date_range, filter_documents, filter_in, filter_range
from ..operators.stem import SUFFIXES, stem_features, suffix_pattern
from ..operators.table_view import table_view
from ..operators.tokens import clean_tokens, corpus_remove_words, tokenize
from ..options import RAW, TextOptions
from ..sources.corpus import corpus, corpus_head, raw_of, replace_texts, with_raw
from ..sources.lexicon import ENGLISH_STOPWORDS, dictionary_from_lines, dictionary_to_lines
from ..sources.parsed import parsed_tokens
from ..sources.profile import docvar_domains, usable_docvars
from ..session import spread
from . import sql_text as S
from .chain import explore

DOCVARS = ["lang", "source", "n_chars", "doc_date"]
LABELS = ["quality", "toxic"]

# Query parameters of the registered queries.
DICT_FIXED = [("article", ["the", "a", "an"]), ("conj", ["and", "or", "but"])]
DICT_GLOB = [("th", ["th*"]), ("of_like", ["*f"]), ("two", ["??"]), ("mid", ["d?r"])]
DICT_REGEX = [("ing", ["ing$"]), ("qu", ["^qu"]), ("ei", ["ei"])]
DICT_MULTI = [("of_the", ["of the", "of a"]), ("and", ["and", "and the"]), ("the", ["the"])]
Q_MAIN = "the & !that"
Q_OR_NOT = "(the | of) & !that"
Q_NOT = "!the"
Q_COMPARE = "the + of > 10"
Q_PAGE = "de & la"
Q_KWIC = "der | die"
Q_META = "que & la"
MISSING = ["the", "zzzz", "qwerty", "of", "xyzzy"]


# ------------------------------------------------------------------ inputs

def _doc_date():
    return F.date_add(F.lit(_dt.date(2024, 1, 1)), (F.col("doc_id") % 365).cast("int"))


def load_corpus(spark: SparkSession, sf: str, labels: bool = False,
                lowercase_text: bool = False) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_date", _doc_date())
    if lowercase_text:
        d = d.withColumn("text", F.lower("text"))
    c = corpus(d, docvars=DOCVARS)
    if labels:
        lab = spark.read.parquet(f"{sf}/labels.parquet")
        c = c.join(lab, "doc_id", "left")
    return c


def load_dfm(spark, sf, opts=TextOptions(), labels=False, materialize=False) -> M.Dfm:
    # n-grams are made from the cleaned words, by the dfm
    words = clean_tokens(load_corpus(spark, sf, labels), replace(opts, ngrams=(1,)))
    d = M.dfm(words, ngrams=opts.ngrams)
    return d.materialize() if materialize else d


def load_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed-token table derived from ``conversations``: one document per
    conversation, tokens of each turn in order (library tokenization), a POS
    that is a fixed function of the token, lemma = lowercased token."""
    conv = spread(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text"))
    toks = tokenize(conv, RAW)
    rows = toks.select(F.col("conv_id").alias("doc_id"), "turn",
                       F.posexplode("tokens").alias("i", "token"))
    tagged = rows.select(
        "doc_id", (F.col("turn") * 1000000 + F.col("i")).alias("token_pos"), "token",
        F.lower("token").alias("lemma"), _pos_rule(F.col("token")).alias("upos"))
    return parsed_tokens(tagged, layout="udpipe")


def _pos_rule(t):
    n = F.length(t)
    return (F.when(t.rlike(r"^[\p{P}\p{S}]"), "PUNCT").when(t.rlike(r"^\p{N}"), "NUM")
            .when(n <= 2, "ADP").when(n <= 3, "DET").when(n <= 5, "VERB")
            .when(n <= 8, "NOUN").otherwise("ADJ"))


POS_SQL = (r"CASE WHEN regexp_matches(token, '^[\p{P}\p{S}]') THEN 'PUNCT' "
           r"WHEN regexp_matches(token, '^\p{N}') THEN 'NUM' WHEN length(token) <= 2 THEN 'ADP' "
           r"WHEN length(token) <= 3 THEN 'DET' WHEN length(token) <= 5 THEN 'VERB' "
           r"WHEN length(token) <= 8 THEN 'NOUN' ELSE 'ADJ' END")
PARSED_CTE = (
    "ptok AS (SELECT conv_id AS doc_id, turn, " + S.tokens_sql("text", RAW) + " AS tokens FROM conversations), "
    "pexp AS (SELECT doc_id, turn, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS i FROM ptok), "
    "parsed AS (SELECT doc_id, turn * 1000000 + i AS token_pos, token, lower(token) AS lemma, "
    + POS_SQL + " AS pos FROM pexp)")


# ----------------------------------------------------------------- helpers

def _sql(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


def _toks_cte(opts: TextOptions = TextOptions(), cols: str = "doc_id, lang, source, n_chars, doc_date",
              src: str = "docs") -> str:
    return f"toks AS (SELECT {cols}, {S.tokens_sql('text', opts)} AS tokens FROM {src})"


DEFAULT_SQL = [S.docs_cte(), _toks_cte(), S.dfm_cte()]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------- 1. minimal slice

@register("frequent_terms", _sql(*DEFAULT_SQL, body=S.freq_select(limit=A.FREQUENT_TERMS_MAX)))
def q_frequent_terms(spark, sf):
    return A.frequent_terms(load_dfm(spark, sf), limit=A.FREQUENT_TERMS_MAX)


# ------------------------------------------------------------ 2. filters

DOC_COLS = "doc_id, lang, source, n_chars, doc_date"


@register("filter_numeric_range", _sql(S.docs_cte(), body=f"SELECT {DOC_COLS} FROM docs "
                                       "WHERE n_chars BETWEEN 1000 AND 5000"))
def q_filter_numeric_range(spark, sf):
    return filter_range(load_corpus(spark, sf), "n_chars", 1000, 5000).drop("text")


@register("filter_date_range", _sql(S.docs_cte(), body=f"SELECT {DOC_COLS} FROM docs "
                                    "WHERE doc_date BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'"))
def q_filter_date_range(spark, sf):
    return filter_date_range(load_corpus(spark, sf), "doc_date", "2024-03-01", "2024-06-30").drop("text")


@register("filter_categorical_with_null", _sql(
    S.docs_cte(labels=True), body=f"SELECT {DOC_COLS}, quality, toxic FROM docs "
    "WHERE quality IN (1) OR quality IS NULL"))
def q_filter_categorical_with_null(spark, sf):
    return filter_in(load_corpus(spark, sf, labels=True), "quality", [1, "NA"]).drop("text")


COMBINED = {"lang": ["en", "fr"], "n_chars": (500, 20000),
            "doc_date": (_dt.date(2024, 2, 1), _dt.date(2024, 11, 30))}


@register("filter_combined", _sql(
    "docs AS (SELECT * FROM (" + S.docs_cte()[len("docs AS ("):-1] + ") WHERE lang IN ('en', 'fr') "
    "AND n_chars BETWEEN 500 AND 20000 AND doc_date BETWEEN DATE '2024-02-01' AND DATE '2024-11-30')",
    _toks_cte(), S.dfm_cte(), body=S.freq_select()))
def q_filter_combined(spark, sf):
    docs = filter_documents(load_corpus(spark, sf), COMBINED)
    return A.frequent_terms(M.dfm(clean_tokens(docs)))


PROFILE_COLS = ["lang", "source", "n_chars", "doc_date", "quality", "toxic"]
PROFILE_KINDS = ["character", "character", "numeric", "date", "numeric", "numeric"]


def _profile_sql() -> str:
    parts = []
    for i, (c, k) in enumerate(zip(PROFILE_COLS, PROFILE_KINDS)):
        always = k in ("numeric", "date")
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS col_order, '{c}' AS name, '{k}' AS kind, "
            f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
            f"AS n_distinct FROM docs")
    body = ("SELECT col_order, name, kind, n_distinct, (n_distinct > 1 AND n_distinct < 100) OR kind IN "
            "('numeric', 'date') AS usable FROM (" + " UNION ALL ".join(parts) + ")")
    return _sql(S.docs_cte(labels=True), body=body)


@register("docvar_profile", _profile_sql())
def q_docvar_profile(spark, sf):
    out = usable_docvars(load_corpus(spark, sf, labels=True), PROFILE_COLS)
    return out.withColumn("col_order", F.col("col_order").cast("bigint"))


def _domains_sql() -> str:
    parts = []
    for c, k in zip(PROFILE_COLS, PROFILE_KINDS):
        if k in ("numeric", "date"):
            parts.append(f"SELECT '{c}' AS name, '{k}' AS kind, CAST(min({c}) AS VARCHAR) AS min_value, "
                         f"CAST(max({c}) AS VARCHAR) AS max_value, CAST(NULL AS VARCHAR) AS levels FROM docs")
        else:
            parts.append(
                f"SELECT '{c}' AS name, '{k}' AS kind, CAST(NULL AS VARCHAR) AS min_value, "
                f"CAST(NULL AS VARCHAR) AS max_value, array_to_string(list_sort(list(v)), ', ') AS levels "
                f"FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'NA') AS v FROM docs) "
                f"HAVING count(*) > 1 AND count(*) < 100")
    return _sql(S.docs_cte(labels=True), body=" UNION ALL ".join(parts))


@register("docvar_domains", _domains_sql())
def q_docvar_domains(spark, sf):
    dom = docvar_domains(load_corpus(spark, sf, labels=True), PROFILE_COLS)
    return dom.withColumn("levels", F.array_join("levels", ", "))


# ------------------------------------------------------------- 3. tokens

@register("token_counts", _sql(S.docs_cte(), _toks_cte(),
                               body="SELECT doc_id, CAST(len(tokens) AS BIGINT) AS ntokens FROM toks"))
def q_token_counts(spark, sf):
    t = clean_tokens(load_corpus(spark, sf))
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("ntokens"))


def _long_dfm_query(opts: TextOptions):
    def q(spark, sf):
        return load_dfm(spark, sf, opts).long
    sql = _sql(S.docs_cte(), _toks_cte(opts), S.dfm_cte(), body="SELECT doc_id, term, n FROM dfm")
    return q, sql


for _name, _opts in {
    "remove_numbers": TextOptions(remove_numbers=False),
    "split_hyphens": TextOptions(remove_hyphens=False),
    "dfm_long": TextOptions(),
}.items():
    _q, _s = _long_dfm_query(_opts)
    register(_name, _s)(_q)


@register("twitter_tags", _sql(S.docs_cte(), _toks_cte(), S.dfm_cte(),
                               body="SELECT term, CAST(sum(n) AS BIGINT) AS nb_terms, "
                                    "CAST(count(*) AS BIGINT) AS nb_docs FROM dfm "
                                    "WHERE starts_with(term, '#') OR starts_with(term, '@') GROUP BY term"))
def q_twitter_tags(spark, sf):
    t = M.term_totals(load_dfm(spark, sf))
    return t.filter(F.col("term").startswith("#") | F.col("term").startswith("@"))


@register("twitter_removed", _sql(S.docs_cte(), _toks_cte(TextOptions(remove_twitter=True)),
                                  S.dfm_cte(), body=S.freq_select()))
def q_twitter_removed(spark, sf):
    return A.frequent_terms(load_dfm(spark, sf, TextOptions(remove_twitter=True)))


def _chain_sql(opts: TextOptions, dict_single=None) -> list[str]:
    steps = [S.docs_cte(), _toks_cte(TextOptions(**{**opts.__dict__, "stopwords": (), "ngrams": (1,),
                                                      "dictionary": ()}), cols="doc_id", src="docs")]
    cur = "toks"
    if opts.dictionary:
        steps.append(f"tdict AS (SELECT doc_id, {S.dictionary_sql('tokens', opts.dictionary, opts.dictionary_type)}"
                     f" AS tokens FROM {cur})")
        cur = "tdict"
    if opts.stopwords:
        steps.append(f"tstop AS (SELECT doc_id, {S.stopwords_sql('tokens', opts.stopwords)} AS tokens FROM {cur})")
        cur = "tstop"
    if tuple(sorted(set(opts.ngrams))) != (1,):
        steps.append(f"tgram AS (SELECT doc_id, {S.ngrams_sql('tokens', opts.ngrams)} AS tokens FROM {cur})")
        cur = "tgram"
    steps.append(S.dfm_cte(cur))
    return steps


def _freq_chain(name: str, opts: TextOptions):
    @register(name, _sql(*_chain_sql(opts), body=S.freq_select()))
    def q(spark, sf):
        return A.frequent_terms(load_dfm(spark, sf, opts))
    return q


_freq_chain("stopword_removal", TextOptions(stopwords=tuple(ENGLISH_STOPWORDS)))
_freq_chain("ngrams_1_2", TextOptions(ngrams=(1, 2)))
_freq_chain("ngrams_after_stopwords", TextOptions(ngrams=(2,), stopwords=tuple(ENGLISH_STOPWORDS)))
_freq_chain("ngrams_1_3_5", TextOptions(ngrams=(1, 3, 5)))
_freq_chain("dictionary_fixed", TextOptions(dictionary=tuple((k, tuple(v)) for k, v in DICT_FIXED),
                                            dictionary_type="fixed"))
_freq_chain("dictionary_glob", TextOptions(dictionary=tuple((k, tuple(v)) for k, v in DICT_GLOB),
                                           dictionary_type="glob"))
_freq_chain("dictionary_regex", TextOptions(dictionary=tuple((k, tuple(v)) for k, v in DICT_REGEX),
                                            dictionary_type="regex"))
_freq_chain("dictionary_then_stopwords", TextOptions(
    dictionary=tuple((k, tuple(v)) for k, v in DICT_FIXED), dictionary_type="fixed",
    stopwords=("a", "the", "conj", "of")))


def _multi_sql() -> str:
    spans = S.dictionary_sql("tokens", DICT_MULTI, "fixed")
    cols = ", ".join(f"{fold} AS sp{i}" for i, (_, fold) in enumerate(spans))
    here = ", ".join(f"CASE WHEN len(list_filter(sp{i}, lambda sp: sp.s = p)) > 0 THEN {sql_string(k)} END"
                     for i, (k, _) in enumerate(spans))
    covered = " OR ".join(f"len(list_filter(sp{i}, lambda sp: sp.s <= p AND sp.e >= p)) > 0"
                          for i in range(len(spans)))
    out = (f"flatten(list_transform(range(1, len(tokens) + 1), lambda p: CASE WHEN {covered} THEN "
           f"list_filter([{here}], lambda x: x IS NOT NULL) ELSE [tokens[p]] END))")
    return _sql(S.docs_cte(), _toks_cte(cols="doc_id"),
                f"tsp AS (SELECT doc_id, tokens, {cols} FROM toks)",
                f"tdict AS (SELECT doc_id, {out} AS tokens FROM tsp)",
                S.dfm_cte("tdict"), body=S.freq_select())


_freq_multi = TextOptions(dictionary=tuple((k, tuple(v)) for k, v in DICT_MULTI), dictionary_type="fixed")


@register("dictionary_multiword", _multi_sql())
def q_dictionary_multiword(spark, sf):
    return A.frequent_terms(load_dfm(spark, sf, _freq_multi))


# Dictionary lines derived from whole conversation turns: "<role>_<turn> = w1, w2, …" with the
# turn's words as values (repeated keys across conversations: the last line wins); turns from the
# seventh on give lines without "=" (dropped by the parser).
DICT_LINES_SQL = (
    "lines AS (SELECT conv_id * 1000 + turn AS line_no, CASE WHEN turn >= 6 THEN "
    "regexp_replace(text, '[=\\n]', ' ', 'g') ELSE "
    "role || '_' || CAST(turn AS VARCHAR) || ' = ' || "
    "regexp_replace(regexp_replace(text, '[=\\n]', ' ', 'g'), ' ', ', ', 'g') END AS line "
    "FROM conversations)")


def _dict_lines(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    clean = F.regexp_replace("text", "[=\n]", " ")
    line = F.when(F.col("turn") >= 6, clean).otherwise(
        F.concat(F.col("role"), F.lit("_"), F.col("turn").cast("string"), F.lit(" = "),
                 F.regexp_replace(clean, " ", ", ")))
    return conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), line.alias("line"))


TRIM = "regexp_replace({x}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"
DICT_PARSED_SQL = (
    "dl AS (SELECT line_no, " + TRIM.format(x="line") + " AS ln FROM lines), "
    "dp AS (SELECT line_no, " + TRIM.format(x="substr(ln, 1, strpos(ln, '=') - 1)") + " AS key, "
    "substr(ln, strpos(ln, '=') + 1) AS rest FROM dl WHERE strpos(ln, '=') > 0), "
    "dv AS (SELECT line_no, key, list_filter(list_transform(string_split(rest, ','), lambda v: "
    + TRIM.format(x="v") + "), lambda v: v <> '') AS vals FROM dp WHERE length(" + TRIM.format(x="rest")
    + ") > 0 AND key <> ''), "
    "dict AS (SELECT min(line_no) AS line_no, key, arg_max(vals, line_no) AS vals FROM dv GROUP BY key)")


@register("dictionary_parse", _sql(DICT_LINES_SQL, DICT_PARSED_SQL, body=(
    "SELECT line_no, key, array_to_string(vals, '|') AS values_text, CAST(len(vals) AS BIGINT) AS n_values "
    "FROM dict")))
def q_dictionary_parse(spark, sf):
    d = dictionary_from_lines(_dict_lines(spark, sf))
    return d.select("line_no", "key", F.array_join("values", "|").alias("values_text"),
                    F.size("values").cast("bigint").alias("n_values"))


@register("dictionary_text", _sql(DICT_LINES_SQL, DICT_PARSED_SQL, body=(
    "SELECT line_no, key || ' = ' || array_to_string(vals, ', ') AS line FROM dict")))
def q_dictionary_text(spark, sf):
    return dictionary_to_lines(dictionary_from_lines(_dict_lines(spark, sf)))


@register("remove_words_text", _sql(
    S.docs_cte(), "rw AS (SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, "
    + sql_string(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+")
    + "), lambda r: lower(r) NOT IN ('and', 'of', 'the')), '') AS text FROM docs)",
    body="SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars_left FROM rw"))
def q_remove_words_text(spark, sf):
    c = corpus_remove_words(load_corpus(spark, sf), ["the", "of", "and"])
    return c.select("doc_id", F.length("text").cast("bigint").alias("n_chars_left"))


DEFAULT_LIB = TextOptions(lowercase=True, remove_numbers=False, remove_punct=False, remove_symbols=False,
                          remove_hyphens=False, remove_url=False, remove_twitter=False)


@register("dfm_default_text", _sql(S.docs_cte(), _toks_cte(DEFAULT_LIB), S.dfm_cte(), body=S.freq_select()))
def q_dfm_default_text(spark, sf):
    return A.frequent_terms(M.dfm_from_text(load_corpus(spark, sf)))


@register("corpus_head", _sql(S.docs_cte(), body=f"SELECT {DOC_COLS}, text FROM docs ORDER BY doc_id LIMIT 10"))
def q_corpus_head(spark, sf):
    return corpus_head(load_corpus(spark, sf)).select(*DOC_COLS.split(", "), "text")


# ---------------------------------------------------------------- 4. dfm

DFM_DV = [S.docs_cte(), _toks_cte(), S.dfm_cte(extra="lang, source")]


@register("dfm_trim", _sql(*DEFAULT_SQL, body=(
    "SELECT doc_id, term, n FROM dfm WHERE term IN (SELECT term FROM dfm GROUP BY term HAVING sum(n) >= 5)")))
def q_dfm_trim(spark, sf):
    return M.trim_features(load_dfm(spark, sf, materialize=True), 5).long


@register("dfm_group", _sql(*DFM_DV, body=(
    "SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM dfm WHERE lang IS NOT NULL GROUP BY lang, term")))
def q_dfm_group(spark, sf):
    return M.group_documents(load_dfm(spark, sf), "lang").long


WEIGHT_SQL = {
    "relfreq": "n / sum(n) OVER (PARTITION BY doc_id)",
    "relmaxfreq": "n / max(n) OVER (PARTITION BY doc_id)",
    "logfreq": "1 + log10(n)",
    "tfidf": "n * log10((SELECT CAST(count(*) AS DOUBLE) FROM docs) / count(*) OVER (PARTITION BY term))",
}


def _weight_query(scheme: str):
    @register(f"weight_{scheme}", _sql(*DEFAULT_SQL, body=(
        f"SELECT doc_id, term, round({WEIGHT_SQL[scheme]}, 8) AS w FROM dfm")))
    def q(spark, sf):
        d = M.weight(load_dfm(spark, sf, materialize=scheme == "tfidf"), scheme)
        return d.long.select(d.id_col, "term", F.round("n", 8).alias("w"))
    return q


for _s in ("relfreq", "relmaxfreq", "logfreq", "tfidf"):
    _weight_query(_s)


@register("weight_tfidf_long", _sql(*DEFAULT_SQL, body=(
    "SELECT doc_id, term, round(n * log10((SELECT CAST(count(*) AS DOUBLE) FROM docs) / "
    "count(*) OVER (PARTITION BY term)), 8) AS w FROM dfm WHERE term IN "
    "(SELECT term FROM dfm GROUP BY term HAVING sum(n) >= 3)")))
def q_weight_tfidf_long(spark, sf):
    d = M.weight(M.trim_features(load_dfm(spark, sf, materialize=True), 3).materialize(), "tfidf")
    return d.long.select("doc_id", "term", F.round("n", 8).alias("w"))


@register("ndoc", _sql(S.docs_cte(), body="SELECT count(*) AS ndoc FROM docs"))
def q_ndoc(spark, sf):
    return load_dfm(spark, sf).ndoc()


@register("presence_select", _sql(*DEFAULT_SQL, body=(
    "SELECT d.doc_id, coalesce(max(CASE WHEN term = 'the' THEN 1 END), 0) AS the, "
    "coalesce(max(CASE WHEN term = 'of' THEN 1 END), 0) AS \"of\" "
    "FROM docs d LEFT JOIN dfm ON d.doc_id = dfm.doc_id AND term IN ('the', 'of') GROUP BY d.doc_id")))
def q_presence_select(spark, sf):
    d = M.presence(M.dfm_select(load_dfm(spark, sf), ["the", "of"]))
    w = M.to_wide(d, ["the", "of"])
    return w.select("doc_id", F.col("the").cast("int").alias("the"), F.col("of").cast("int").alias("of"))


# -------------------------------------------------------------- 5. stats

def _top_sql(val: str, n: int = 20) -> str:
    return _sql(*DEFAULT_SQL, body=(
        f"SELECT CAST(row_number() OVER (ORDER BY value DESC, term) AS BIGINT) AS rank, term, value FROM "
        f"(SELECT term, CAST({val} AS BIGINT) AS value FROM dfm GROUP BY term ORDER BY value DESC, term "
        f"LIMIT {n})"))


@register("top_features", _top_sql("sum(n)"))
def q_top_features(spark, sf):
    t = A.top_features(load_dfm(spark, sf), 20)
    return t.withColumn("rank", F.col("rank").cast("bigint"))


@register("top_features_docfreq", _top_sql("count(*)"))
def q_top_features_docfreq(spark, sf):
    t = A.top_features(load_dfm(spark, sf), 20, scheme="docfreq")
    return t.withColumn("rank", F.col("rank").cast("bigint"))


@register("top_features_by_group", _sql(*DFM_DV, body=(
    "SELECT lang AS \"group\", rank, term, value FROM (SELECT lang, term, value, CAST(row_number() OVER "
    "(PARTITION BY lang ORDER BY value DESC, term) AS BIGINT) AS rank FROM (SELECT lang, term, "
    "CAST(sum(n) AS BIGINT) AS value FROM dfm GROUP BY lang, term)) WHERE rank <= 20")))
def q_top_features_by_group(spark, sf):
    t = A.top_features(load_dfm(spark, sf), 20, groups="lang")
    return t.withColumn("rank", F.col("rank").cast("bigint"))


@register("wordcloud_terms", _sql(*DEFAULT_SQL, body=(
    "SELECT term, freq, round(freq / max(freq) OVER (), 4) AS rel_size, "
    "CAST(row_number() OVER (ORDER BY freq DESC, term) AS BIGINT) AS rank FROM "
    "(SELECT term, CAST(sum(n) AS BIGINT) AS freq FROM dfm GROUP BY term ORDER BY freq DESC, term LIMIT 30)")))
def q_wordcloud_terms(spark, sf):
    t = A.wordcloud_terms(load_dfm(spark, sf), 30)
    return t.withColumn("rank", F.col("rank").cast("bigint"))


@register("comparison_terms", _sql(*DFM_DV, body=(
    "SELECT term, best.g AS \"group\", round(best.d, 6) AS deviation FROM ("
    "SELECT term, max({'d': rate - avg_rate, 'g': lang}) AS best FROM ("
    "SELECT r.lang, r.term, r.rate, a.avg_rate FROM ("
    "SELECT gt.lang, gt.term, gt.n / t.tot AS rate FROM (SELECT lang, term, sum(n) AS n FROM dfm "
    "WHERE lang IS NOT NULL GROUP BY lang, term) gt JOIN (SELECT lang, sum(n) AS tot FROM dfm "
    "WHERE lang IS NOT NULL GROUP BY lang) t ON gt.lang = t.lang) r JOIN ("
    "SELECT term, sum(rate) / (SELECT count(DISTINCT lang) FROM docs WHERE lang IS NOT NULL) AS avg_rate "
    "FROM (SELECT gt.term, gt.n / t.tot AS rate FROM (SELECT lang, term, sum(n) AS n FROM dfm "
    "WHERE lang IS NOT NULL GROUP BY lang, term) gt JOIN (SELECT lang, sum(n) AS tot FROM dfm "
    "WHERE lang IS NOT NULL GROUP BY lang) t ON gt.lang = t.lang) GROUP BY term) a ON r.term = a.term) "
    "GROUP BY term) ORDER BY deviation DESC, term LIMIT 30")))
def q_comparison_terms(spark, sf):
    return A.comparison_terms(load_dfm(spark, sf), "lang", 30)


@register("distinct_values", _sql(S.docs_cte(), body="SELECT DISTINCT source FROM docs"))
def q_distinct_values(spark, sf):
    return A.distinct_values(load_corpus(spark, sf), "source")


# ------------------------------------------------------------- 6. search

def _hits(spark, sf, query, labels=False, binary=False):
    hits = Q.search(load_dfm(spark, sf), query, binary=binary)
    if labels:
        # side docvars join the narrow per-document result, not the texts
        hits = hits.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    return hits


SEARCH_SQL = DEFAULT_SQL


@register("search_total", _sql(*SEARCH_SQL, S.hits_cte(Q_MAIN), body=(
    "SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS nb_docs, "
    "round(count(*) FILTER (WHERE n > 0) / count(*) * 100, 1) AS prop_docs FROM hits")))
def q_search_total(spark, sf):
    return Q.search_total(_hits(spark, sf, Q_MAIN))


@register("search_and_or_not", _sql(*SEARCH_SQL, S.hits_cte(Q_OR_NOT), body="SELECT doc_id, n FROM hits"))
def q_search_and_or_not(spark, sf):
    return _hits(spark, sf, Q_OR_NOT).select("doc_id", "n")


@register("search_not", _sql(*SEARCH_SQL, S.hits_cte(Q_NOT), body="SELECT doc_id, n FROM hits"))
def q_search_not(spark, sf):
    return _hits(spark, sf, Q_NOT).select("doc_id", "n")


@register("search_count_compare", _sql(*SEARCH_SQL, S.hits_cte(Q_COMPARE), body="SELECT doc_id, n FROM hits"))
def q_search_count_compare(spark, sf):
    return _hits(spark, sf, Q_COMPARE).select("doc_id", "n")


@register("search_arithmetic", _sql(*SEARCH_SQL, S.hits_cte("the * 2 - of + -that"),
                                    body="SELECT doc_id, n FROM hits"))
def q_search_arithmetic(spark, sf):
    return _hits(spark, sf, "the * 2 - of + -that").select("doc_id", "n")


def _by_group_sql(by: str, binary: bool = False, labels: bool = False, query: str = Q_MAIN) -> str:
    cols = "doc_id, lang, source, n_chars, doc_date" + (", quality, toxic" if labels else "")
    freq = "" if binary else "CAST(sum(n) AS BIGINT) AS freq, "
    ctes = [S.docs_cte(labels=labels), _toks_cte(), S.dfm_cte()]
    return _sql(*ctes, S.hits_cte(query, cols, binary=binary), body=(
        f"SELECT {by} AS \"group\", {freq}CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS nb_docs, "
        f"round(count(*) FILTER (WHERE n > 0) / count(*) * 100, 1) AS prop_docs FROM hits GROUP BY {by}"))


@register("search_by_group", _by_group_sql("lang"))
def q_search_by_group(spark, sf):
    return Q.search_by_group(_hits(spark, sf, Q_MAIN), "lang")


@register("search_by_group_binary", _by_group_sql("source", binary=True, query="the | that"))
def q_search_by_group_binary(spark, sf):
    return Q.search_by_group(_hits(spark, sf, "the | that", binary=True), "source", binary=True)


@register("search_by_numeric", _by_group_sql("quality", labels=True))
def q_search_by_numeric(spark, sf):
    return Q.search_by_group(_hits(spark, sf, Q_MAIN, labels=True), "quality")


def _series_sql(by: str, kind: str) -> str:
    base = _by_group_sql(by)
    head, body = base.split(" SELECT " + by + " AS \"group\"", 1)
    order = ("ORDER BY prop_docs, \"group\" NULLS FIRST" if kind == "categorical"
             else "ORDER BY \"group\" NULLS LAST")
    where = " WHERE prop_docs > 0" if kind == "categorical" else ""
    tab = head + ", tab AS (SELECT " + by + " AS \"group\"" + body + ") SELECT *"
    if kind != "categorical":
        return tab + " FROM tab " + order
    return tab + ", CAST(row_number() OVER (" + order + ") AS BIGINT) AS \"order\" FROM tab" + where


@register("search_series_lang", _series_sql("lang", "categorical"))
def q_search_series_lang(spark, sf):
    s = Q.search_series(Q.search_by_group(_hits(spark, sf, Q_MAIN), "lang"), "categorical", "prop_docs")
    return s.withColumn("order", F.col("order").cast("bigint"))


@register("search_series_numeric", _series_sql("n_chars", "numeric"))
def q_search_series_numeric(spark, sf):
    return Q.search_series(Q.search_by_group(_hits(spark, sf, Q_MAIN), "n_chars"), "numeric")


@register("matched_documents_total", "WITH " + _by_group_sql("lang")[len("WITH "):].replace(
    " SELECT lang AS \"group\"", ", tab AS (SELECT lang AS \"group\"", 1)
    + ") SELECT CAST(coalesce(sum(nb_docs), 0) AS BIGINT) AS n FROM tab")
def q_matched_documents_total(spark, sf):
    return Q.matched_documents_total(Q.search_by_group(_hits(spark, sf, Q_MAIN), "lang"))


@register("search_documents_page", _sql(*SEARCH_SQL, S.hits_cte(Q_PAGE), body=(
    "SELECT doc_id, lang, n FROM hits WHERE n > 0 ORDER BY doc_id LIMIT 10 OFFSET 10")))
def q_search_documents_page(spark, sf):
    return Q.search_documents(_hits(spark, sf, Q_PAGE), 11, 10).select("doc_id", "lang", "n")


@register("page_bounds", _sql(*SEARCH_SQL, S.hits_cte(Q_PAGE), body=(
    "SELECT CAST(11 AS BIGINT) AS start, CAST(least(20, nb) AS BIGINT) AS \"end\", nb AS total, "
    "'11 to ' || CAST(least(20, nb) AS VARCHAR) || ' of ' || CAST(nb AS VARCHAR) AS label, "
    "CAST(CASE WHEN 21 <= nb THEN 21 END AS BIGINT) AS next_start, CAST(1 AS BIGINT) AS prev_start "
    "FROM (SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS nb FROM hits)")))
def q_page_bounds(spark, sf):
    pb = Q.page_bounds(Q.search_total(_hits(spark, sf, Q_PAGE)), 11, 10)
    return pb.select(*[F.col(c).cast("bigint").alias(c) if c != "label" else F.col(c)
                       for c in pb.columns])


@register("missing_terms", _sql(*DEFAULT_SQL, body=(
    "SELECT term FROM (VALUES " + ", ".join(f"({sql_string(t)})" for t in MISSING) + ") v(term) "
    "WHERE term NOT IN (SELECT term FROM dfm)")))
def q_missing_terms(spark, sf):
    return Q.missing_terms(load_dfm(spark, sf), MISSING)


@register("search_highlight", _sql(*[S.docs_cte(), _toks_cte(), S.dfm_cte()], S.hits_cte("de | la"), body=(
    "SELECT h.doc_id, regexp_replace(d.text, '(?i)(de|la)', '<span class=''highlight''>\\1</span>', 'g') "
    "AS text FROM hits h JOIN docs d ON h.doc_id = d.doc_id WHERE h.n > 0")))
def q_search_highlight(spark, sf):
    # the text rides along in the document row: no join back to the corpus
    toks = clean_tokens(load_corpus(spark, sf), keep_text=True)
    hits = Q.search(M.dfm(toks), "de | la").filter(F.col("n") > 0)
    return hits.select("doc_id", Q.highlight_expr("text", ["de", "la"]).alias("text"))


RAW_SQL = [S.docs_cte(lowercase_text=True), _toks_cte(), S.dfm_cte()]


@register("search_raw_text", _sql(*RAW_SQL, S.hits_cte(Q_KWIC), body=(
    "SELECT h.doc_id, h.n, r.text AS raw_text FROM hits h JOIN documents r ON h.doc_id = r.doc_id "
    "WHERE h.n > 0")))
def q_search_raw_text(spark, sf):
    clean = load_corpus(spark, sf, lowercase_text=True)
    hits = Q.search(M.dfm(clean_tokens(clean)), Q_KWIC).filter(F.col("n") > 0)
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    return with_raw(hits, raw).select("doc_id", "n", "raw_text")


def _kwic_sql(tok_src: str, terms=None, phrase=None, window: int = 7) -> str:
    """Rows of a kwic over a CTE ``tok_src(doc_id, tokens)``."""
    if phrase:
        k = len(phrase)
        cond = " AND ".join(f"lower(tokens[i + {j}]) = {sql_string(w.lower())}" for j, w in enumerate(phrase))
        last = f"len(tokens) - {k - 1}"
    else:
        k = 1
        cond = "lower(tokens[i]) IN (" + ", ".join(sql_string(t.lower()) for t in terms) + ")"
        last = "len(tokens)"
    return (f"SELECT doc_id, CAST(i AS BIGINT) AS \"from\", CAST(i + {k - 1} AS BIGINT) AS \"to\", "
            f"array_to_string(tokens[greatest(1, i - {window}):i - 1], ' ') AS pre, "
            f"array_to_string(tokens[i:i + {k - 1}], ' ') AS keyword, "
            f"array_to_string(tokens[i + {k}:i + {k - 1 + window}], ' ') AS post, "
            f"CAST(len(tokens) AS BIGINT) AS ntokens FROM (SELECT doc_id, tokens, unnest(list_filter("
            f"range(1, {last} + 1), lambda i: {cond})) AS i FROM {tok_src})")


@register("search_kwic", _sql(*SEARCH_SQL, S.hits_cte(Q_KWIC),
                              "mt AS (SELECT doc_id, tokens FROM toks WHERE doc_id IN "
                              "(SELECT doc_id FROM hits WHERE n > 0))",
                              "kw AS (" + _kwic_sql("mt", phrase=["der"]) + " UNION ALL "
                              + _kwic_sql("mt", phrase=["die"]) + ")",
                              body=(
    "SELECT doc_id, string_agg('...' || pre || ' <strong>' || keyword || '</strong> ' || post || '...', "
    "'<br />' ORDER BY \"from\", '...' || pre || ' <strong>' || keyword || '</strong> ' || post || '...') "
    "AS kwic FROM kw GROUP BY doc_id")))
def q_search_kwic(spark, sf):
    return Q.search_kwic(clean_tokens(load_corpus(spark, sf)), Q_KWIC)


@register("doc_metadata", _sql(*SEARCH_SQL, S.hits_cte(Q_META), body=(
    "SELECT doc_id, 'lang' AS name, coalesce(lang, 'NA') AS value FROM hits WHERE n > 0 UNION ALL "
    "SELECT doc_id, 'source', coalesce(source, 'NA') FROM hits WHERE n > 0 UNION ALL "
    "SELECT doc_id, 'n_chars', coalesce(CAST(n_chars AS VARCHAR), 'NA') FROM hits WHERE n > 0 UNION ALL "
    "SELECT doc_id, 'doc_date', coalesce(CAST(doc_date AS VARCHAR), 'NA') FROM hits WHERE n > 0")))
def q_doc_metadata(spark, sf):
    hits = _hits(spark, sf, Q_META).filter(F.col("n") > 0)
    return Q.doc_metadata(hits, DOCVARS)


@register("group_table", _by_group_sql("source"))
def q_group_table(spark, sf):
    return Q.group_table(Q.search_by_group(_hits(spark, sf, Q_MAIN), "source"))


# --------------------------------------------------------------- 7. kwic

RAW_TOK = f"rt AS (SELECT doc_id, {S.tokens_sql('text', RAW)} AS tokens FROM documents)"
KW_COLS = "doc_id, \"from\", \"to\", pre, keyword, post"


def _raw_tokens(spark, sf):
    return tokenize(load_corpus(spark, sf), RAW)


@register("kwic_word", _sql(RAW_TOK, body=f"SELECT {KW_COLS} FROM (" + _kwic_sql("rt", ["that"]) + ")"))
def q_kwic_word(spark, sf):
    return K.kwic(_raw_tokens(spark, sf), ["that"])


@register("kwic_phrase", _sql(RAW_TOK, body=f"SELECT {KW_COLS} FROM (" + _kwic_sql("rt", phrase=["of", "the"]) + ")"))
def q_kwic_phrase(spark, sf):
    return K.kwic(_raw_tokens(spark, sf), phrase="of the")


@register("kwic_clean_tokens", _sql(S.docs_cte(), _toks_cte(),
                                    body=f"SELECT {KW_COLS} FROM (" + _kwic_sql("toks", ["que", "und"]) + ")"))
def q_kwic_clean_tokens(spark, sf):
    return K.kwic(clean_tokens(load_corpus(spark, sf)), ["que", "und"])


@register("kwic_table", _sql(RAW_TOK, body=(
    "SELECT doc_id, \"from\", \"to\", pre || ' <strong>' || keyword || '</strong> ' || post AS text FROM ("
    + _kwic_sql("rt", ["der"]) + ")")))
def q_kwic_table(spark, sf):
    return K.kwic_table(K.kwic(_raw_tokens(spark, sf), ["der"]))


@register("term_positions", _sql(RAW_TOK, "kw AS (" + _kwic_sql("rt", ["that"], window=0) + ")", body=(
    "SELECT doc_id, \"from\", ntokens, round(\"from\" / ntokens, 4) AS rel_pos FROM kw WHERE doc_id IN "
    "(SELECT DISTINCT doc_id FROM kw ORDER BY doc_id LIMIT 80)")))
def q_term_positions(spark, sf):
    return K.term_positions(_raw_tokens(spark, sf), ["that"], max_docs=K.POSITIONS_MAX_DOCS)


@register("kwic_summary", _sql(RAW_TOK, "kw AS (" + _kwic_sql("rt", ["that"]) + ")", body=(
    "SELECT count(DISTINCT doc_id) AS nb_docs, count(*) AS nb_hits, count(DISTINCT doc_id) > 80 AS truncated "
    "FROM kw")))
def q_kwic_summary(spark, sf):
    return K.kwic_summary(K.kwic(_raw_tokens(spark, sf), ["that"]))


# --------------------------------------------------------- 8. similarity

def _sim_sql(term: str, method: str, cols: str, grouped: str | None = None) -> str:
    ctes = [S.docs_cte(), _toks_cte().replace("toks AS (", "toks AS MATERIALIZED (", 1)]
    if grouped:
        ctes.append(S.dfm_cte(extra=grouped).replace("dfm AS", "dfm0 AS"))
        ctes.append(f"dfm AS (SELECT {grouped} AS doc_id, term, sum(n) AS n FROM dfm0 "
                    f"WHERE {grouped} IS NOT NULL GROUP BY {grouped}, term)")
        nd = f"(SELECT CAST(count(DISTINCT {grouped}) AS DOUBLE) AS N FROM docs WHERE {grouped} IS NOT NULL)"
    else:
        ctes.append(S.dfm_cte())
        nd = "(SELECT CAST(count(*) AS DOUBLE) AS N FROM docs)"
    ctes += [
        f"y AS (SELECT doc_id, n AS y FROM dfm WHERE term = {sql_string(term)})",
        "st AS (SELECT term, sum(CAST(n AS DOUBLE)) AS sx, sum(CAST(n AS DOUBLE) * CAST(n AS DOUBLE)) AS sxx, "
        "count(*) AS dfx, sum(coalesce(CAST(n AS DOUBLE) * CAST(y AS DOUBLE), 0.0)) AS sxy, count(y) AS common "
        "FROM dfm LEFT JOIN y ON dfm.doc_id = y.doc_id GROUP BY term)",
        f"ys AS (SELECT sx AS sy, sxx AS syy, dfx AS dfy FROM st WHERE term = {sql_string(term)})",
        f"nd AS {nd}",
    ]
    sims = {
        "correlation": "CASE WHEN (N * sxx - sx * sx) > 0 AND (N * syy - sy * sy) > 0 THEN "
                       "(N * sxy - sx * sy) / sqrt((N * sxx - sx * sx) * (N * syy - sy * sy)) END",
        "cosine": "sxy / sqrt(sxx * syy)",
        "jaccard": "CAST(common AS DOUBLE) / (CAST(dfx AS DOUBLE) + CAST(dfy AS DOUBLE) - CAST(common AS DOUBLE))",
    }
    ctes = [c.replace("dfm AS (", "dfm AS MATERIALIZED (", 1).replace("st AS (", "st AS MATERIALIZED (", 1)
            if c.startswith(("dfm AS (", "st AS (")) else c for c in ctes]
    full = {
        "similarity": f"round({sims[method]}, 4) AS similarity",
        "simple_matching": "round((common + (N - dfx - dfy + common)) / N, 4) AS simple_matching",
        "nb_docs_common": "CAST(common AS BIGINT) AS nb_docs_common",
    }
    sel = ", ".join(["term"] + [full[c] for c in cols.split(", ")])
    return _sql(*ctes, body=f"SELECT {sel} FROM (SELECT st.*, (SELECT sy FROM ys) AS sy, "
                "(SELECT syy FROM ys) AS syy, (SELECT dfy FROM ys) AS dfy, (SELECT N FROM nd) AS N FROM st) "
                "WHERE sy IS NOT NULL")


SIM_ALL = "similarity, simple_matching, nb_docs_common"


def _sim_query(name: str, term: str, method: str, cols: str = SIM_ALL, grouped: str | None = None):
    @register(name, _sim_sql(term, method, cols, grouped))
    def q(spark, sf):
        d = load_dfm(spark, sf)
        if grouped:
            d = M.group_documents(d, grouped)
        return H.term_similarity(d, term, method).select("term", *cols.split(", "))
    return q


_sim_query("sim_correlation", "that", "correlation")
_sim_query("sim_cosine", "that", "cosine")
_sim_query("sim_jaccard", "that", "jaccard")
_sim_query("sim_matching_and_common", "that", "jaccard", "simple_matching, nb_docs_common")
_sim_query("sim_on_grouped", "the", "correlation", grouped="source")


@register("cooccurring_docs", _sim_sql("der", "jaccard", "nb_docs_common"))
def q_cooccurring_docs(spark, sf):
    return H.cooccurring_docs(load_dfm(spark, sf), "der")


# ---------------------------------------------------- 9. parsed tokens

@register("pos_counts", _sql(PARSED_CTE, body=(
    "SELECT pos, count(*) AS n, pos || ' (n=' || CAST(count(*) AS VARCHAR) || ')' AS label FROM parsed "
    "GROUP BY pos")))
def q_pos_counts(spark, sf):
    return P.pos_counts(load_parsed(spark, sf))


@register("token_context", _sql(PARSED_CTE, body=(
    "SELECT doc_id, token_pos, token, concat_ws(' ', "
    "coalesce(lag(token, 2) OVER w, ''), coalesce(lag(token, 1) OVER w, ''), token, "
    "coalesce(lead(token, 1) OVER w, ''), coalesce(lead(token, 2) OVER w, '')) AS context FROM parsed "
    "WINDOW w AS (PARTITION BY doc_id ORDER BY token_pos)")))
def q_token_context(spark, sf):
    return P.token_context(load_parsed(spark, sf)).select("doc_id", "token_pos", "token", "context")


DROP = ["PUNCT", "ADP"]


@register("drop_pos", _sql(PARSED_CTE, body=(
    "SELECT doc_id, token_pos, token, pos FROM parsed WHERE pos IS NULL OR pos NOT IN ('PUNCT', 'ADP')")))
def q_drop_pos(spark, sf):
    return P.drop_pos(load_parsed(spark, sf), DROP).select("doc_id", "token_pos", "token", "pos")


REBUILT_SQL = (
    "rb AS (SELECT doc_id, string_agg({col}, ' ' ORDER BY token_pos) AS text FROM parsed "
    "WHERE pos IS NULL OR pos NOT IN ('PUNCT') GROUP BY doc_id), "
    "rebuilt AS (SELECT ids.doc_id, coalesce(rb.text, '') AS text FROM (SELECT DISTINCT doc_id FROM parsed) ids "
    "LEFT JOIN rb ON ids.doc_id = rb.doc_id)")


@register("rebuild_texts", _sql(PARSED_CTE, REBUILT_SQL.format(col="token"),
                                body="SELECT doc_id, text FROM rebuilt"))
def q_rebuild_texts(spark, sf):
    return P.rebuild_texts(load_parsed(spark, sf), P.keep_pos(["PUNCT"]))


@register("replace_texts", _sql(PARSED_CTE, REBUILT_SQL.format(col="lemma"), body=(
    "SELECT c.doc_id, c.n_turns, coalesce(r.text, '') AS text FROM (SELECT conv_id AS doc_id, count(*) AS "
    "n_turns FROM conversations GROUP BY conv_id) c LEFT JOIN rebuilt r ON c.doc_id = r.doc_id")))
def q_replace_texts(spark, sf):
    rebuilt = P.rebuild_texts(load_parsed(spark, sf), P.keep_pos(["PUNCT"]), column="lemma")
    conv = (spark.read.parquet(f"{sf}/conversations.parquet").groupBy(F.col("conv_id").alias("doc_id"))
            .agg(F.count(F.lit(1)).alias("n_turns"), F.first("text").alias("text")))
    return replace_texts(conv, rebuilt).select("doc_id", "n_turns", "text")


@register("frequent_lemmas", _sql(PARSED_CTE, body=(
    "SELECT term, CAST(sum(c) AS BIGINT) AS nb_terms, count(*) AS nb_docs, "
    "round(count(*) / (SELECT count(DISTINCT doc_id) FROM parsed) * 100, 2) AS prop_docs FROM "
    "(SELECT doc_id, lower(lemma) AS term, count(*) AS c FROM parsed WHERE pos IS NULL OR "
    "pos NOT IN ('PUNCT') GROUP BY doc_id, lower(lemma)) GROUP BY term ORDER BY nb_terms DESC, term "
    "LIMIT 10000")))
def q_frequent_lemmas(spark, sf):
    return P.frequent_lemmas(load_parsed(spark, sf), P.keep_pos(["PUNCT"]), limit=10000)


@register("frequent_lemmas_by_token", _sql(PARSED_CTE, body=(
    "SELECT lower(lemma) AS term, count(*) AS nb_terms, count(*) AS nb_docs, "
    "round(count(*) / (SELECT count(*) FROM parsed) * 100, 2) AS prop_docs FROM parsed "
    "WHERE pos IS NULL OR pos NOT IN ('PUNCT') GROUP BY lower(lemma) ORDER BY nb_terms DESC, term "
    "LIMIT 10000")))
def q_frequent_lemmas_by_token(spark, sf):
    return P.frequent_lemmas(load_parsed(spark, sf), P.keep_pos(["PUNCT"]), unit="token", limit=10000)


# ------------------------------------------------- 10. stem, table view

def _stem_query(name: str, language: str):
    part = (f"coalesce(nullif(regexp_extract(p, {sql_string(suffix_pattern(SUFFIXES[language]))}, 1), ''), p)")
    stem = f"array_to_string(list_transform(string_split(term, '_'), lambda p: {part}), '_')"

    @register(name, _sql(*[c if not c.startswith("dfm AS") else c.replace("dfm AS", "dfm0 AS", 1) for c in DEFAULT_SQL],
                         f"dfm AS (SELECT doc_id, {stem} AS term, sum(n) AS n FROM dfm0 GROUP BY ALL)",
                         body=S.freq_select()))
    def q(spark, sf):
        return A.frequent_terms(stem_features(load_dfm(spark, sf), language))
    return q


_stem_query("stem_features_en", "english")
_stem_query("stem_features_de", "german")
_stem_query("stem_features_es", "spanish")
_stem_query("stem_features_fr", "french")


# ------------------------------------- 11. weighted and grouped work-flows

# Hand-written SQL: counts, then idf over all documents, then the value. The
# term of every document ("everywhere" below) weighs 0 and counts as absent.

def _marked_docs(spark, sf):
    """The corpus with the word ``everywhere`` put before each text, so that
    one term is in every document."""
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_date", _doc_date())
    return corpus(d.withColumn("text", F.concat(F.lit("everywhere "), F.coalesce("text", F.lit("")))), docvars=DOCVARS)


_MARKED_SQL = [S.docs_cte().replace("docs AS", "docs0 AS", 1),
               "docs AS (SELECT * REPLACE ('everywhere ' || coalesce(text, '') AS text) FROM docs0)", _toks_cte(), S.dfm_cte(),
               "nd AS (SELECT CAST(count(*) AS DOUBLE) AS N FROM docs)",
               "idf AS (SELECT term, log10((SELECT N FROM nd) / count(*)) AS idf FROM dfm GROUP BY term)",
               "tfidf AS (SELECT doc_id, term, n * idf AS n FROM dfm JOIN idf USING (term))"]


def _marked_tfidf(spark, sf):
    return M.weight(M.dfm(clean_tokens(_marked_docs(spark, sf))).materialize(), "tfidf")


@register("search_binary_on_tfidf", _sql(*_MARKED_SQL, body=(
    "SELECT doc_id, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS n FROM (SELECT d.doc_id, t.n FROM docs d "
    "LEFT JOIN (SELECT * FROM tfidf WHERE term IN ('everywhere', 'the')) t USING (doc_id)) GROUP BY doc_id")))
def q_search_binary_on_tfidf(spark, sf):
    hits = Q.search(_marked_tfidf(spark, sf), "everywhere + the", binary=True)
    return hits.select("doc_id", F.col("n").cast("bigint").alias("n"))


@register("top_docfreq_on_tfidf", _sql(*_MARKED_SQL, body=(
    "SELECT CAST(row_number() OVER (ORDER BY value DESC, term) AS BIGINT) AS rank, term, value FROM (SELECT term, "
    "CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS value FROM tfidf GROUP BY term) ORDER BY value DESC, term LIMIT 20")))
def q_top_docfreq_on_tfidf(spark, sf):
    top = A.top_features(_marked_tfidf(spark, sf), 20, "docfreq")
    return top.select(F.col("rank").cast("bigint").alias("rank"), "term", "value")


@register("sim_jaccard_on_tfidf", _sql(*_MARKED_SQL, (
    "y AS (SELECT doc_id FROM tfidf WHERE term = 'that' AND n > 0)"), body=(
    "SELECT term, CAST(count(*) FILTER (WHERE n > 0 AND y.doc_id IS NOT NULL) AS BIGINT) AS nb_docs_common, "
    "round(CASE WHEN count(*) FILTER (WHERE n > 0) + (SELECT count(*) FROM y) = 0 THEN NULL ELSE "
    "CAST(count(*) FILTER (WHERE n > 0 AND y.doc_id IS NOT NULL) AS DOUBLE) / (count(*) FILTER (WHERE n > 0) + "
    "(SELECT count(*) FROM y) - count(*) FILTER (WHERE n > 0 AND y.doc_id IS NOT NULL)) END, 4) AS similarity "
    "FROM tfidf LEFT JOIN y USING (doc_id) GROUP BY term")))
def q_sim_jaccard_on_tfidf(spark, sf):
    return H.term_similarity(_marked_tfidf(spark, sf), "that", "jaccard").select("term", "nb_docs_common", "similarity")


@register("search_on_relfreq", _sql(*_MARKED_SQL, body=(
    "SELECT d.doc_id, round(coalesce(t.n, 0), 6) AS n FROM docs d LEFT JOIN (SELECT doc_id, "
    "sum(n) FILTER (WHERE term IN ('the', 'of')) / sum(n) AS n FROM dfm GROUP BY doc_id) t USING (doc_id)")))
def q_search_on_relfreq(spark, sf):
    d = M.weight(M.dfm(clean_tokens(_marked_docs(spark, sf))), "relfreq")
    return Q.search(d, "the + of").select("doc_id", F.round("n", 6).alias("n"))


_GROUPED_SQL = [S.docs_cte(), _toks_cte(), S.dfm_cte(extra="source").replace("dfm AS", "dfm0 AS", 1),
                "dfm AS (SELECT source, term, sum(n) AS n FROM dfm0 WHERE source IS NOT NULL GROUP BY ALL)",
                "trimmed AS (SELECT * FROM dfm WHERE term IN (SELECT term FROM dfm GROUP BY term HAVING sum(n) >= 5))"]


def _grouped(spark, sf):
    """trim, then group (the dfm explorer's order of the sums is the same)."""
    return M.group_documents(M.trim_features(load_dfm(spark, sf, materialize=True), 5), "source")


def _grouped_weight(name: str, scheme: str, total: str):
    @register(name, _sql(*_GROUPED_SQL, body=(
        f"SELECT source, term, round(CAST(n AS DOUBLE) / {total}(n) OVER (PARTITION BY source), 8) AS w FROM trimmed")))
    def q(spark, sf):
        d = M.weight(_grouped(spark, sf), scheme)
        return d.long.select("source", "term", F.round("n", 8).alias("w"))
    return q


_grouped_weight("weight_relfreq_on_grouped", "relfreq", "sum")
_grouped_weight("weight_relmaxfreq_on_grouped", "relmaxfreq", "max")


@register("top_features_on_grouped", _sql(*_GROUPED_SQL, body=(
    "SELECT CAST(row_number() OVER (ORDER BY value DESC, term) AS BIGINT) AS rank, term, value FROM (SELECT term, "
    "round(sum(w), 8) AS value FROM (SELECT source, term, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY source), 12) "
    "AS w FROM trimmed) GROUP BY term) ORDER BY value DESC, term LIMIT 20")))
def q_top_features_on_grouped(spark, sf):
    d = M.weight(_grouped(spark, sf), "relfreq")
    top = A.top_features(d, 20)
    return top.select(F.col("rank").cast("bigint").alias("rank"), "term", F.round("value", 8).alias("value"))


@register("page_bounds_empty", _sql(*SEARCH_SQL, S.hits_cte("zzzzqq"), body=(
    "SELECT CAST(CASE WHEN nb > 0 THEN 1 ELSE 0 END AS BIGINT) AS start, CAST(least(10, nb) AS BIGINT) AS \"end\", "
    "nb AS total, CASE WHEN nb > 0 THEN '1' ELSE '0' END || ' to ' || CAST(least(10, nb) AS VARCHAR) || ' of ' || "
    "CAST(nb AS VARCHAR) AS label, CAST(CASE WHEN 11 <= nb THEN 11 END AS BIGINT) AS next_start, "
    "CAST(1 AS BIGINT) AS prev_start FROM (SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS nb FROM hits)")))
def q_page_bounds_empty(spark, sf):
    pb = Q.page_bounds(Q.search_total(_hits(spark, sf, "zzzzqq")), 1, 10)
    return pb.select(*[F.col(c).cast("bigint").alias(c) if c != "label" else F.col(c) for c in pb.columns])


# The ratio of two terms, as R divides: x / 0 is infinite, 0 / 0 never a hit.
@register("search_ratio", _sql(*DEFAULT_SQL, body=(
    "SELECT doc_id, CASE WHEN o <> 0 THEN CAST(t AS DOUBLE) / o > 2 ELSE t > 0 END::BIGINT AS n FROM (SELECT d.doc_id, "
    "coalesce(sum(f.n) FILTER (WHERE f.term = 'the'), 0) AS t, coalesce(sum(f.n) FILTER (WHERE f.term = 'of'), 0) AS o "
    "FROM docs d LEFT JOIN (SELECT * FROM dfm WHERE term IN ('the', 'of')) f USING (doc_id) GROUP BY d.doc_id) "
    "WHERE t > 0 OR o > 0")))
def q_search_ratio(spark, sf):
    return _hits(spark, sf, "the / of > 2").where("n is not null").select("doc_id", "n")


@register("stopword_globs", _sql(*DEFAULT_SQL, body=S.freq_select(
    src="(SELECT * FROM dfm WHERE NOT (term = 'of' OR term LIKE 'th%' OR term LIKE '%ing' OR term LIKE 'd_r'))")))
def q_stopword_globs(spark, sf):
    return A.frequent_terms(load_dfm(spark, sf, TextOptions(stopwords=("of", "th*", "*ing", "d?r"))))


@register("kwic_glob", _sql(RAW_TOK, body=(
    f"SELECT {KW_COLS} FROM (" + _kwic_sql("rt", ["that"]).replace(
        "lower(tokens[i]) IN ('that')", "(lower(tokens[i]) LIKE 'thb%' OR lower(tokens[i]) = 'that')") + ")")))
def q_kwic_glob(spark, sf):
    return K.kwic(_raw_tokens(spark, sf), ["thb*", "that"])


@register("raw_of_filtered", _sql(S.docs_cte(), body=(
    "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM docs WHERE lang = 'fr' AND n_chars > 1000)")))
def q_raw_of_filtered(spark, sf):
    chosen = filter_documents(load_corpus(spark, sf), {"lang": ["fr"], "n_chars": (1001, 10 ** 9)})
    return raw_of(chosen, spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text")


@register("dfm_from_long_totals", _sql(*DEFAULT_SQL, body=(
    "SELECT term, CAST(sum(n) AS BIGINT) AS nb_terms, CAST(count(*) AS BIGINT) AS nb_docs FROM dfm GROUP BY term")))
def q_dfm_from_long_totals(spark, sf):
    made = load_dfm(spark, sf)
    return M.term_totals(M.dfm_from_long(made.docs, made.long))


EXPLORE = TextOptions(stopwords=("the", "of", "and", "de", "la"), ngrams=(1, 2), min_termfreq=3,
                      dictionary=tuple((k, tuple(v)) for k, v in DICT_FIXED), dictionary_type="fixed")


@register("explore_chain", _sql(
    "docs AS (SELECT * FROM (" + S.docs_cte()[len("docs AS ("):-1] + ") WHERE lang IN ('en', 'fr') "
    "AND n_chars BETWEEN 500 AND 20000 AND doc_date BETWEEN DATE '2024-02-01' AND DATE '2024-11-30')",
    *_chain_sql(EXPLORE)[1:], body=(
        "SELECT * FROM (" + S.freq_select() + ") WHERE nb_terms >= 3")))
def q_explore_chain(spark, sf):
    return A.frequent_terms(explore(load_corpus(spark, sf), EXPLORE, COMBINED).dfm)


@register("table_view", _sql(*DEFAULT_SQL, "ft AS (" + S.freq_select(limit=None) + ")", body=(
    "SELECT * FROM ft WHERE contains(lower(term), 'th') OR contains(CAST(nb_terms AS VARCHAR), 'th') "
    "ORDER BY nb_docs DESC, term, nb_terms, prop_docs LIMIT 20 OFFSET 20")))
def q_table_view(spark, sf):
    ft = A.frequent_terms(load_dfm(spark, sf), limit=None)
    return table_view(ft, "nb_docs", page=2, size=20, search="th")


from . import catalog_networks  # noqa: E402,F401  (registers its queries)
