"""Properties of SURVEY §5 over the sf0.001 documents."""
import pytest
from pyspark.sql import functions as F

from lexiflow.operators import dfm as M
from lexiflow.operators import search as Q
from lexiflow.operators import stats as A
from lexiflow.operators.tokens import clean_tokens
from lexiflow.options import TextOptions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")


def test_totals_match_token_counts(docs):
    toks = clean_tokens(docs)
    ntok = toks.agg(F.sum(F.size("tokens"))).collect()[0][0]
    ft = A.frequent_terms(M.dfm(toks), limit=None)
    agg = ft.agg(F.sum("nb_terms"), F.max(F.col("nb_docs") - F.least(F.lit(200), F.col("nb_terms")))).collect()[0]
    assert agg[0] == ntok and agg[1] <= 0


def test_ngram_count_formula(docs):
    base = clean_tokens(docs).select("doc_id", F.size("tokens").alias("s"))
    grams = clean_tokens(docs, TextOptions(ngrams=(1, 2, 3))).select("doc_id", F.size("tokens").alias("g"))
    bad = base.join(grams, "doc_id").filter(
        F.col("g") != F.col("s") + F.greatest(F.col("s") - 1, F.lit(0)) + F.greatest(F.col("s") - 2, F.lit(0)))
    assert bad.count() == 0


def test_input_order_does_not_change_results(docs):
    a = A.frequent_terms(M.dfm(clean_tokens(docs))).collect()
    b = A.frequent_terms(M.dfm(clean_tokens(docs.orderBy(F.desc("doc_id")).repartition(3)))).collect()
    assert a == b


def test_query_and_negation_partition(docs):
    d = M.dfm(clean_tokens(docs))
    q = Q.search(d, "the | de").select("doc_id", F.col("n").alias("a"))
    nq = Q.search(d, "!(the | de)").select("doc_id", F.col("n").alias("b"))
    j = q.join(nq, "doc_id")
    assert j.count() == 200
    assert j.filter((F.col("a") > 0) == (F.col("b") > 0)).count() == 0


def test_nested_and_long_paths_agree(docs):
    d = M.dfm(clean_tokens(docs))
    a = sorted(tuple(r) for r in Q.search(d, "the & !of").select("doc_id", "n").collect())
    b = sorted(tuple(r) for r in Q.search(M.to_long(d), "the & !of").select("doc_id", "n").collect())
    assert a == b


def test_folded_tokenizer_equals_filtered_on_corpus(docs):
    from lexiflow.operators.tokens import tokens_expr, tokens_expr_filtered
    for opts in (TextOptions(), TextOptions(remove_hyphens=False), TextOptions(remove_twitter=True)):
        diff = docs.filter(tokens_expr("text", opts) != tokens_expr_filtered("text", opts))
        assert diff.count() == 0
