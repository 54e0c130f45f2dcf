import os
import uuid

import pytest
from core_helpers import rows
from pyspark.sql import functions as F

from lexiflow.operators import kwic as K
from lexiflow.operators import search as Q
from lexiflow.operators import similarity as H
from lexiflow.operators.dfm import dfm
from lexiflow.operators.pages import store_pages
from lexiflow.plans.catalog import load_corpus
from lexiflow.operators.tokens import clean_tokens
from lexiflow.session import storage_folder
from lexiflow.sources.token_index import build_index, open_index

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokens(spark):
    more = spark.createDataFrame([(9001, [], "en"), (9003, ["de", "la", "de"], None)],
                                 "doc_id long, tokens array<string>, lang string")
    return clean_tokens(load_corpus(spark, SF)).select("doc_id", "tokens", "lang").unionByName(more)


@pytest.fixture(scope="module")
def path(spark, tokens):
    path = f"{storage_folder(spark)}/{uuid.uuid4().hex}"
    build_index(tokens, path, buckets=24, blocks=6)
    return path


@pytest.mark.parametrize("query", ["the & !that", "(the | of) & !that", "the + of > 10", "zzzz", "!the"])
def test_index_search_equals_search(spark, tokens, path, query):
    index = open_index(spark, path)
    want = rows(Q.search(dfm(tokens), query), "doc_id", "lang", "n")
    assert sorted(rows(index.search(query), "doc_id", "lang", "n"), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("how", [dict(terms=["que", "und"]), dict(phrase="de la"), dict(phrase="of the"), dict(terms=["zzzz"])])
def test_index_kwic_equals_kwic(spark, tokens, path, how):
    got = rows(open_index(spark, path).kwic(**how))
    assert sorted(got) == sorted(rows(K.kwic(tokens, **how)))


def test_index_cooccurring_equals_the_operator(spark, tokens, path):
    got = {r for r in rows(open_index(spark, path).cooccurring_docs("der")) if r[1]}
    assert got == {r for r in rows(H.cooccurring_docs(dfm(tokens), "der")) if r[1]}


def test_only_the_buckets_of_the_terms_are_read(spark, path):
    index = open_index(spark, path)
    postings = index.postings_of(["the", "of"])
    files = {r[0] for r in postings.select(F.input_file_name()).distinct().collect()}
    assert 1 <= len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 2
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [(bucket" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "term" in scan.split("PushedFilters")[1]
    assert len([d for d in os.listdir(path.replace("file:", "") + "/postings") if d.startswith("bucket=")]) > 2


def test_globs_are_refused(spark, path):
    with pytest.raises(ValueError):
        open_index(spark, path).kwic(["th*"])


def test_empty_table(spark, tokens):
    index = build_index(tokens.limit(0), f"{storage_folder(spark)}/{uuid.uuid4().hex}", 2, 2)
    assert index.search("a | b").collect() == [] and index.kwic(["a"]).collect() == []


def test_pages_equal_offset_and_limit(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"), F.col("id"), F.lit("x").alias("__x"))
    df = df.unionByName(df.limit(0)).repartition(5)
    stored = store_pages(df, F.desc("v"), "id", partitions=7)
    whole = rows(df.orderBy(F.desc("v"), "id"))
    assert stored.total == 1000 and stored.columns == df.columns
    for page, size in ((1, 10), (2, 33), (50, 20), (51, 20), (7, 150), (1, 2000)):
        assert rows(stored.page(page, size)) == whole[(page - 1) * size:page * size]
    assert rows(stored.slice(995, 3)) == whole[994:997]
    with pytest.raises(ValueError):
        stored.slice(0, 5)


def test_a_deep_page_reads_one_partition(spark):
    stored = store_pages(spark.range(5000), "id", partitions=10)
    page = stored.page(240, 20)
    assert rows(page) == [(i,) for i in range(4780, 4800)]
    files = stored.rows.where(F.col("__part") == stored.before[-1][0]).inputFiles()
    assert {r[0] for r in page.select(F.input_file_name()).distinct().collect()} <= set(files) or len(stored.before) > 1


def test_pages_of_nothing(spark):
    stored = store_pages(spark.range(0), "id")
    assert stored.total == 0 and stored.page(3).collect() == []


def test_postings_are_gathered_in_the_row(spark):
    from lexiflow.sources.token_index import _row_postings
    rows_ = spark.createDataFrame([(1, 0, ["b", "a", "b", "b"]), (2, 1, ["c"]), (3, 1, ["a", None, "a"])],
                                  "doc_id long, block int, tokens array<string>")
    out = _row_postings(rows_)
    assert sorted(rows(out, "doc_id", "block", "term", "positions"), key=repr) == [
        (1, 0, "a", [2]), (1, 0, "b", [1, 3, 4]), (2, 1, "c", [1]), (3, 1, "a", [1, 3]), (3, 1, None, [2])]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
