import datetime as dt

from core_helpers import rows
from lexiflow.operators import dfm as M
from lexiflow.operators.filters import filter_documents, filter_in
from lexiflow.operators.stem import stem_features, suffix_mapping
from lexiflow.operators.table_view import table_view
from lexiflow.operators.tokens import clean_tokens
from lexiflow.sources.profile import docvar_domains, usable_docvars


def test_stem_features_merges(spark):
    docs = spark.createDataFrame([(1, "running runs run"), (2, "dogs dog")], "doc_id long, text string")
    d = stem_features(M.dfm(clean_tokens(docs)))
    assert sorted(rows(d.long)) == [(1, "run", 2), (1, "runn", 1), (2, "dog", 2)]


def _docs(spark):
    return spark.createDataFrame(
        [(1, "a", 10.0, dt.date(2024, 1, 1), 1), (2, "b", 20.0, dt.date(2024, 2, 1), None),
         (3, None, 30.0, dt.date(2024, 3, 1), 0), (4, "a", None, dt.date(2024, 4, 1), 1)],
        "doc_id long, lang string, score double, d date, q int")


def test_filters(spark):
    df = _docs(spark)
    ids = lambda x: sorted(r["doc_id"] for r in x.collect())
    assert ids(filter_documents(df, {"score": (10, 20)})) == [1, 2]
    assert ids(filter_documents(df, {"d": (dt.date(2024, 2, 1), "2024-03-01")})) == [2, 3]
    assert ids(filter_in(df, "lang", ["b", "NA"])) == [2, 3]
    assert ids(filter_in(df, "lang", [])) == [1, 2, 3, 4]
    assert ids(filter_documents(df, {"lang": ["a"], "q": (1, 1)})) == [1, 4]


def test_profile_and_domains(spark):
    df = _docs(spark)
    prof = {r["name"]: (r["kind"], r["n_distinct"], r["usable"]) for r in usable_docvars(df).collect()}
    assert prof == {"lang": ("character", 3, True), "score": ("numeric", 4, True),
                    "d": ("date", 4, True), "q": ("numeric", 3, True)}
    strict = {r["name"]: r["usable"] for r in usable_docvars(df, types_always=()).collect()}
    assert strict["score"] is True
    dom = {r["name"]: (r["min_value"], r["max_value"], r["levels"]) for r in docvar_domains(df).collect()}
    assert dom["lang"] == (None, None, ["NA", "a", "b"])
    assert dom["score"] == ("10.0", "30.0", None) and dom["d"] == ("2024-01-01", "2024-04-01", None)


def test_table_view(spark):
    df = spark.createDataFrame([("the", 3), ("this", 3), ("that", 5), ("dog", 9)], "term string, n long")
    assert rows(table_view(df, "n", page=1, size=2, search="th")) == [("that", 5), ("the", 3)]
    assert rows(table_view(df, "n", page=2, size=2, search="th")) == [("this", 3)]


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.columns == ["term", "nb_terms", "nb_docs", "prop_docs"] and out.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    own = {name for name in qs if not name.startswith("op") and name != "pipeline"}
    # iterative results and rule cascades, each tested against a brute-force version or a fixture
    without = {"cooccurrence_tree", "topic_terms", "svd_values", *(f"stem_rules_{n}" for n in
               ("english", "french", "german", "spanish"))}
    assert own - set(sql) == without


def test_stems_by_suffix_and_by_mapping(spark):
    docs = spark.createDataFrame([(1, "Zeitungen Zeitung ab Haus"), (2, "Zeitung")], "doc_id long, text string")
    d = M.dfm(clean_tokens(docs))
    assert sorted(rows(stem_features(d, "german").long)) == [(1, "ab", 1), (1, "hau", 1), (1, "zeit", 2), (2, "zeit", 1)]
    mapping = spark.createDataFrame([("zeitungen", "zeitung")], "term string, stem string")
    assert sorted(rows(stem_features(d, mapping).long)) == [
        (1, "ab", 1), (1, "haus", 1), (1, "zeitung", 2), (2, "zeitung", 1)]
    words = spark.createDataFrame([("running_dogs",), ("as",), ("nations",)], "term string")
    assert {r["term"]: r["stem"] for r in suffix_mapping(words).collect()} == {
        "running_dogs": "runn_dog", "as": "as", "nations": "nation"}


def test_full_domain_filters_are_skipped(spark):
    from lexiflow.operators.filters import domains_of
    df = _docs(spark)
    dom = domains_of(docvar_domains(df))
    ids = lambda x: sorted(r["doc_id"] for r in x.collect())
    assert ids(filter_documents(df, {"score": (10, 30)}, dom)) == [1, 2, 3, 4]   # NULL kept
    assert ids(filter_documents(df, {"score": (10, 30)})) == [1, 2, 3]
    assert ids(filter_documents(df, {"score": (10, 20)}, dom)) == [1, 2]
    assert ids(filter_documents(df, {"d": (dt.date(2024, 1, 1), dt.date(2024, 4, 1))}, dom)) == [1, 2, 3, 4]
    assert ids(filter_documents(df, {"lang": ["a", "b", "NA"]}, dom)) == [1, 2, 3, 4]


def test_line_ids_do_not_depend_on_splits(spark, tmp_path):
    from lexiflow.sources.corpus import read_corpus
    lines = []
    for name, n in (("b.txt", 40), ("a.txt", 300), ("c.txt", 0), ("d.txt", 1)):
        own = [f"{name} line {i} " + "x" * (i % 17) for i in range(n)]
        (tmp_path / name).write_text("".join(line + "\n" for line in own))
        lines.append((name, own))
    want = [(i, t) for i, t in enumerate(t for _, own in sorted(lines) for t in own)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("64b", "1000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0b" if size != "128m" else opened)
            got = read_corpus(spark, str(tmp_path), "text")
            assert sorted(rows(got, "doc_id", "text")) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
