from lexiflow.operators import dfm as M
from lexiflow.operators.tokens import clean_tokens
from lexiflow.session import spread, storage_folder


def test_materialize_cuts_lineage(spark, four_docs):
    d = M.dfm(clean_tokens(four_docs)).materialize()
    plan = d.rows._jdf.queryExecution().toString()
    assert "regexp" not in plan and "parquet" in plan.lower()
    assert d.long.count() == 19


def test_storage_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage_folder(spark)
    assert folder == named.rstrip("/") if named else folder.endswith("/_stored")


def test_spread_only_when_asked(spark):
    df = spark.range(10, numPartitions=2)
    assert spread(df, 5).rdd.getNumPartitions() == 5
