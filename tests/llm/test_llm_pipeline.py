"""The pipeline's stages and registry."""
import corpus_pipeline as cp
from llm_helpers import WORD, lower
from test_llm_text_ops import fingerprint

SF = "/root/testdata/sf0.001"


def test_registry():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in E.queries()
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, " ".join(f"shared{i}" for i in range(30)))], "item_id long, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    kept = cp.language_stage(spark, odd, sf)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert None not in texts and "" not in texts and "1234 5678" not in texts and "short" in texts
    one = cp.near_duplicate_stage(spark, odd, sf)
    assert one.columns == odd.columns
    rows = one.collect()
    assert sum(r.doc_id == 8 for r in rows) == 1 and sum(lower(r.text) == "short" for r in rows) == 1
    prints = [fingerprint(r.text) for r in rows]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
    clean = cp.decontamination_stage(spark, odd, sf)
    left = clean.collect()
    assert clean.columns == odd.columns and not any("shared5 " in (r.text or "") for r in left)
    assert len(left) == 15 - 4
    private = cp.privacy_stage(spark, odd, sf)
    assert private.columns == odd.columns and private.count() == 15
    assert not any("@" in (r.text or "") for r in private.collect())
    for stage in (cp.language_stage, cp.near_duplicate_stage, cp.decontamination_stage, cp.privacy_stage, cp.packing_stage):
        assert stage(spark, none, sf).count() == 0


def test_run_keeps_clean_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [WORD.findall(lower(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = cp.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    first = {i for i, p in prints.items() if not any(j < i and (p ^ q).bit_count() <= 2 for j, q in prints.items())}
    grams = {tuple(b[k:k + 13]) for b in bench for k in range(len(b) - 12)}

    def leaks(text):
        w = WORD.findall(lower(text))
        return any(tuple(w[k:k + 13]) in grams for k in range(len(w) - 12))
    # no benchmark passage and no near copy is left, and nearly every other document is
    assert not any(leaks(docs[i]) for i in kept)
    clean = {i for i in first if not leaks(docs[i])}
    assert kept <= first | {i for i in docs if i not in first} and len(clean - kept) <= 0.02 * len(clean)
