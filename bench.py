"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to a ``noop`` sink (the whole plan executes, nothing is
collected). Prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexiflow.plans.catalog import QUERIES  # noqa: E402
from lexiflow.session import local_session  # noqa: E402

HEADLINE = [
    "frequent_terms", "stopword_removal", "ngrams_1_2", "dictionary_glob", "dictionary_multiword",
    "dfm_trim", "weight_tfidf", "top_features_by_group", "comparison_terms", "search_by_group",
    "search_kwic", "kwic_word", "term_positions", "sim_correlation", "sim_on_grouped",
    "token_context", "frequent_lemmas", "stem_features_en",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    # warm-up of every query on the smallest scale (JIT, code generation,
    # Python workers), not timed; the timed runs read the data afresh
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for name in names:
            run(QUERIES[name](spark, warm))
    times = {}
    for name in names:
        t0 = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
