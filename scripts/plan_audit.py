"""Print the plan shape of each registered query (final adaptive plans)."""
import sys

sys.path.insert(0, "/root/repo")
from lexiflow.plans.audit import plan_shape  # noqa: E402
from lexiflow.plans.catalog import QUERIES  # noqa: E402
from lexiflow.session import local_session  # noqa: E402

spark = local_session(8)
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
for name in sys.argv[2:] or list(QUERIES):
    df = QUERIES[name](spark, sf)
    df.collect()
    s = plan_shape(df)
    print(f"{name:32s} tokenize={s['tokenize']} reused={s['reused']} shuffles={s['shuffles']} "
          f"spread={s['spread']} broadcasts={s['broadcasts']} {' '.join(s['flags'])}")
