"""Shape of an executed plan: counts taken from the final adaptive plans
only (the "Initial Plan" sections, also those of subqueries, are skipped)."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame


def final_plan_text(df: DataFrame) -> str:
    """Executed plan of ``df`` (run it first) without initial-plan sections."""
    text = df._jdf.queryExecution().executedPlan().toString()
    out, skip_col = [], None
    for line in text.split("\n"):
        m = re.search(r"[A-Za-z*(]", line)
        col = m.start() if m else len(line)
        if skip_col is not None:
            if col >= skip_col:
                continue
            skip_col = None
        if "== Initial Plan ==" in line:
            skip_col = line.index("==")
            continue
        out.append(line)
    return "\n".join(out)


def plan_shape(df: DataFrame) -> dict:
    plan = final_plan_text(df)
    return {
        "tokenize": plan.count("regexp_extract_all("),
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan)),
        "spread": plan.count("RoundRobinPartitioning"),
        "broadcasts": plan.count("BroadcastExchange"),
        "reused": plan.count("ReusedExchange"),
        "subqueries": len(re.findall(r"(?<!Reused)Subquery subquery", plan)) // 2,
        "flags": [f.strip() for f in ("WindowGroupLimit", "TakeOrderedAndProject", "BroadcastHashJoin",
                                      "SortMergeJoin", "BroadcastNestedLoopJoin", "Generate", "Window ",
                                      "MapInPandas") if f in plan],
    }
