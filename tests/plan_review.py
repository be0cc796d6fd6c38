"""Plan review: run each headline query once and count the operators of
its final (adaptive) physical plan.

    python tests/plan_review.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NODES = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
         "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "Window", "Scan parquet",
         "MapInPandas")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as ent
    from bench import HEADLINE
    from demandlake.session import get_session
    spark = get_session("local[8]", 8)
    qs = ent.queries()
    print(f"# Plan review ({os.path.basename(sf_dir)}, final adaptive plans)\n")
    print("| query | " + " | ".join(n.replace("Exchange ", "X ") for n in NODES) + " | pushed filters |")
    print("| --- | " + " | ".join("---" for _ in NODES) + " | --- |")
    for name in HEADLINE:
        if name not in qs:
            continue
        df = qs[name](spark, sf_dir)
        df.collect()  # the same query execution: its plan is then the final one
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"== Initial Plan ==.*?(?=== Final Plan ==|\Z)", "", plan, flags=re.S)
        counts = [len(re.findall(re.escape(n) + r"\b", plan)) for n in NODES]
        pushed = sorted({p[:80] for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan)})
        print(f"| {name} | " + " | ".join(str(c) for c in counts) + " | "
              + "; ".join(p for p in pushed if p) + " |", flush=True)


if __name__ == "__main__":
    main()
