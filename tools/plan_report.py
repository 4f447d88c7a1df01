"""Print the physical-plan profile of every registered query.

Usage: python tools/plan_report.py [sf_dir] [query ...]
Per query: shuffle exchanges, broadcast exchanges, broadcast / sort-merge joins,
Python nodes, cartesian products, and the pushed filters of each scan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftwise.plans import QUERIES  # noqa: E402
from siftwise.session import build_session  # noqa: E402

# Queries that run jobs, write files or train models while being built.
EAGER = {"cv_results", "best_model", "learning_curve", "al_round", "stream_classify", "stream_votes",
         "bulk_classify", "bulk_classify_quarantine", "verdict_file_leaderboard"}


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.001"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    names = args or sorted(n for n in QUERIES if n not in EAGER)
    spark = build_session("plan-report")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().explainString(mode)
        def count(op: str) -> int:      # operator entries of the formatted plan: "(n) Op"
            return len(set(re.findall(rf"^\((\d+)\) (?:{op})\b", plan, re.M)))
        pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan)) - {"[]"})
        print(f"{name:28s} shuffles={count('Exchange')} broadcasts={count('BroadcastExchange')}"
              f" bhj={count('BroadcastHashJoin')} smj={count('SortMergeJoin')}"
              f" python={count('ArrowEvalPython|BatchEvalPython|MapInPandas')}"
              f" cartesian={count('CartesianProduct|BroadcastNestedLoopJoin')} pushed={pushed[:3]}")
    spark.stop()


if __name__ == "__main__":
    main()
