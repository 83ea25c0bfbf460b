"""Print the physical plan shape of the main registered queries: operator
tree, pushed filters and read schemas. Used to write PLANS.md.

    python tests/plan_report.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DEFAULT = ["import_new_rows", "assign_ids", "classify", "classify_join", "reverse_position",
           "pending_incremental", "ledger_page", "latest_run_by_job", "history_delta"]


def shape(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    keep, skip_deeper = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skip_deeper is not None:
            if indent > skip_deeper:
                continue  # the cached relation's own plan
            skip_deeper = None
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        if "InMemoryRelation" in line:
            skip_deeper = indent
        if len(line) > 160:
            line = line[:157] + "..."
        keep.append(line)
    return "\n".join(keep)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if "/" not in a] or DEFAULT
    from tally.plans.table_queries import QUERIES
    from tally.session import build_session
    spark = build_session()
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        print(f"### {name}\n\n```\n{shape(df)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
