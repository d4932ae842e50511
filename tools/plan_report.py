"""Write PLANS.md: the executed (AQE final) physical plan shape of every
registered operator, run over shop tables stored with ``write_tables``.

``python tools/plan_report.py [sf_dir]`` (default sf0.01).
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from orderlens.queries import OPERATORS  # noqa: E402
from orderlens.session import local_session  # noqa: E402
from orderlens.sources.fixtures import shop_tables  # noqa: E402
from orderlens.sources.tables import read_parquet_tables, write_tables  # noqa: E402


def final_plan(plan: str) -> str:
    """The final-plan section of an adaptive plan's text."""
    return plan.split("== Initial Plan ==")[0]


def summarize(plan: str) -> dict[str, str]:
    plan = final_plan(plan)
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)"
                       r"[^\n]*?\b(Inner|LeftOuter|LeftSemi|LeftAnti|RightOuter|FullOuter)", plan)
    join_txt = ", ".join(sorted({f"{a.replace('Join', '')} {b}" for a, b in joins})) or "-"
    return {
        "hash exchanges": str(len(re.findall(r"Exchange hashpartitioning", plan))),
        "other exchanges": str(len(re.findall(r"Exchange (rangepartitioning|SinglePartition|RoundRobin)", plan))),
        "broadcasts": str(plan.count("BroadcastExchange")),
        "joins": join_txt,
        "partial aggs": str(len(re.findall(r"(?:Hash|SortAggregate|ObjectHash)\w*\(keys?=[^\n]*partial_", plan))),
        "windows": ", ".join(w for w in ("WindowGroupLimit", "Window ") if w in plan).strip() or "-",
        "top-k": "yes" if "TakeOrderedAndProject" in plan else "-",
        "python": "YES" if ("EvalPython" in plan or "PythonUDF" in plan) else "-",
        "codegen stages": str(len(set(re.findall(r"\*\((\d+)\)", plan)))),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(shuffle_partitions=8)
    root = tempfile.mkdtemp(prefix="orderlens-plans-")
    write_tables(shop_tables(spark, sf_dir), root)
    t = read_parquet_tables(spark, root)
    cols = ["hash exchanges", "other exchanges", "broadcasts", "joins", "partial aggs", "windows", "top-k", "python",
            "codegen stages"]
    lines = ["# PLANS", "",
             "Executed (AQE final) physical plans of every registered operator, over shop tables written by",
             f"`write_tables` from `{sf_dir}` (orders partitioned by month, files range-partitioned by key),",
             "`local[*]`, 8 shuffle partitions. Generated by `tools/plan_report.py`. Operators that materialize a page",
             "or a sequence with `checkpoint()` show only the plan after the checkpoint.", "",
             "| operator | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for name, fn in OPERATORS.items():
        df = fn(t)
        df.collect()
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        lines.append(f"| `{name}` | " + " | ".join(s[c] for c in cols) + " |")
        print(name, s, flush=True)
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
