"""Write docs/PLANS.md: the final physical plan tree (after AQE) of representative queries.

Usage: python tools/plans_doc.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from regiopanel.plans.catalog import QUERIES  # noqa: E402
from regiopanel.session import local_session  # noqa: E402

SHOWN = ["filter_eq", "io_collection_partitioned_scan", "agg_mean_traffic", "reshape_pivot_categories",
         "panel_left_join", "ml_eval_metrics", "topk_per_group", "join_common_regions_semi", "sort_predictions"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    out = ["# Physical plans", "",
           f"Final plans after adaptive execution, `local[8]`, `{os.path.basename(sf)}`. "
           "Regenerate with `python tools/plans_doc.py`.", ""]
    for name in SHOWN:
        df = QUERIES[name](spark, sf)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # run this plan itself (nothing reaches the driver) so AQE finalises it
        final = qe.executedPlan()
        doc = (QUERIES[name].__doc__ or "").strip().splitlines()[0]
        out += [f"## `{name}`", "", doc, "", "```", final.toString().rstrip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(out))
    spark.stop()
    print(path)


if __name__ == "__main__":
    main()
