"""Print the formatted physical plan of registered queries (for plan review).

Usage: python tools/show_plans.py [sf_dir] [name ...]
Plans are shown after one execution, so AQE's final plan (broadcasts, coalesced partitions,
skew splits) is what you see.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from regiopanel.plans.catalog import QUERIES  # noqa: E402
from regiopanel.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [n for n in QUERIES if not n.startswith("ml_group") and n != "ml_predictions_long"]
    spark = local_session(8)
    for name in names:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        print(f"==================== {name}")
        df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
