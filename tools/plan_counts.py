"""Scans and shuffles in the final plan of a query: python tools/plan_counts.py [folder] query ..."""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])


def plan_counts(df) -> dict[str, int]:
    """Of the plan that ran, after adaptive execution; what an exchange reuses counts once."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = [re.sub(r"^[\s:+|*()\d-]+", "", x) for x in text.splitlines()]
    count = lambda pattern: sum(bool(re.match(pattern, x)) for x in lines)
    return {"scans": count("FileScan|Scan "), "shuffles": count("Exchange "), "reused": count("ReusedExchange"), "broadcasts": count("BroadcastExchange")}


if __name__ == "__main__":
    from stitchspark import plans
    from tools.compare import session

    folder, names = ("/root/testdata/sf0.01", sys.argv[1:]) if not sys.argv[1:2] or "/" not in sys.argv[1] else (sys.argv[1], sys.argv[2:])
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        print(name, plan_counts(plans.RUN[name](spark, folder)), flush=True)
