"""Write PLANS.md: the physical plan of every review pass at sf0.01 (abridged lines).

usage: python tools/dump_plans.py [sf_dir]
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan_text(df, width=170):
    txt = df._jdf.queryExecution().executedPlan().toString()
    txt = re.sub(r"#\d+L?", "", txt)
    return "\n".join(line[:width] for line in txt.splitlines())


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from ledgerlens.constants import TIER1_FEATURES
    from ledgerlens.operators.clean import clean_gl
    from ledgerlens.operators.features import engineer_features
    from ledgerlens.operators.iforest import training_sample
    from ledgerlens.operators.memos import memo_rank
    from ledgerlens.operators.stats import compute_stats
    from ledgerlens.plans.review import review_fixture
    from ledgerlens.session import get_session
    from ledgerlens.sources.fixture import FIXTURE_PARAMS, gl_fixture
    spark = get_session()
    p = FIXTURE_PARAMS
    clean = clean_gl(gl_fixture(spark, sf_dir))
    stats = compute_stats(clean, p["period_start"], p["period_end"])
    feat_lazy = engineer_features(clean, stats, period_end=p["period_end"])
    pk = review_fixture(spark, sf_dir, forest_trees=20)
    sections = [
        ("Pass 2 — features (before it is written)", feat_lazy),
        ("Pass 3 — isolation-forest training sample", training_sample(
            pk.features, TIER1_FEATURES, int(stats.globals["n_rows"]), 200, 256, 42)),
        ("Review table — top accounts (reads the scored table)", pk.tables["top_accounts"]),
        ("Review table — tier distribution", pk.tables["tier_distribution"]),
        ("Review table — review drivers", pk.tables["top_drivers"]),
        ("Review table — integrity report", pk.tables["integrity_report"]),
        ("Memo rank (top 20 of the queue)", memo_rank(pk.flagged, 20)),
    ]
    out = ["# Physical plans of the review passes", "",
           f"Generated by `tools/dump_plans.py` on `{sf_dir}` (expression ids stripped, long lines cut).",
           "Things to look for: no `SortMergeJoin`/`CartesianProduct` on ledger rows, `BroadcastHashJoin`",
           "for the statistic dimensions, `PushedFilters`/pruned `ReadSchema` on the written tables,",
           "partial + final `HashAggregate` around each `Exchange`, `TakeOrderedAndProject` for top-k.", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", plan_text(df), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print("wrote", path)


if __name__ == "__main__":
    main()
