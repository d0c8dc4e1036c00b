"""Benchmark: the full ledger review at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries" (per stage), "sf"}.
The value is the wall time of ``review()`` (all passes; the weak-label forest trains
concurrently with the isolation forest) plus writing every review table and the memo
table for the top 20 rows as the packet (parquet under the checkpoint folder). Per-pass
times come from the packet's own timings.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ledgerlens.operators.memos import memo_table
    from ledgerlens.plans.review import review_fixture
    from ledgerlens.session import get_session, scratch_path
    from ledgerlens.sources.sinks import write_packet

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    times: dict[str, float] = {}
    t_all = time.time()
    packet = review_fixture(spark, sf_dir)
    times["review_passes"] = round(time.time() - t_all, 3)
    times.update(packet.timings)
    t = time.time()
    tables = dict(packet.tables)
    tables["memo_table"] = memo_table(packet.flagged, top_n=20)
    write_packet(tables, scratch_path(spark, "packet"), parallelism=4)   # the product sink
    times["review_tables_and_memos"] = round(time.time() - t, 3)
    total = round(time.time() - t_all, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "review_wall_time", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
                      "rows": packet.request["row_count"]}))
    spark.stop()


if __name__ == "__main__":
    main()
