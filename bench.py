"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from parlance.plans import all_queries
from parlance.session import local_session

HEADLINE = [
    "a_01_chat_overview", "a_02_media_stats", "a_04_day_histogram", "a_05_heatmap", "p_02_message_render", "p_07_message_search",
    "l_01_latest", "l_05_media_timeline", "w_01_day_groups", "j_04_new_rows", "j_09_exclusive_files", "c_01_apple_canonical",
    "c_02_whatsapp_canonical", "c_04_export_assembly", "c_11_tapback_fold", "i_02_resolve_name", "i_06_import_new",
    "i_10_purge_chats", "i_13_edit_diff", "d_10_drift_upsert", "t_05_live_reactions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = all_queries()
    # One untimed query starts the JVM's code paths and the Python workers.
    queries["a_04_day_histogram"](spark, folder).write.format("noop").mode("overwrite").save()
    queries["c_08_attributed_body"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
