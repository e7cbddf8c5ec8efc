"""Times the headline queries. Prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); names on the command line
    replace the default list, ``all`` runs every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from statwitness.plans import all_queries  # noqa: E402
from statwitness.session import local_session  # noqa: E402

HEADLINE = [
    "column_stats", "table_metadata", "pivot_first", "extract_tables", "glyphs_to_lines", "extract_headlines",
    "map_headlines", "suggest_mappings", "extract_claims", "verify_claims", "quality_dashboard", "chunk_fixed",
    "chunk_semantic", "explode_chunks", "top_k", "feedback_patterns", "weighted_agreement", "stream_agreement",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    known = all_queries()
    names = sys.argv[1:] or HEADLINE
    names = list(known) if names == ["all"] else names
    spark.range(1000).groupBy("id").count().count()  # warm up
    seconds = {}
    for name in names:
        t = time.perf_counter()
        known[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
