"""Headline queries, timed: one JSON line on stdout.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  The graph
tables are written first and timed as ``build_graph``, the source files and raw
graph records as ``write_inputs``, since queries read them; each query then runs once, to the end, on a warm JVM.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from loomgraph.plans import load_registry
from loomgraph.plans.projections import GraphTables
from loomgraph.session import tune

HEADLINE = (
    "g1_hotspots", "e3_find_symbol", "e4_find_callers", "e6_substring_search", "e7_relevance_search",
    "e9_find_dependencies", "e13_find_sql_object", "f1_blast_radius_wide", "f2_shortest_path",
    "g2_counts", "g5_communities", "g8_hubs", "g14_summary_line", "g16_confidence_report",
    "h2_daily_counts", "h9_anomalies", "h11_rate_decisions", "i3_fold_runs",
    "b14_import_summary", "d3_sweep_edges", "c3_topic_roles", "c6_tsql_edges", "c8_postgres_edges", "c14_routes",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_registry()[0]
    only = sys.argv[1:]
    times: dict[str, float] = {}
    tables = GraphTables(tune(spark), sf_dir)
    start = time.time()
    tables.entities()
    tables.edges()
    tables.ownership()
    times["build_graph"] = round(time.time() - start, 3)
    start = time.time()
    tables.search_index()
    times["build_search_index"] = round(time.time() - start, 3)
    start = time.time()
    tables.files()
    tables.raw_nodes()
    tables.raw_links()
    times["write_inputs"] = round(time.time() - start, 3)
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.time()
        run(registry[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
