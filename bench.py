"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = ("solid_volume", "orient_signs", "plane_sides", "plane_dictionary", "plane_pairs", "edge_planes", "mesh_volume", "mesh_topology", "cell_assignment", "adaptive_leaves", "plane_culling", "box_overlaps", "point_winding", "csg_membership", "plane_meets", "exact_arithmetic", "boolean_volume", "nary_volume")


def main() -> None:
    from pyspark.sql import SparkSession

    from tessel.queries import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1].strip("/")}))
    spark.stop()


if __name__ == "__main__":
    main()
