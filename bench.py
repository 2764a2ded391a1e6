"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    import roadloom.queries as q
    from roadloom.operators import paths, scoring
    from roadloom.sources.files import grid_graph
    from roadloom.storage import checkpoint

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, make):
        began = time.time()
        out = checkpoint(make())
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
        return out

    grid = grid_graph(spark, 50)
    grid = type(grid)(checkpoint(grid.nodes), checkpoint(grid.edges))
    timed("warm_up", lambda: paths.betweenness(grid_graph(spark, 8)))
    exact = timed("grid50_betweenness_exact", lambda: paths.betweenness(grid))
    some = timed("grid50_betweenness_k150", lambda: paths.betweenness(grid, k=150, seed=42))
    both = exact.withColumnRenamed("betweenness", "a").join(some.withColumnRenamed("betweenness", "b"), ["graph_id", "node_id"]).withColumn("ord", exact["node_id"])
    agreement = scoring.centrality_comparison(both).first()["spearman"]
    for name in ("road_components", "road_bridges", "road_efficiency", "road_criticality", "road_percolation", "road_resilience_to_flood", "road_apls", "threshold_sweep", "otsu_thresholds", "lovasz_losses", "mask_closed", "mask_skeletons", "mask_graph"):
        timed(name, lambda n=name: q.queries()[n](spark, sf_dir))
    took.pop("warm_up")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "grid50_spearman_k150": round(agreement, 4)}))


if __name__ == "__main__":
    main()
