"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["hist_chars", "wt_levels_chars", "wm_levels_chars", "wt_levels_bytes", "wt_levels_users", "wt_nodes_users", "wt_merge_nodes_users", "wm_decode_events", "export_matrix_chars", "verify_stored_bytes", "dsplit_targets"]


def main() -> None:
    from pyspark.sql import SparkSession

    from undulo.plans.queries import QUERIES, Text

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = spark.config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["wt_levels_sigma5"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    names = Text(spark, SF_DIR, "chars").alphabet
    rate = {kind: round(names.n * names.height / took[f"{kind}_levels_chars"]) for kind in ("wt", "wm")}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "symbols": names.n, "levels": names.height, "symbol_levels_per_second": rate, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
