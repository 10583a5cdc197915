"""Times the headline queries; prints one line of JSON.

index_build makes the stored lexical index, which the lexical queries after it read; it counts as a query of its own.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from larkspur.plans import queries as plans

HEADLINE = "index_build term_frequencies detected_rooms bm25_single bm25_passages vector_search hybrid hybrid_sweep multiview tunnels graph_triples graph_as_of_all graph_contradictions session_views recall_by_answer summary".split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    plans.drawer_count(spark, folder).collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        if name == "index_build":
            plans.stored_index(spark, folder)
        else:
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
