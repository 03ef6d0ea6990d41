"""Times headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tidewell import queries as q

HEADLINE = [
    "flagship", "seg_rollup", "label_window_28", "stats14", "mad14", "wk_wkend_stats", "half_slopes", "breakpoint",
    "robust_norm", "tertiles", "within_user_split", "auc_rank", "spearman", "pair_rules", "entity_sim_score", "soft_assign",
]


def session(cpus: str) -> SparkSession:
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.maxPlanStringLength": "20000",
        "spark.driver.memory": "8g", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.local.dir": folder,
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    q.QUERIES["seg_rollup"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    seconds, failed = {}, {}
    for name in HEADLINE:
        start = time.time()
        try:
            q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - start, 3)
        except Exception as e:  # noqa: BLE001  one failing query is named and does not hide the others
            failed[name] = str(e)[:200]
            print(f"{name} failed: {failed[name]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}
    print(json.dumps(line | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()
