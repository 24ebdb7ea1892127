"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Size model, windows, selection, kernels both ways.
NAMES = ["block_features", "size_for", "size_dict", "size_rle", "select_fastest", "select_fast", "fcm_prediction", "roundtrip_for", "roundtrip_delta_bp", "roundtrip_alp", "roundtrip_max"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from stratalane import queries
    from stratalane.config import Config
    from stratalane.operators import frames
    from stratalane.plans import blocks

    trials = int(os.environ.get("BENCH_TRIALS", "1"))

    def timed(work) -> float:
        """Median of the trials."""
        took = []
        for _ in range(trials):
            began = time.time()
            work()
            took.append(time.time() - began)
        return statistics.median(took)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    seconds = {}
    noop(queries.QUERIES["roundtrip_raw"](spark, SF))  # starts the workers
    for name in NAMES:
        seconds[name] = round(timed(lambda: noop(queries.QUERIES[name](spark, SF))), 3)
    # ratio and speed of a table of ten numeric columns, both ways, with its types
    t = spark.read.parquet(f"{SF}/lineitem.parquet").drop("l_returnflag", "l_linestatus")
    rows = t.count()
    schema, cols = t.schema, t.columns
    t = blocks.number(t, cols)
    assert t.count() == rows == t.select("pos").distinct().count(), "numbering lost rows"
    widths = dict(t.dtypes)
    raw = rows * sum(blocks.LANES[widths[c]][1] for c in cols)
    codec = {}
    for level in ("fastest", "fast", "balanced", "max"):
        began = time.time()
        got = frames.encode(t, cols, Config(level)).persist()
        size = got.agg(F.sum(F.length("payload") + 9)).first()[0] + 16 * len(cols)
        enc = time.time() - began
        back = frames.restore(got, schema)
        dec = timed(lambda: noop(back))
        assert back.count() == rows, "decoding lost rows"
        codec[level] = {"ratio": round(raw / size, 3), "enc_mb_s": round(raw / 1e6 / enc, 1), "dec_mb_s": round(raw / 1e6 / dec, 1)}
        seconds[f"lineitem_{level}"] = round(enc + dec, 3)
        got.unpersist()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "codec": codec, "sf": os.path.basename(SF.rstrip("/"))}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
