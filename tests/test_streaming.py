"""A stream with late rows over several triggers gives what the batch recursion gives."""

import datetime
import random

from pyspark.sql import functions as F

from riskweave.operators import recursion
from riskweave.streaming.ewma import ewma_stream


def test_late_rows_take_their_place(spark, tmp_path):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(s, start + datetime.timedelta(hours=6 * k), rng.gauss(0, 0.02)) for s in ("a", "b") for k in range(40)]
    batches: list[list] = [[] for _ in range(6)]
    for s, t, r in rows:
        k = (t - start).days // 2
        batches[min(5, k + (rng.random() < 0.3))].append((s, t, r))  # up to two days late
    batches[5] += [("a", None, 1.0), ("a", start, None)]
    for n, far in enumerate((400, 800)):  # pushes the watermark past everything, then lets it act
        batches.append([("z", start + datetime.timedelta(days=far), 0.0)] if n < 2 else [])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, "series string, t timestamp, r double").coalesce(1).write.mode("append").parquet(f"{source}/batch={n}")
    stream = spark.readStream.schema("series string, t timestamp, r double").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = ewma_stream(stream, 0.9, 1e-4, "5 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    assert query.exception() is None
    got = {(r["series"], r["t"]): r["volatility"] for r in spark.read.parquet(out).where("series <> 'z'").collect()}
    batch = recursion.affine(spark.createDataFrame(rows, "series string, t timestamp, r double"), 0.1 * F.col("r") * F.col("r"), 0.9, F.max(F.lit(1e-4)))
    want = {(r["series"], r["t"]): r["v"] ** 0.5 for r in batch.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
