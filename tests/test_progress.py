"""Progress of a running stream."""

import time

from pyspark.sql import functions as F

from folio.streaming.progress import Progress, watched


def test_done_total_and_time_left_while_it_runs(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("seq"), F.when(F.col("id") % 5 == 0, "no").alias("error")).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
    jobs = spark.readStream.schema("seq long, error string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "land"))
    seen, gate = [], tmp_path / "gate"
    with Progress(spark, total=30) as progress:
        def write(batch, number):  # the last batch waits until the others have been looked at
            batch.count()
            end = time.time() + 60
            while number == 2 and not gate.exists() and time.time() < end:
                time.sleep(0.05)

        query = watched(jobs).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        end = time.time() + 60
        while progress.done < 20 and time.time() < end:
            time.sleep(0.05)
        seen = progress.done, progress.failed, progress.arrived, progress.total, progress.seconds_left()
        gate.touch()
        query.awaitTermination(60)
        while progress.done < 30 and time.time() < end:
            time.sleep(0.05)
        assert seen[:4] == (20, 4, 20, 30) and seen[4] > 0
        took = progress.seconds_left(progress.since + 40.0)
        assert (progress.done, progress.failed, took) == (30, 6, 0)
    assert progress.total == 30


def test_no_time_is_named_before_the_first_is_done(spark):
    progress = Progress(spark)
    assert progress.seconds_left() is None and progress.total == 0
    progress.since, progress.done, progress.arrived = 100.0, 4, 10
    assert progress.seconds_left(now=120.0) == 30.0
