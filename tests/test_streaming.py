"""Online state equals the batch frame; late events are set aside."""

from pyspark.sql import functions as F

from caseloom.operators import frame as fr
from caseloom.schema import CLICKS
from caseloom.sources import tables as t
from caseloom.streaming import online as on


def test_stream_equals_batch_in_several_batches(spark, sf_dir):
    ev = t.clicks(spark, sf_dir)
    lo, hi = ev.agg(F.min("us"), F.max("us")).first()
    src = ev.select("case_id", "event_idx", "us", "activity")
    path = on.in_batches(src, [lo + (hi - lo) * i // 3 for i in (1, 2)], "us", "t-replay")
    stream = on.event_stream(spark, path, src.schema, files_per_batch=1)
    out = spark.read.parquet(on.run_available(on.online_features(stream), "t-online"))
    cols = ["case_id", "event_idx", "pos", "prev1", "prev2", "dt_s", "elapsed_s"]
    assert out.where("late").isEmpty()
    want = fr.prefix_frame(ev, CLICKS, order=3).select(*cols)
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.collect())) or set(map(tuple, out.select(*cols).collect())) == set(map(tuple, want.collect()))


def test_late_event_is_set_aside(spark):
    src = spark.createDataFrame([("a", 0, 10, "x"), ("a", 1, 30, "y"), ("a", 2, 20, "late"), ("a", 3, 40, "z")], "case_id string, event_idx long, us long, activity string")
    path = on.in_batches(src.withColumn("b", F.floor(F.col("event_idx") / 2)), [1], "b", "t-late")
    stream = on.event_stream(spark, path, "case_id string, event_idx long, us long, activity string, b long", files_per_batch=None)
    # both files arrive in one batch: sorted, so nothing is late
    one = spark.read.parquet(on.run_available(on.online_features(stream), "t-one"))
    assert one.where("late").isEmpty() and one.count() == 4
    first = on.in_batches(src.where("event_idx < 2"), [], "us", "t-two")
    ck = on.scratch_path(spark, "ck")
    out = on.scratch_path(spark, "out")

    def run():
        q = on.online_features(on.event_stream(spark, first, src.schema)).writeStream.outputMode("append").option("checkpointLocation", ck).option("path", out).format("parquet").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    src.where("event_idx >= 2").write.mode("append").parquet(first)
    run()
    got = {r["activity"]: (r["pos"], r["late"]) for r in spark.read.parquet(out).collect()}
    assert got == {"x": (0, False), "y": (1, False), "late": (None, True), "z": (2, False)}
