from datetime import datetime, timedelta


from strideline.model import SAMPLES, pin_utc
from strideline.spec import Generic
from strideline.streaming import live

START = datetime(2020, 5, 1)


def streamed(spark, tmp_path, rows, name, build):
    pin_utc(spark)
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.parquet(f"{tmp_path}/in/{name}{i}")
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def sample(second, value=1.0):
    return ("s", "value", START + timedelta(seconds=second), float(value), False)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [[sample(1, 2), sample(30, 4)], [sample(70, 5), sample(500)], [sample(600)], [sample(2, 99), sample(900)]]
    got = streamed(spark, tmp_path, rows, "tumbled", lambda s: live.tumbling(s, "1 minute", "10 seconds", [Generic(("mean", "n"))])).orderBy("ts").collect()
    assert [(r.ts, r.value_mean, r.value_n) for r in got[:2]] == [(START, 3, 2), (START + timedelta(minutes=1), 5, 1)]


def test_sessions(spark, tmp_path):
    rows = [[sample(0), sample(20), sample(200)], [sample(5000)], [sample(5001)]]
    got = streamed(spark, tmp_path, rows, "sessions", lambda s: live.sessions(s, "1 minute", "1 second")).orderBy("start_ts").collect()
    assert [(r.start_ts, r.n) for r in got[:2]] == [(START, 2), (START + timedelta(seconds=200), 1)]


def test_posture_changes_across_batches(spark, tmp_path):
    rows = [[sample(i, 40) for i in range(6)], [sample(i, 40) for i in range(6, 14)], [sample(i, 0) for i in range(14, 30)]]
    got = streamed(spark, tmp_path, rows, "postures", live.posture_changes).orderBy("us").collect()
    base = int((START - datetime(1970, 1, 1)).total_seconds()) * 10**6
    assert [((r.us - base) // 10**6, r.posture) for r in got] == [(0, 1), (14, 0)]
