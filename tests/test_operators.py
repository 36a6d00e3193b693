"""Small recordings with results that can be counted by hand."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideline.functions import signals as S
from strideline.model import DAY, HOUR, MINUTE, SECOND, samples_from
from strideline.operators import batch, inference, spectral, values, windows
from strideline.operators import bouts as B
from strideline.spec import Bigrams, Cutpoints, FrequencyRanges, Generic, Percentiles, TopFrequencies, dictionary, names

START = datetime(2020, 5, 1)


def record(spark, runs, start=START, step=timedelta(minutes=1), subject="s"):
    flat = [v for n, v in runs for _ in range(n)]
    rows = [(subject, "value", start + i * step, None if v is None else float(v), v is None) for i, v in enumerate(flat)]
    return spark.createDataFrame(rows, "subject_id string, channel string, ts timestamp_ntz, value double, missing boolean")


def interval(spark, *pairs, subject="s"):
    rows = [(subject, START + timedelta(minutes=a), START + timedelta(minutes=b)) for a, b in pairs]
    return spark.createDataFrame(rows, "subject_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")


def minutes(df):
    return sorted(((r.start_ts - START) / timedelta(minutes=1), (r.end_ts - START) / timedelta(minutes=1)) for r in df.collect())


def test_hourly_statistics_and_empty_windows(spark):
    rows = record(spark, [(60, 0), (60, 1), (60, 2), (60, 3)])
    got = windows.tumbling(rows, HOUR, [Generic(("mean", "sum", "n", "missing")), Cutpoints(((0, 1), (2, 3)))]).orderBy("ts").collect()
    assert len(got) == 24
    assert [(r.value_mean, r.value_sum, r.value_n) for r in got[:4]] == [(0, 0, 60), (1, 60, 60), (2, 120, 60), (3, 180, 60)]
    assert tuple(got[4])[3:] == (-1, -1, 0, 0, 0, 0) and [r.value_0_1 for r in got[:4]] == [60, 60, 0, 0]
    half = (F.lit("2020-05-01 00:30:00").cast("timestamp_ntz"), F.lit("2020-05-01 04:00:00").cast("timestamp_ntz"))
    assert [r.value_sum for r in windows.tumbling(rows, HOUR, [Generic(("sum",))], half).orderBy("ts").collect()] == [30, 90, 150, 90]
    odd = windows.tumbling(rows, 7 * HOUR, [Generic(("n",))]).orderBy("ts").collect()
    assert [r.value_n for r in odd] == [240, 0, 0, 0]


def test_a_window_at_the_last_sample_is_empty(spark):
    rows = record(spark, [(61, 1)])
    count = lambda **k: [r.value_n for r in windows.tumbling(rows, HOUR, [Generic(("n",))], **k).orderBy("ts").collect()][:2]
    assert count() == [60, 0] and count(last_sample=False) == [60, 1]
    assert windows.tumbling(record(spark, [(1, 4)]), HOUR, [Generic(("n",))]).orderBy("ts").first().value_n == 1


def test_summary_given_index_and_sliding(spark):
    rows = record(spark, [(30, 0), (50, 1), (20, 2)])
    got = windows.summary(rows, [Generic(("sum", "min", "max", "std")), Cutpoints(((0, 0), (1, 1), (0, 1))), Percentiles((50,)), Bigrams((0, 1, 2))]).first()
    assert (got.value_sum, got.value_min, got.value_max, got.value_0_0, got.value_1_1, got.value_0_1, got.value_p50) == (90, 0, 2, 30, 50, 80, 1)
    assert (got.value_0tr0, got.value_0tr1, got.value_1tr2, got.value_2tr0) == (29, 1, 1, 0) and got.value_std == pytest.approx(0.7)
    listed = interval(spark, (0, 40), (20, 60), (500, 600))
    assert sorted((r.value_n, r.value_sum) for r in windows.given(rows, listed, [Generic(("n", "sum"))]).collect()) == [(0, -1), (40, 10), (40, 30)]
    assert windows.by_index(rows, 29, 31, [Generic(("sum",))]).first().value_sum == 1
    near = windows.sliding(rows, 4 * MINUTE, [Generic(("n", "sum"))]).orderBy("ts").collect()
    assert [r.value_n for r in near[:3]] == [2, 3, 4] and near[30].value_sum == 2
    gaps = windows.summary(record(spark, [(1, 0), (1, None), (1, 1)]), [Bigrams((0, 1))]).first()
    assert gaps.value_0tr1 == 1
    with pytest.raises(ValueError, match="unknown statistics"):
        Generic(("median",))


def test_bouts_end_at_the_next_sample(spark):
    rows = record(spark, [x for _ in range(8) for x in ((37, 0), (60, 1))])
    assert [B.bouts(rows, *r).count() for r in ((0, 0), (1, 1), (0, 1), (5, 9))] == [8, 8, 1, 0]
    assert minutes(B.bouts(rows, 0, 1)) == [(0, 776)]
    lengths = record(spark, [x for n in range(1, 8) for x in ((2, 0), (n, 1))])
    ones = B.bouts(lengths, 1, 1)
    assert [B.limit_lengths(ones, i * MINUTE).count() for i in range(1, 9)] == [7, 6, 5, 4, 3, 2, 1, 0]
    assert B.limit_lengths(ones, 3 * MINUTE, 5 * MINUTE).count() == 3 and B.limit_lengths(ones, 3 * MINUTE + SECOND).count() == 4
    assert minutes(B.bouts(record(spark, [(1, 3)]), 3, 3)) == [(0, 0)]
    masked = values.delete_windows(record(spark, [(5, 0)]), interval(spark, (1, 2)))
    assert B.bouts(masked, 0, 0).count() == 1 and B.bouts(masked, 0, 0, respect_missing=True).count() == 2


def test_interval_algebra(spark):
    a, b = interval(spark, (0, 60), (3000, 3100)), interval(spark, (0, 15), (60, 70), (40, 3050))
    assert minutes(B.intersection(a, b)) == [(0, 15), (40, 60), (3000, 3050)] == minutes(B.intersection(b, a, 7 * MINUTE))
    assert minutes(B.union(a, interval(spark, (60, 61), (100, 101)))) == [(0, 61), (100, 101), (3000, 3100)]
    period = a.select("subject_id", F.lit(START).alias("period_start"), F.lit(START + timedelta(minutes=3090)).alias("period_end")).distinct()
    assert minutes(B.complement(a, period)) == [(0, 0), (60, 3000), (3100, 3090)]
    assert minutes(B.complement(a, period, keep_empty=False)) == [(60, 3000)]
    assert minutes(B.complement(a.limit(0), period)) == [(0, 3090)]
    assert B.total_time(B.complement(a, period), unit=MINUTE).first().total == 2930
    cells = {r.cell: (r.seconds / 60, r.n) for r in B.confusion(interval(spark, (0, 60)), interval(spark, (30, 90)), period).collect()}
    assert cells == {"a0b0": (3000, 1), "a1b0": (30, 1), "a0b1": (30, 1), "a1b1": (30, 1)}


def test_length_quantiles(spark):
    lengths = [1, 1, 2, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 8, 8, 8, 8, 8, 9, 10, 11, 11, 12]
    rows = B.bouts(record(spark, [x for n in lengths for x in ((1, 0), (n, 1))] + [(1, 0)]), 1, 1).select(*B.INTERVAL)
    assert B.total_time(rows, unit=MINUTE).first().total == 150
    assert list(B.sdx(rows, list(range(10, 100, 10))).first())[1:] == [5, 6, 7, 8, 8, 8, 9, 11, 11]
    got = B.window_statistics(rows, interval(spark, (0, DAY // MINUTE), (900, 901)), [50]).orderBy("start_ts").collect()
    assert (got[0].bout_sum, got[0].bout_n, got[0].sd50) == (9000, 23, 8) and tuple(got[1])[3:] == (-1, -1, 0, -1)


def test_bouts_in_hours_and_raster(spark):
    rows = record(spark, [(30, 0), (30, 1), (30, 0), (90, 1)])
    hours = interval(spark, (0, 60), (60, 120), (120, 180))
    got = B.channel_bouts(rows, hours, [(1, 1), (1, 1, 3600)]).orderBy("start_ts").collect()
    assert [tuple(r)[3:] for r in got] == [(1800, 1, 0, 0), (1800, 1, 1800, 1), (3600, 1, 3600, 1)]
    period = hours.groupBy("subject_id").agg(F.min("start_ts").alias("period_start"), F.max("end_ts").alias("period_end"))
    grid = [r.value for r in B.raster(interval(spark, (30, 60)), period, 15 * MINUTE).orderBy("ts").collect()]
    assert grid == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]


def test_nonwear_valid_days_and_masks(spark):
    rows = record(spark, [(24 * 60, 1), (15 * 60, 0), (9 * 60, 1), (24 * 60, 1)])
    off, wear = inference.nonwear_counts(rows)
    assert minutes(off) == [(1440, 2340)] and wear.count() == 2
    bad, good = inference.valid_days(rows, wear)
    assert (bad.count(), good.count()) == (1, 2) and inference.valid_days(rows, wear, 9 * HOUR)[1].count() == 3
    got = windows.summary(values.delete_windows(rows, off), [Generic(("n", "missing")), Cutpoints(((0, 0),))]).first()
    assert (got.value_n, got.value_missing, got.value_0_0) == (3420, 900, 0)
    totals = set()
    for place in (0, 1, 2):
        runs = [[(120, 0), (600, 1), (600, 1)], [(600, 1), (120, 0), (600, 1)], [(600, 1), (600, 1), (120, 0)]][place]
        off, wear = inference.nonwear_counts(record(spark, runs))
        totals.add((B.total_time(off, unit=MINUTE).first().total, B.total_time(wear, unit=MINUTE).first().total))
    assert totals == {(120, 1199)}


@pytest.mark.parametrize(("window", "n"), [((0, 720), 720), ((360, 420), 1380), ((-90, 30), 1410), ((1400, 1500), 1400), ((-99, -9), 1440), ((5000, 6000), 1440)])
def test_masks_meet_the_record_anywhere(spark, window, n):
    rows = record(spark, [(1440, 1)])
    got = windows.summary(values.delete_windows(rows, interval(spark, window)), [Generic(("n", "missing", "sum"))]).first()
    assert (got.value_n, got.value_missing, got.value_sum) == (n, 1440 - n, n)


def test_value_transforms(spark):
    rows = record(spark, [(1, 0), (1, 5), (1, 10)])
    get = lambda df: [r.value for r in df.orderBy("ts").collect()]
    assert get(values.normalise(rows, 1, 2)) == [1, 1.5, 2] and get(values.normalise(rows.limit(1))) == [None]
    assert get(values.collapse(rows, [(0, 5, 1), (5, 9, 2)])) == [1, 2, 10]
    assert get(values.collapse_auto(rows, 4)) == [0, 2, 3]
    assert get(values.fill_windows(rows, interval(spark, (1, 2)), 9)) == [0, 9, 10]
    kept = values.restrict_timeframe(rows, F.lit(START + timedelta(minutes=1)), F.lit(START + timedelta(minutes=1)))
    assert get(values.shown(kept)) == [-111, 5, -111]
    fine = values.resample(rows, 30 * SECOND)
    assert get(fine) == [0, 2.5, 5, 7.5]
    assert values.sampling_gaps(rows).first().mean_gap == 60


def test_signal_expressions(spark):
    row = spark.createDataFrame([(0.0, 3.0, 4.0, datetime(2020, 5, 1, 6))], "x double, y double, z double, t timestamp_ntz")
    got = row.select(S.vector_magnitude("x", "y", "z").alias("vm"), S.enmo(F.lit(0.5)).alias("e"), S.enmo_a(F.lit(0.5)).alias("a"), S.pitch("y", "x", "z").alias("p"), S.roll("x", "y", "z").alias("r"), S.sine_wave("t").alias("s"), S.end_of("day", "t").alias("end"), S.is_midnight("t").alias("m")).first()
    assert got.vm == 5 and got.e == 0 and got.a == 500 and got.p == got.r == pytest.approx(np.degrees(np.arctan2(3, 4))) and got.s == 1
    assert got.end == datetime(2020, 5, 1, 23, 59, 59, 999999) and not got.m


def test_still_periods_and_calibration(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(700, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    offset, scale = np.array([0.03, -0.02, 0.01]), np.array([1.02, 0.97, 1.01])
    rows = [("s", *map(float, p), 10) for p in (points - offset) / scale]
    frame = spark.createDataFrame(rows, "subject_id string, x double, y double, z double, n long")
    got = inference.calibrate(frame).first()
    assert got.error_after < 1e-6 < got.error_before and [got.x_offset, got.y_scale] == pytest.approx([0.03, 0.97], abs=1e-4)
    few = inference.calibrate(frame.limit(20)).first()
    assert few.x_scale == 1 and few.error_after < few.error_before
    assert inference.calibration_error(frame).first().rmse == pytest.approx(got.error_before)
    flat = record(spark, [(600, 0.5), (60, None)], step=timedelta(seconds=1)).na.fill({"value": 9.0}).withColumn("missing", F.lit(False))
    axes = flat.drop("channel").withColumn("channel", F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("z"))))
    assert minutes(inference.still_bouts(axes, least=2 * MINUTE)) == [(0, 11)]
    xyz = flat.select("subject_id", "ts", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    still = inference.still_points(xyz, interval(spark, (0, 5), (6, 8)))
    assert sorted(r.n for r in still.collect()) == [120, 300]
    fixed = inference.apply_calibration(xyz, spark.createDataFrame([("s", 0.5, 1.0, 0.0, 1.0, 0.0, 2.0)], "subject_id string, x_offset double, x_scale double, y_offset double, y_scale double, z_offset double, z_scale double"))
    assert tuple(fixed.first())[2:] == (0.5, 0.0, 2.0)


def test_posture_holds_for_ten_seconds():
    rule, us = inference.Posture(), np.arange(60) * SECOND
    pitch = np.where((us >= 5 * SECOND) & (us < 9 * SECOND), 40.0, 0.0) + np.where((us >= 20 * SECOND) & (us < 45 * SECOND), 40.0, 0.0)
    assert rule.classify(us, pitch)[0].tolist() == [0] * 20 + [1] * 25 + [0] * 15


def test_spectra_and_filters(spark):
    t = np.arange(600)
    wave = np.sin(2 * np.pi * 0.1 * t) + 0.5 * np.sin(2 * np.pi * 0.02 * t) + 3
    rows = record(spark, [(1, float(v)) for v in wave], step=timedelta(seconds=1))
    got = spectral.tumbling_spectra(rows, DAY, 1.0, [TopFrequencies(2), FrequencyRanges(((0.05, 0.2),))]).first()
    assert [got.value_topfreq_0, got.value_topfreq_1] == pytest.approx([0.1, 0.02]) and got["value_0.05hz_0.2hz"] == pytest.approx(300, rel=1e-3)
    for high in (False, True):
        b, a = spectral.butterworth(4, 0.05, 1.0, high)
        gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f)) / np.polyval(a, np.exp(2j * np.pi * f)))
        assert gain(0.05) == pytest.approx(2**-0.5) and gain(0.2 if high else 0.005) == pytest.approx(1, abs=0.01) and gain(0.005 if high else 0.2) < 0.01
    smooth = [r.value for r in spectral.low_pass(rows, 0.005, 1.0, 2).orderBy("ts").collect()]
    assert abs(smooth[-1] - 3) < 0.3
    back = [r.value for r in spectral.inverse(spectral.transform(rows)).orderBy("i").collect()]
    assert np.allclose(back, wave)


def test_names_and_dictionary():
    spec = [Generic(("mean", "n")), Cutpoints(((0, 1.5),)), Percentiles((11, 2)), FrequencyRanges(((1, 2),)), TopFrequencies(1)]
    assert names("A", spec) == ["A_mean", "A_n", "A_0_1.5", "A_p11", "A_p2", "A_1hz_2hz", "A_topfreq_0", "A_topmag_0"]
    assert dict(dictionary("A", spec))["A_p11"].startswith("11th") and dict(dictionary("A", spec))["A_p2"].startswith("2nd")


def test_batches_and_cache(spark, tmp_path):
    jobs = spark.createDataFrame([(i,) for i in range(11)], "job int")
    got = [r.shard for r in batch.shards(jobs, "job", 3).orderBy("job").collect()]
    assert got == [1] * 4 + [2] * 4 + [3] * 3

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["job"].iloc[0] == 4:
            raise ValueError("bad job")
        return pdf.assign(v=pdf["job"] * 2.0)

    out = {r.job: r for r in batch.run_guarded(jobs, "job", fn, "job int, v double").collect()}
    assert out[3].v == 6 and out[3].error is None and "bad job" in out[4].error and out[4].v is None
    cache, calls = batch.ResultCache(spark, f"file://{tmp_path}/cache"), []

    def made(n):
        calls.append(n)
        return jobs.limit(n)

    assert [cache.get(made, "jobs", {"n": n}).count() for n in (3, 3, 5)] == [3, 3, 5] and calls == [3, 5]
    assert cache.names() == ["jobs"]
    cache.delete("jobs")
    assert ("jobs", {"n": 3}) not in cache
    batch.write_rows(jobs.limit(2), f"{tmp_path}/rows")
    batch.write_rows(jobs.limit(1), f"{tmp_path}/rows")
    assert batch.consolidate(spark, f"{tmp_path}/rows/*.csv").count() == 3


def test_samples_from_tables_mark_what_is_no_number(spark):
    df = spark.createDataFrame([(1, START, 2.0), (1, START, float("nan")), (1, START, None)], "u int, t timestamp_ntz, v double")
    got = samples_from(df, "u", "t", v="v").collect()
    assert sorted((r.value is None, r.missing) for r in got) == [(False, False), (True, True), (True, True)]


def test_shards_are_exact_beyond_any_sample(spark):
    jobs = spark.range(60_000).selectExpr("format_string('%08d', pmod(xxhash64(id), 90000000)) AS job").distinct()
    sizes = {r.shard: r["count"] for r in batch.shards(jobs, "job", 7).groupBy("shard").count().collect()}
    n = jobs.count()
    assert sizes == {k + 1: n // 7 + (k < n % 7) for k in range(7)}
    ends = batch.shards(jobs, "job", 7).groupBy("shard").agg(F.min("job").alias("a"), F.max("job").alias("b")).orderBy("shard").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))
    few = spark.createDataFrame([("b",), ("a",), (None,)], "job string")
    assert {r.job: r.shard for r in batch.shards(few, "job", 5).collect()} == {None: 1, "a": 2, "b": 3}
    assert batch.shards(few.limit(0), "job", 3).count() == 0


def test_filters_keep_their_state_between_batches():
    b, a = spectral.butterworth(4, 0.2, 10.0, True)
    x, state, want = np.random.default_rng(1).normal(size=700), np.zeros(5), []
    for v in x.tolist():
        y = b[0] * v + state[0]
        state[:-1] = state[1:] + b[1:] * v - a[1:] * y
        want.append(y)
    rule = spectral.Filter(b, a)
    got = np.concatenate([rule(x[i:j]) for i, j in ((0, 200), (200, 201), (201, 201), (201, 700))])
    assert np.allclose(got, want, atol=1e-8)


def test_posture_over_batches_as_over_the_whole():
    rule, rng = inference.Posture(), np.random.default_rng(2)
    for _ in range(100):
        n = int(rng.integers(1, 300))
        us, pitch = np.cumsum(rng.integers(1, 4, n)) * SECOND, np.repeat(rng.choice([10.0, 25.0, 40.0], n), rng.integers(1, 9, n))[:n]
        whole, begin, state, out = rule.classify(us, pitch)[0].tolist(), 0, 0, []
        for end in sorted({*rng.integers(1, n + 1, 3).tolist(), n}):
            found, state, open_ = rule.classify(us[begin:end], pitch[begin:end], state)
            cut = end - begin if end == n else open_
            out += found[:cut].tolist()
            begin += cut
        assert out == whole


def test_calibrated_samples_are_marked(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for i, v in enumerate(rng.normal(size=(40, 3))):
        v = v / np.linalg.norm(v) + [0.03, -0.02, 0.01]
        for k in range(18):
            move = {16: 0.2, 17: -0.2}.get(k, 0.0)
            rows.append(("s", START + timedelta(seconds=5 * (18 * i + k)), *(float(x + move) for x in v)))
    xyz = spark.createDataFrame(rows, "subject_id string, ts timestamp_ntz, x double, y double, z double")
    cache = batch.ResultCache(spark, f"{tmp_path}/cache")
    done, found = inference.auto_calibrated(xyz, cache=cache)
    row = found.first()
    assert row.points == 40 and row.error_after < 0.2 * row.error_before and abs(row.x_offset + 0.03) < 0.02
    assert inference.is_calibrated(done) and not inference.is_calibrated(xyz) and cache.names() == ["calibrate"]
    done.write.parquet(f"{tmp_path}/xyz")
    assert inference.is_calibrated(spark.read.parquet(f"{tmp_path}/xyz"))
    with pytest.raises(ValueError, match="calibrated already"):
        inference.auto_calibrated(done)


def test_jobs_are_dealt_to_all_tasks(spark):
    def where(pdf):
        from pyspark import TaskContext

        if pdf["job"].iloc[0] == "7":
            raise ValueError("no such recording")
        return pdf.assign(task=TaskContext.get().partitionId(), n=len(pdf))[["job", "task", "n"]].head(1)

    jobs = spark.range(80).select((F.col("id") % 40).cast("string").alias("job"))
    got = batch.run_guarded(jobs, "job", where, "job string, task long, n long").collect()
    assert len(got) == 40 and {r.n for r in got if r.error is None} == {2} and [r.job for r in got if r.error] == ["7"]
    assert len({r.task for r in got if r.error is None}) == 4
