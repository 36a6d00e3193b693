import struct
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline import sources
from strideline.sources import binary, store, text

START = datetime(2020, 3, 1, 23, 59, 30)


def rows(df, channel):
    return [(r.ts, r.value) for r in df.where(F.col("channel") == channel).orderBy("ts").collect()]


def test_actigraph(spark, tmp_path):
    head = ["Data File", "Serial Number: X1", "Start Time 23:59:30", "Start Date 01/03/2020", "Epoch Period (hh:mm:ss) 00:00:10", "Download Time 10:00:00", "Download Date 02/03/2020", "Memory", "Battery 4  Mode = 1", "-----"]
    (tmp_path / "a1.dat").write_text("\n".join([*head, "5 1 -7 1", "9 1", "", "99 99"]))
    df = sources.load(spark, f"{tmp_path}/a1.dat")
    assert rows(df, "AG_Counts") == [(START + timedelta(seconds=10 * i), v) for i, v in enumerate((5, 7, 9))]
    assert df.first().subject_id == "a1"
    (tmp_path / "b.dat").write_text("\n".join([*head[:8], "Mode = 2", "-", "1"]))
    with pytest.raises(Exception, match="count mode 2"):
        sources.load(spark, f"{tmp_path}/b.dat").collect()


def test_other_text_formats(spark, tmp_path):
    body = "Weight,70\nTime,Activity,HR\n23:59:30,4,60\n00:00:00,5,0\n00:00:30,6,70\n"
    (tmp_path / "h.txt").write_text("Started,01-Mar-2020\n" + body)
    df = sources.load(spark, f"{tmp_path}/h.txt", "actiheart")
    assert [v for _, v in rows(df, "Chest")] == [4, 5, 6] and [t for t, _ in rows(df, "HR")] == [START + timedelta(seconds=30 * i) for i in range(3)]
    assert df.where("missing").count() == 1
    (tmp_path / "t.txt").write_text("Started,01-Mar-2020  12:34\nStart trimmed to,2020-03-01 12:34\n" + body)
    got = rows(sources.load(spark, f"{tmp_path}/t.txt", "actiheart"), "Chest")
    assert got == [(datetime(2020, 3, 1, 12, 34, 30 * i % 60) + timedelta(minutes=30 * i // 60), 4.0 + i) for i in (1, 2)]
    (tmp_path / "p.csv").write_text("a,b\nTime,X,Y,Z\n43891.5,192,128,64\n43891.500011574074,129,128,126\n")
    df = sources.load(spark, f"{tmp_path}/p.csv", "activpal_csv")
    assert rows(df, "AP_X") == [(datetime(2020, 3, 1, 12), 1.0), (datetime(2020, 3, 1, 12, 0, 1), 1 / 64)]
    (tmp_path / "g.csv").write_text("h\n" * 80 + "2020-03-01 23:59:30:500,0.1,0.2,0.3,12,1,25.5\n")
    assert rows(sources.load(spark, f"{tmp_path}/g.csv", "geneactiv_csv"), "GA_Temperature") == [(START + timedelta(milliseconds=500), 25.5)]
    raw = "------ Data File Created By ActiGraph date format dd/MM/yyyy at 30 Hz\n" + "x\n" * 10 + "01/03/2020 23:59:30.033,0.5,-1,0\n"
    (tmp_path / "r.csv").write_text(raw)
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.csv", raw)
    for kind, name in (("gt3x_csv", "r.csv"), ("gt3x_zip", "r.zip")):
        assert rows(sources.load(spark, f"{tmp_path}/{name}", kind), "Y") == [(START + timedelta(milliseconds=33), -1.0)]
    (tmp_path / "c.csv").write_text("when,a,b,c\n01/03/2020 23:59:30:000001,1,x,3\n")
    df = sources.load(spark, f"{tmp_path}/c.csv", ignore=("c",), unique_names=True)
    assert {(r.channel, r.value, r.missing) for r in df.collect()} == {("c_a", 1.0, False), ("c_b", None, True)}
    head = ["Name: a", "b", "c", "Height: 180 cm Weight: 80 kg", "d", "e", "f", "Date: 01/03/2020 Time: 10:00AM", *["g"] * 7, "T-body\tPmean\tTime"]
    line = lambda clock, *cells: "\t".join(["   -    ", "p", clock, *["x"] * 5, *cells])
    empty = ["   -    "] * 24
    (tmp_path / "x.txt").write_text("\n".join([*head, line("00:10", *map(str, range(800, 824))), line("1:20", *empty), "other\t1"]))
    df = sources.load(spark, f"{tmp_path}/x.txt", "xlo")
    assert rows(df, "V'O2") == [(datetime(2020, 3, 1, 0, 0, 10), 806 / 80), (datetime(2020, 3, 1, 0, 1, 20), 0.0)]
    assert rows(df, "VDe/VT")[0][1] == 823 and df.select("channel").distinct().count() == 24 and df.where("channel = 'Load'").count() == 0


def datx_head(seconds):
    head = bytearray(1024)
    end = START + timedelta(seconds=seconds)
    for at, t in ((256, START), (262, end)):
        head[at : at + 6] = bytes([t.hour, t.minute, t.second, t.day, t.month, t.year - 2000])
    head[35], head[38] = 20, 1
    return bytes(head)


def test_datx_runs_and_tail(spark, tmp_path):
    body = bytes([192, 128, 64, 0, 0, 2, 129, 128, 128, 0, 0, 0])
    for name, tail in (("d", b"tail" + b"zzz"), ("e", b"taizzz")):
        (tmp_path / f"{name}.datx").write_bytes(datx_head(9) + body + tail)
    got = rows(sources.load(spark, f"{tmp_path}/d.datx"), "X")
    assert [v for _, v in got] == [2.0] * 4 + [1 / 32] * 2 and got[1][0] == START + timedelta(milliseconds=50)
    assert len(rows(sources.load(spark, f"{tmp_path}/e.datx"), "X")) == 8  # not the footer, but two samples
    (tmp_path / "s.datx").write_bytes(datx_head(1) + bytes([192, 128, 64, 0, 0, 200]))
    assert len(rows(sources.load(spark, f"{tmp_path}/s.datx"), "X")) == 20  # up to the end time
    fields = sources.headers(binary.binary_files(spark, f"{tmp_path}/s.datx"), "datx").first().fields
    assert fields == {"start": "2020-03-01 23:59:30", "end": "2020-03-01 23:59:31", "frequency": "20", "dynamic_range": "1"}


def page(at, values, packed, device, shift=0, light=2348):
    data = b"".join(struct.pack("<3h", *v) for v in values) if not packed else b"".join(struct.pack("<I", (v[0] & 1023) | (v[1] & 1023) << 10 | (v[2] & 1023) << 20 | 1 << 30) for v in values)
    stamp = (at.year - 2000) << 26 | at.month << 22 | at.day << 17 | at.hour << 12 | at.minute << 6 | at.second
    out = b"AX" + struct.pack("<HHIIIHHBBBBhH", 508, device, 0, 0, stamp, light, 300, 0, 0, 0x4A, 0x30 if packed else 0x32, shift, len(values)) + data
    out = out.ljust(510, b"\0")
    return out + struct.pack("<H", -sum(struct.unpack("<255H", out)) & 0xFFFF)


@pytest.mark.parametrize("packed", [False, True])
def test_axivity(spark, tmp_path, packed):
    size = 120 if packed else 80
    one = [(256, -256, 128)] * size
    content = b"MD" + bytes(510) + page(START, one, packed, 7) + page(START + timedelta(seconds=1), one, packed, 0x8000 | 16384)
    (tmp_path / "w.cwa").write_bytes(content)
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("w.cwa", content)
    for kind, name in (("infer", "w.cwa"), ("axivity_zip", "w.zip")):
        df = sources.load(spark, f"{tmp_path}/{name}", kind)
        got = rows(df, "Y")
        assert len(got) == 2 * size and {v for _, v in got} == {-2.0 if packed else -1.0} and got[0][0] == START
        assert all(a < b for (a, _), (b, _) in zip(got, got[1:], strict=False))
        assert len(rows(df, "Light")) == 2 and rows(df, "Light")[0] == (START, 2348.0) and rows(df, "Temperature")[1][1] == 300.0


def test_geneactiv_bin(spark, tmp_path):
    head = ["h"] * 47 + ["x gain:100", "x offset:0", "y gain:100", "y offset:0", "z gain:50", "z offset:100", *["h"] * 6]
    sample = format((1 << 36) | ((4095) << 24) | (2 << 12), "012x")
    pages = []
    for i in range(2):
        stamp = (START + timedelta(seconds=3 * i)).strftime("%Y-%m-%d %H:%M:%S:000")
        pages += ["Recorded Data", "Serial:1", f"Sequence:{i}", f"Page Time:{stamp}", "Unassigned:", "Temperature:20", "Battery:4", "Status:Recording", "Measurement Frequency:100,0", sample * 300]
    (tmp_path / "g.bin").write_text("\n".join([*head, *pages]))
    df = sources.load(spark, f"{tmp_path}/g.bin")
    x, y, z = (rows(df, a) for a in "XYZ")
    assert len(x) == 600 and {v for _, v in x} == {1.0} and {v for _, v in y} == {-1.0} and {v for _, v in z} == {2.0}
    assert x[300][0] == START + timedelta(seconds=3) and x[599][0] == START + timedelta(seconds=5.99)


def test_store_results_and_bouts(spark, tmp_path):
    samples = spark.createDataFrame([("s1", "a", START, 1.5, False), ("s2", "a", START, None, True)], "subject_id string, channel string, ts timestamp_ntz, value double, missing boolean")
    store.write_samples(samples, f"{tmp_path}/store")
    assert sorted(tuple(r) for r in sources.load(spark, f"{tmp_path}/store", "parquet").collect()) == sorted(tuple(r) for r in samples.collect())
    bouts = spark.createDataFrame([("s1", START, START + timedelta(microseconds=5))], "subject_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    store.write_bouts(bouts, f"{tmp_path}/bouts")
    assert store.read_bouts(spark, f"{tmp_path}/bouts").collect() == bouts.collect()
    store.write_results(samples.withColumn("value_mean", F.lit(2.5)), f"{tmp_path}/out", ["value_mean"])
    got = spark.read.csv(f"{tmp_path}/out", header=True)
    assert ",".join(got.columns) == store.result_header(["value_mean"]) and got.first().timestamp == "01/03/2020 23:59:30:000000"
    assert sources.header(samples).where("subject_id = 's1'").first().samples == 1
    with pytest.raises(ValueError, match="no reader"):
        sources.load(spark, "x.doc")


def test_store_has_no_folder_for_each_subject(spark, tmp_path):
    rows = [(f"{i:03}", "a", START + timedelta(days=d), float(i), False) for i in range(300) for d in range(3)]
    samples = spark.createDataFrame(rows, "subject_id string, channel string, ts timestamp_ntz, value double, missing boolean")
    store.write_samples(samples, f"{tmp_path}/store")
    store.write_samples(samples.select(F.lit(7).alias("subject_id"), "channel", "ts", "value", "missing").limit(1), f"{tmp_path}/store")
    assert len(list((tmp_path / "store").rglob("*.parquet"))) <= 8
    got = sources.load(spark, f"{tmp_path}/store", "parquet")
    assert sorted(tuple(r) for r in got.where("subject_id <> '7'").collect()) == rows and got.where("subject_id = '7'").count() == 1
    samples.write.partitionBy("subject_id").parquet(f"{tmp_path}/folders")
    assert store.read_samples(spark, f"{tmp_path}/folders").count() == 900  # as stores were before


def test_bout_files_have_no_folder_for_each_subject(spark, tmp_path):
    names = [" 7", "007", 'a,"b" ', *map(str, range(8, 100))]
    rows = sorted((n, START + timedelta(days=d), START + timedelta(days=d, microseconds=1)) for n in names for d in range(2))
    bouts = spark.createDataFrame(rows, "subject_id string, start_ts timestamp_ntz, end_ts timestamp_ntz").repartition(4)
    for by_subject, most in ((False, 4), (True, len(names))):
        store.write_bouts(bouts, f"{tmp_path}/{by_subject}", by_subject=by_subject)
        assert len(list((tmp_path / str(by_subject)).rglob("*.csv"))) <= most
        assert sorted(tuple(r) for r in store.read_bouts(spark, f"{tmp_path}/{by_subject}").collect()) == rows


def test_short_recordings_share_arrow_batches():
    head = ["Name: a", "b", "c", "Height: 180 cm Weight: 80 kg", "d", "e", "f", "Date: 01/03/2020 Time: 10:00AM", *["g"] * 7]
    recording = "\n".join([*head, *("\t".join(["   -    ", "p", f"0:{s}", *["x"] * 5, *map(str, range(24))]) for s in range(3))])
    got = list(text.gathered(block for i in range(200) for block in text.parse_xlo(f"s{i}", recording)))
    assert len(got) == 1 and got[0].num_rows == 200 * 24 * 3
    assert got[0].slice(3 * (24 * 7 + 5) + 1, 1).to_pylist() == [{"subject_id": "s7", "channel": "V'E", "us": text.as_us(datetime(2020, 3, 1, 0, 0, 1)), "value": 5.0, "missing": False}]
    whole = text.frame("s", "a", np.arange(text.BLOCK), np.full(text.BLOCK, np.nan))
    assert [(x.num_rows, x["missing"].to_pylist()[0]) for x in text.gathered([whole, whole, text.frame("s", "b", [1], [2])])] == [(text.BLOCK, True), (text.BLOCK, True), (1, False)]
    assert not list(text.gathered([]))


def test_page_times_are_spread_evenly():
    got = binary.spaced(np.array([0.0, 1000.0]), np.array([0, 4]), np.arange(6), 250)
    assert got.tolist() == [0, 250, 500, 750, 1000, 1250]
    assert binary.axivity_time(0) is None


def test_pages_and_offsets(spark):
    from strideline.sources import clock

    start = datetime(2000, 1, 1)
    at = [*range(0, 1000, 100), 999]
    pages = spark.createDataFrame([("s", i, start + timedelta(milliseconds=10 * i)) for i in at], "subject_id string, i int, ts timestamp_ntz")
    got = clock.from_pages(pages, 100.0, 1005).orderBy("i").collect()
    assert [(r.i, r.ts) for r in got] == [(i, start + timedelta(milliseconds=10 * i)) for i in range(1005)]
    row = pages.select(clock.to_offsets(F.lit(start), F.col("ts")).alias("ms"), "ts").withColumn("back", clock.from_offsets(F.lit(start), F.col("ms")))
    assert row.where("back <> ts").count() == 0 and row.agg(F.max("ms")).first()[0] == 9990


def test_envelopes_and_tones(spark):
    import io
    import wave

    from strideline.sources import media

    rows = [("s", "a", START + timedelta(seconds=i), float(i), False) for i in range(100)]
    samples = spark.createDataFrame(rows, "subject_id string, channel string, ts timestamp_ntz, value double, missing boolean")
    got = media.envelope(samples, 10).orderBy("ts").collect()
    assert len(got) == 10 and (got[0].low, got[-1].high) == (0, 99) and sum(r.mean for r in got) / 10 == pytest.approx(49.5, abs=0.5)
    with wave.open(io.BytesIO(media.tone(np.arange(5)))) as file:
        assert file.getnframes() == 5 * 441


def test_axivity_pages_in_sequence_give_the_local_frequency():
    pages = np.zeros(4, binary.PAGE)
    pages["sequence"], pages["count"], pages["rate"], pages["offset"] = [5, 6, 7, 9], 100, 0x4A, [0, 10, 10, 10]
    clock = np.array([0, 2_000_000, 4_000_000, 9_000_000], float)
    # 110 samples in 2 s, then 100 in 2 s; after the break the nominal 100 Hz.
    want = [0, 2e6 - 10 / 55 * 1e6, 4e6 - 10 / 50 * 1e6, 9e6 - 10 / 100 * 1e6]
    assert binary.axivity_marks(pages, clock).tolist() == pytest.approx(want, abs=1)


def test_axivity_blocks_of_plain_and_packed_pages():
    rng = np.random.default_rng(5)
    pages = np.zeros(60, binary.PAGE)
    pages["tag"], pages["length"], pages["rate"], pages["sequence"] = b"AX", 508, 0x4A, np.arange(60)
    pages["stamp"] = 24 << 26 | 1 << 22 | 1 << 17 | np.arange(60)
    pages["kind"], pages["count"], pages["data"] = rng.choice([0x30, 0x32], 60), rng.integers(0, 81, 60), rng.integers(0, 256, (60, 480))
    want = []
    for p in pages:
        for j in range(int(p["count"])):
            if p["kind"] == 0x32:
                want.append([v / 256 for v in struct.unpack("<3h", p["data"][6 * j : 6 * j + 6].tobytes())])
            else:
                (word,) = struct.unpack("<I", p["data"][4 * j : 4 * j + 4].tobytes())
                want.append([(((word >> 10 * k & 1023) ^ 512) - 512) * 2 ** (word >> 30) / 256 for k in range(3)])
    for at in (slice(None), pages["kind"] == 0x30, slice(3, 4)):
        assert binary._axivity_block(pages[at]).shape == (int(pages[at]["count"].sum()), 3)
    assert binary._axivity_block(pages).tolist() == want
    got = list(text.gathered(b for i in range(100) for b in binary.decode_axivity(f"s{i}", pages[:5].tobytes())))
    assert len(got) == 1 and got[0].num_rows == 100 * (3 * int(pages[:5]["count"].sum()) + 10)


def test_headers_and_generated_recordings(spark):
    head = "\n".join(["Data File", "Serial Number: X1", "Start Time 23:59:30", "Start Date 01/03/2020", "Epoch Period (hh:mm:ss) 00:00:10", "Download Time 10:00:00", "Download Date 02/03/2020", "M", "Mode = 1", "-"])
    got = sources.headers(spark.createDataFrame([("a", head)], "name string, value string"), "actigraph").first()
    assert got.subject_id == "a" and got.fields["serial"] == "X1" and got.fields["epoch"] == "10.0"
    with pytest.raises(ValueError, match="unknown kind"):
        sources.decode(spark.createDataFrame([("a", head)], "name string, value string"), "odd")
    for kind in (*sources.TEXTS, *sources.BYTES):
        empty = spark.createDataFrame([], "name string, value string, content binary")
        assert sources.decode(empty, kind).count() == 0


def test_attributes_beside_a_table(spark, tmp_path):
    df = spark.range(3)
    store.write_table(df, f"{tmp_path}/t", attributes={"a": 1.5, "b": "x", "c": [1, 2]})
    assert store.read_attributes(spark, f"{tmp_path}/t") == {"a": 1.5, "b": "x", "c": [1, 2]} and store.read_table(spark, f"{tmp_path}/t").count() == 3
