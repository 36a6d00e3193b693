"""Queries of readers, writers, clocks, batches, caches and streams.

Each reader's query makes recordings of its device from the events with DataFrame functions (a record is a user, a sample
an event in order of time), decodes them, and is compared with what the events say. Files go to the shared folder.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources

from ..operators import batch, windows
from ..operators import bouts as B
from ..sources import clock, store
from ..sources.text import XLO_COLUMNS, XLO_EMPTY, XLO_SKIPPED
from ..spec import Generic
from ..streaming import live
from .inferred import SQL_POSTURE, pitch
from .registry import events, ntz, query, signal, sql_bouts, working_folder

# Items of a record in order: i from 0, ts, v (the value's whole part).
SQL_ITEMS = "it AS (SELECT 'u' || user_id AS subject_id, ts, value, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
START = "TIMESTAMP '2024-01-01 00:00:00'"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, and items: an array of i, ts, value and v."""
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("all"))
    return rows.selectExpr("concat('u', user_id) AS name", "transform(all, (x, i) -> named_struct('i', i, 'ts', x.ts, 'value', x.value, 'v', cast(floor(x.value) AS bigint))) AS items")


def text_of(spark: SparkSession, sf_dir: str, head: list[str], line: str, joint: str = "\n") -> DataFrame:
    """name, and value: header lines, then a line of text for each item x."""
    first = F.lit("\n".join(head) + "\n")
    return items(spark, sf_dir).select("name", F.concat(first, F.expr(f"array_join(transform(items, x -> {line}), '{joint}')")).alias("value"))


def long_sql(rows: str, *channels: tuple[str, str]) -> str:
    return f"WITH {SQL_ITEMS}, r AS ({rows}) " + " UNION ALL ".join(f"SELECT subject_id, '{c.replace(chr(39), chr(39) * 2)}' AS channel, t AS ts, round({v}, 6) AS value, false AS missing FROM r" for c, v in channels)


ACTIGRAPH = [
    "------------ Data File Created By ActiGraph ------------", "Serial Number: AG77", "Start Time 00:00:00", "Start Date 01/01/2024", "Epoch Period (hh:mm:ss) 00:01:00", "Download Time 10:20:30", "Download Date 03/02/2024", "Current Memory Address: 0",
    "Current Battery Voltage: 4.1     Mode = 1", "--------------------------------------------------",
]


def actigraph(spark, sf_dir):
    return text_of(spark, sf_dir, ACTIGRAPH, "concat(if(x.i % 2 = 0, '', '-'), x.v, ' 7')", " ")


@query(long_sql(f"SELECT *, {START} + i * INTERVAL 1 MINUTE AS t FROM it", ("AG_Counts", "CAST(v AS DOUBLE)")))
def source_actigraph(spark, sf_dir):
    return sources.decode(actigraph(spark, sf_dir), "actigraph")


ACTIHEART = ["Started\t01-Jan-2024  06:30", "Weight\t70", "Start trimmed to\t2024-01-01 06:32", "Time\tActivity\tBPM"]


def actiheart(spark, sf_dir):
    return text_of(spark, sf_dir, ACTIHEART, "concat(date_format(timestamp_seconds(1704090600 + x.i * 30), 'HH:mm:ss'), '\\t', x.v, '\\t', x.v - 50)")


@query(f"""WITH {SQL_ITEMS}, r AS (SELECT *, TIMESTAMP '2024-01-01 06:30:00' + i * INTERVAL 30 SECOND AS t FROM it WHERE i > 4)
SELECT subject_id, 'Chest' AS channel, t AS ts, CAST(v AS DOUBLE) AS value, false AS missing FROM r UNION ALL SELECT subject_id, 'HR', t, CASE WHEN v > 50 THEN CAST(v - 50 AS DOUBLE) ELSE -1 END, v <= 50 FROM r""")
def source_actiheart(spark, sf_dir):
    return sources.decode(actiheart(spark, sf_dir), "actiheart")


@query(long_sql(f"SELECT *, {START} + i * INTERVAL 84375000 MICROSECOND AS t FROM it", ("AP_X", "(v % 256 - 128) / 64.0"), ("AP_Y", "(i % 256 - 128) / 64.0"), ("AP_Z", "(192 - 128) / 64.0")))
def source_activpal_csv(spark, sf_dir):
    head = ["activPAL", "name", "file", "rate 20", "Time,X,Y,Z"]
    return sources.decode(text_of(spark, sf_dir, head, "concat(cast(45292 + x.i * 0.0009765625BD AS decimal(20,10)), ',', x.v % 256, ',', x.i % 256, ',192')"), "activpal_csv")


GENEA = (("GA_X", "v / 100.0"), ("GA_Y", "0 - v / 50.0"), ("GA_Z", "CAST(i AS DOUBLE)"), ("GA_Lux", "CAST(v AS DOUBLE)"), ("GA_Event", "CAST(i % 2 AS DOUBLE)"), ("GA_Temperature", "25.5"))


@query(long_sql("SELECT *, date_trunc('millisecond', ts) AS t FROM it", *GENEA))
def source_geneactiv_csv(spark, sf_dir):
    line = "concat_ws(',', date_format(x.ts, 'yyyy-MM-dd HH:mm:ss:SSS'), x.v / 100, 0 - x.v / 50, x.i, x.v, x.i % 2, 25.5)"
    return sources.decode(text_of(spark, sf_dir, ["h,1"] * 80, line), "geneactiv_csv")


GT3X = ["------------ Data File Created By ActiGraph GT3X+ ActiLife v6 Firmware v2 date format MM/dd/yyyy at 30 Hz  Filter Normal -----------", "Serial Number: GT1", "Start Time 00:00:00", "Start Date 01/02/2024", *["x"] * 7]
GT3X_SQL = long_sql("SELECT *, date_trunc('millisecond', ts) AS t FROM it", ("X", "v / 100.0"), ("Y", "0 - v / 50.0"), ("Z", "CAST(i AS DOUBLE)"))


def gt3x(spark, sf_dir):
    return text_of(spark, sf_dir, GT3X, "concat_ws(',', date_format(x.ts, 'MM/dd/yyyy HH:mm:ss.SSS'), x.v / 100, 0 - x.v / 50, x.i)")


@query(GT3X_SQL)
def source_gt3x_csv(spark, sf_dir):
    return sources.decode(gt3x(spark, sf_dir), "gt3x_csv")


def zipped(recordings: DataFrame, column: str) -> DataFrame:
    """name and content: each recording as the only member of a ZIP archive."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for whole in batch[column]:
                archive = io.BytesIO()
                with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("recording", whole if isinstance(whole, str) else bytes(whole))
                out.append(archive.getvalue())
            yield pd.DataFrame({"name": batch["name"], "content": out})

    return recordings.select("name", column).mapInPandas(pack, "name string, content binary")


@query(GT3X_SQL)
def source_gt3x_zip(spark, sf_dir):
    return sources.decode(zipped(gt3x(spark, sf_dir), "value"), "gt3x_zip")


@query("""WITH r AS (SELECT ts, value, event_id FROM events) SELECT 'value' AS channel, ts, round(value, 6) AS value, false AS missing FROM r UNION ALL SELECT 'event_id', ts, CAST(event_id AS DOUBLE), false FROM r""")
def source_csv(spark, sf_dir):
    """Through real files: written by Spark, read as any CSV."""
    path = working_folder(spark, "csv")
    events(spark, sf_dir).select(F.date_format("ts", "dd/MM/yyyy HH:mm:ss:SSSSSS").alias("when"), "value", "event_id", "event_type").write.csv(path, header=True)
    return sources.load(spark, path, "csv", ignore=("event_type",)).drop("subject_id")


def little(value: str, size: int) -> str:
    """Hexadecimal digits of an integer expression, lowest byte first."""
    return "concat(" + ", ".join(f"lpad(hex(shiftright({value}, {8 * i}) & 255), 2, '0')" for i in range(size)) + ")"


def bytes_of(spark: SparkSession, sf_dir: str, digits: str) -> DataFrame:
    """name and content from an expression of hexadecimal digits over items."""
    return items(spark, sf_dir).select("name", F.expr(f"unhex({digits})").alias("content"))


DATX_HEAD = "00" * 35 + "14" + "00" * 2 + "01" + "00" * 217 + "060708" + "010118" + "060708" + "020118" + "00" * 756


def datx(spark, sf_dir):
    """Every third sample is followed by a marker that repeats it twice."""
    return bytes_of(spark, sf_dir, f"concat('{DATX_HEAD}', array_join(transform(items, x -> concat(hex(100 + x.v % 100), hex(200 - x.v % 50), 'C0', if(x.i % 3 = 0, '000001', ''))), ''), hex('tail'), 'FFFF')")


@query(f"""WITH {SQL_ITEMS}, k AS (SELECT *, unnest(generate_series(0, CASE WHEN i % 3 = 0 THEN 2 ELSE 0 END)) AS k FROM it), r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY i, k) - 1 AS j FROM k)
SELECT subject_id, c AS channel, TIMESTAMP '2024-01-01 06:07:08' + j * INTERVAL 50 MILLISECOND AS ts, round((CASE c WHEN 'X' THEN 100 + v % 100 WHEN 'Y' THEN 200 - v % 50 ELSE 192 END - 128) / 32.0, 6) AS value, false AS missing
FROM r, (SELECT unnest(['X', 'Y', 'Z']) AS c)""")
def source_datx(spark, sf_dir):
    return sources.decode(datx(spark, sf_dir), "datx")


GENEACTIV = ["Device Identity", "Device Unique Serial Code:012345", "Device Type:GENEActiv", "Device Model:1.1", "Device Firmware Version:Ver2.0", "Calibration Date:2013-02-12", *[f"a{i}:b" for i in range(13)], "Measurement Frequency:100,0 Hz", "b:c", "Start Time:2024-01-01 00:00:00:000", *[f"c{i}:d" for i in range(25)]] + [
    "x gain:25600", "x offset:100", "y gain:25600", "y offset:-200", "z gain:25000", "z offset:0", *[f"d{i}:e" for i in range(4)], "Number of Pages:9", "end",
]


def geneactiv(spark, sf_dir):
    """Pages of 30 samples, 0.3 s apart."""
    three = lambda e: f"lpad(hex({e} & 4095), 3, '0')"
    sample = f"concat({three('(x.v - 300)')}, {three('(-x.v)')}, {three('x.i % 2000')}, '000')"
    head = "array_join(array('Recorded Data', 'Device Unique Serial Code:012345', concat('Sequence Number:', p), concat('Page Time:', date_format(timestamp_micros(1704067200000000 + p * 300000), 'yyyy-MM-dd HH:mm:ss:SSS')), 'Unassigned:', 'Temperature:20', 'Battery voltage:4', 'Device Status:Recording', 'Measurement Frequency:100,0'), '\\n')"
    page = f"concat({head}, '\\n', array_join(transform(slice(items, p * 30 + 1, 30), x -> {sample}), ''))"
    first = "\n".join(GENEACTIV) + "\n"
    body = F.expr(f"array_join(transform(sequence(0, cast(ceil(size(items) / 30) AS int) - 1), p -> {page}), '\\n')")
    return items(spark, sf_dir).select("name", F.concat(F.lit(first), body).cast("binary").alias("content"))


@query(long_sql(f"SELECT *, {START} + i * INTERVAL 10 MILLISECOND AS t FROM it", ("X", "((v - 300) * 100 - 100) / 25600.0"), ("Y", "(-v * 100 + 200) / 25600.0"), ("Z", "(i % 2000) * 100 / 25000.0")))
def source_geneactiv(spark, sf_dir):
    return sources.decode(geneactiv(spark, sf_dir), "geneactiv")


def axivity(spark, sf_dir):
    """Pages of 8 samples, one a second; the odd ones with packed samples, the header with an annotation."""
    stamp = "(24L * 67108864 + 4194304 + 131072 + p div 60 * 64 + p % 60)"  # 2024-01-01 00:mm:ss
    plain = f"concat({little('(x.v - 300)', 2)}, {little('x.i', 2)}, '0001')"
    packed = little("((x.v - 300 & 1023) | shiftleft(x.i & 511, 10) | shiftleft(64L, 20) | shiftleft(1L, 30))", 4)
    data = f"array_join(transform(slice(items, p * 8 + 1, 8), x -> if(p % 2 = 0, {plain}, {packed})), '')"
    count = "least(8, size(items) - p * 8)"
    page = f"concat('4158', 'FC01', '0700', '01000000', {little('p', 4)}, {little(stamp, 4)}, {little('(p + 2048)', 2)}, {little('(p + 300)', 2)}, '0000', '4A', if(p % 2 = 0, '32', '30'), '0000', {little(count, 2)}, rpad({data}, 960, '0'), '0000')"
    head = "4D44" + "FC03" + "00" + "0700" + "01000000" + "0000" + "00" * 8 + "00" * 4 + "00" * 7 + "00" * 4 + "4A" + "00" * 4 + "2B" + "00" * 22
    head += "73747564793D37" + "20" * 3  # study=7
    head = head.ljust(2048, "F")
    pages = f"array_join(transform(sequence(0, cast(ceil(size(items) / 8) AS int) - 1), p -> {page}), '')"
    return bytes_of(spark, sf_dir, f"concat('{head}', {pages})")


AXIVITY_SQL = f"""WITH {SQL_ITEMS}, r AS (SELECT *, i // 8 AS p, i % 8 AS j, (n - 1) // 8 AS last FROM it),
a AS (SELECT *, {START} + p * INTERVAL 1 SECOND + CASE WHEN p = last THEN j * INTERVAL 10 MILLISECOND ELSE j * INTERVAL 125 MILLISECOND END AS t, CASE WHEN p % 2 = 0 THEN 1 ELSE 2 END AS e FROM r)
SELECT subject_id, 'X' AS channel, t AS ts, round((v - 300) * e / 256.0, 6) AS value, false AS missing FROM a UNION ALL SELECT subject_id, 'Y', t, round(CASE WHEN e = 1 THEN i ELSE (i & 511) * 2 END / 256.0, 6), false FROM a
UNION ALL SELECT subject_id, 'Z', t, CASE WHEN e = 1 THEN 1.0 ELSE 0.5 END, false FROM a UNION ALL SELECT subject_id, 'Light', {START} + p * INTERVAL 1 SECOND, CAST(p + 2048 AS DOUBLE), false FROM a WHERE j = 0
UNION ALL SELECT subject_id, 'Temperature', {START} + p * INTERVAL 1 SECOND, CAST(p + 300 AS DOUBLE), false FROM a WHERE j = 0"""


@query(AXIVITY_SQL)
def source_axivity(spark, sf_dir):
    return sources.decode(axivity(spark, sf_dir), "axivity")


@query(AXIVITY_SQL)
def source_axivity_zip(spark, sf_dir):
    return sources.decode(zipped(axivity(spark, sf_dir), "content"), "axivity_zip")


XLO = ["Name: a", "x", "x", "Sex: Height: 180 cm Weight: 80 kg".replace("Sex: ", ""), "x", "x", "x", "Date: 01/01/2024 Time: 10:20AM", *["x"] * 7]


def xlo(spark, sf_dir):
    """A row a sample at minute i / 60; each seventh has no BF; some lines are no data."""
    cells = [f"'{XLO_EMPTY}'", "'x'", "concat(x.i div 60, ':', lpad(x.i % 60, 2, '0'))", *["'9'"] * 5]
    cells += [f"if(x.i % 7 = 0, '{XLO_EMPTY}', cast(x.v + {i} AS string))" if name == "BF" else f"cast(x.v + {i} AS string)" for i, name in list(enumerate(XLO_COLUMNS))[XLO_SKIPPED:]]
    return text_of(spark, sf_dir, [*XLO, "T-body\tPmean\tTime", "rest\tx\t0:10"], f"concat_ws('\\t', {', '.join(cells)})")


def _xlo_value(i: int, name: str) -> str:
    return "CASE WHEN i % 7 = 0 THEN 0 ELSE v + 12 END" if name == "BF" else f"(v + {i}) / 80.0" if name in ("V'O2", "V'CO2") else f"CAST(v + {i} AS DOUBLE)"


@query(long_sql(f"SELECT *, {START} + i * INTERVAL 1 SECOND AS t FROM it", *((name, f"CAST({_xlo_value(i, name)} AS DOUBLE)") for i, name in list(enumerate(XLO_COLUMNS))[XLO_SKIPPED:])))
def source_xlo(spark, sf_dir):
    return sources.decode(xlo(spark, sf_dir), "xlo")


_FIELDS = {
    "actigraph": {"serial": "AG77", "start": "2024-01-01 00:00:00", "epoch": "60.0", "download": "2024-02-03 10:20:30", "mode": "1"},
    "actiheart": {"Weight": "70", "start": "2024-01-01 06:30:00", "epoch": "30.0", "data_start": "4", "trimmed": "2024-01-01 06:32:00"},
    "gt3x_csv": {"frequency": "30", "date_format": "MM/dd/yyyy", "start": "2024-01-02 00:00:00"},
    "datx": {"start": "2024-01-01 06:07:08", "end": "2024-01-02 06:07:08", "frequency": "20", "dynamic_range": "1"},
    "geneactiv": {"device_id": "012345", "firmware": "Ver2.0", "calibration_date": "2013-02-12", "frequency": "100.0", "x_gain": "25600.0", "y_offset": "-200.0", "pages": "9"},
    "axivity": {"device_id": "7", "session_id": "1", "frequency": "100.0", "annotation": "study=7", "firmware_version": "43"},
    "xlo": {"start": "2024-01-01 00:00:00", "height": "180.0", "weight": "80.0"},
}


@query(f"""SELECT 'u' || user_id AS subject_id, kind, name, field FROM (SELECT DISTINCT user_id FROM events), (VALUES {', '.join(f"('{k}', '{n}', '{v}')" for k, f in _FIELDS.items() for n, v in f.items())}) AS t(kind, name, field)""")
def source_headers(spark, sf_dir):
    made = {"actigraph": actigraph, "actiheart": actiheart, "gt3x_csv": gt3x, "datx": datx, "geneactiv": geneactiv, "axivity": axivity, "xlo": xlo}
    out = None
    for kind, make in made.items():
        wanted_keys = list(_FIELDS[kind])
        wanted = F.explode(F.map_filter("fields", lambda k, _: k.isin(*wanted_keys))).alias("name", "field")
        own = sources.headers(make(spark, sf_dir), kind).select("subject_id", F.lit(kind).alias("kind"), wanted)
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(1 AS BIGINT) AS channels, CAST(count(*) AS BIGINT) AS samples, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def recording_summary(spark, sf_dir):
    return sources.header(signal(spark, sf_dir).withColumn("subject_id", F.col("subject_id").cast("string")))


@query("SELECT CAST(user_id AS VARCHAR) AS subject_id, 'value' AS channel, ts, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value, false AS missing FROM events")
def sink_samples(spark, sf_dir):
    path = working_folder(spark, "samples")
    store.write_samples(signal(spark, sf_dir), path)
    return sources.load(spark, path, "parquet")


@query("""SELECT CAST(user_id AS VARCHAR) AS id, strftime(min(ts), '%d/%m/%Y %H:%M:%S:%f') AS timestamp, round(avg(value), 6) AS value_mean, CAST(count(*) AS BIGINT) AS value_n FROM events GROUP BY user_id""")
def sink_results(spark, sf_dir):
    """Written as CSV with a header, read with all other shards of a result."""
    path = working_folder(spark, "results")
    store.write_results(windows.summary(signal(spark, sf_dir), [Generic(("mean", "n"))]), f"{path}/1")
    return batch.consolidate(spark, f"{path}/*").select("id", "timestamp", F.col("value_mean").cast("double"), F.col("value_n").cast("long"))


@query(f"WITH {sql_bouts(20, 80)} SELECT CAST(subject_id AS VARCHAR) AS subject_id, start_ts, end_ts FROM bouts")
def sink_bouts(spark, sf_dir):
    path = working_folder(spark, "bouts")
    store.write_bouts(B.bouts(signal(spark, sf_dir), 20, 80), path)
    return store.read_bouts(spark, path)


@query(f"WITH {sql_bouts(20, 80)} SELECT subject_id, start_ts, end_ts, 20 AS low, 'active' AS label FROM bouts")
def sink_bout_table(spark, sf_dir):
    """With attributes beside the table."""
    path = working_folder(spark, "table")
    store.write_table(B.bouts(signal(spark, sf_dir), 20, 80).select(*B.INTERVAL), path, attributes={"low": 20, "label": "active"})
    kept = store.read_attributes(spark, path)
    return store.read_table(spark, path).withColumns({"low": F.lit(kept["low"]), "label": F.lit(kept["label"])})


@query("SELECT 0 AS place, 'id,timestamp,value_mean,value_n' AS line")
def sink_header(spark, sf_dir):
    return spark.createDataFrame([(0, store.result_header(["value_mean", "value_n"]))], "place int, line string")


@query(f"""WITH {SQL_ITEMS}, p AS (SELECT subject_id, i, epoch_us(ts) AS us, lead(i) OVER w AS i2, lead(epoch_us(ts)) OVER w AS us2 FROM it WHERE i % 5 = 0 WINDOW w AS (PARTITION BY subject_id ORDER BY i)),
k AS (SELECT *, unnest(generate_series(i, coalesce(i2 - 1, i))) AS k FROM p) SELECT subject_id, CAST(k AS BIGINT) AS i, make_timestamp(CAST(round(us + (k - i) * coalesce((us2 - us) / (i2 - i), 0)) AS BIGINT)) AS ts FROM k""")
def page_times(spark, sf_dir):
    """Times of all samples from those of every fifth one."""
    rows = items(spark, sf_dir).select(F.col("name").alias("subject_id"), F.explode("items").alias("x"))
    pages = rows.where("x.i % 5 = 0").select("subject_id", F.col("x.i").cast("long").alias("i"), F.col("x.ts").cast("timestamp_ntz").alias("ts"))
    return clock.from_pages(pages, 100.0)


@query(f"SELECT event_id, (epoch_us(ts) - epoch_us({START})) // 1000 AS ms, date_trunc('millisecond', ts) AS back FROM events")
def clock_offsets(spark, sf_dir):
    ms = clock.to_offsets(ntz("2024-01-01 00:00:00"), F.col("ts"))
    return events(spark, sf_dir).select("event_id", ms.alias("ms"), clock.from_offsets(ntz("2024-01-01 00:00:00"), ms).alias("back"))


def job_list(spark, sf_dir):
    """Jobs as a CSV file with a header, read back."""
    path = working_folder(spark, "jobs")
    events(spark, sf_dir).select(F.format_string("%06d", "user_id").alias("job"), F.lit("x").alias("site")).distinct().write.csv(path, header=True)
    return batch.load_jobs(spark, path)


@query("SELECT DISTINCT printf('%06d', user_id) AS job, 'x' AS site FROM events")
def batch_jobs(spark, sf_dir):
    return job_list(spark, sf_dir)


def analysis(pdf: pd.DataFrame) -> pd.DataFrame:
    """Fails for jobs whose number ends in 7."""
    if pdf["job"].iloc[0].endswith("7"):
        raise ValueError("no such recording")
    return pdf.assign(number=pdf["job"].astype(int))[["job", "number"]]


SQL_SHARD = "j AS (SELECT job, ntile(3) OVER (ORDER BY job) AS shard FROM (SELECT DISTINCT printf('%06d', user_id) AS job FROM events)), s AS (SELECT job, ntile(2) OVER (ORDER BY job) AS step FROM j WHERE shard = 2)"


@query(f"WITH {SQL_SHARD} SELECT 2 AS shard, CAST(step AS INTEGER) AS step, CAST(count(*) AS BIGINT) AS jobs, CAST(count(*) FILTER (job LIKE '%7') AS BIGINT) AS failed, step = 2 AS complete FROM s GROUP BY step")
def batch_feedback(spark, sf_dir):
    return batch.run_batch(job_list(spark, sf_dir), "job", analysis, "job string, number long", working_folder(spark, "batch"), 2, 3, steps=2)


@query(f"WITH {SQL_SHARD} SELECT job, CASE WHEN job NOT LIKE '%7' THEN CAST(job AS BIGINT) END AS number, job LIKE '%7' AS failed FROM s")
def batch_results(spark, sf_dir):
    folder = working_folder(spark, "batch")
    batch.run_batch(job_list(spark, sf_dir), "job", analysis, "job string, number long", folder, 2, 3, steps=2)
    return spark.read.parquet(f"{folder}/results").select("job", "number", F.col("error").isNotNull().alias("failed"))


@query("SELECT user_id AS subject_id, CAST(count(*) AS BIGINT) AS n, 'counts' AS cached, true AS again FROM events GROUP BY user_id")
def result_cache(spark, sf_dir):
    """Computed once, then read; another function's results are deleted."""
    cache = batch.ResultCache(spark, working_folder(spark, "cache"))
    count = lambda least: events(spark, sf_dir).where(F.col("value") >= least).groupBy(F.col("user_id").alias("subject_id")).agg(F.count("*").alias("n"))
    cache.get(count, "others", {"least": 5})
    cache.delete("others")
    cache.get(count, "counts", {"least": -1.0})

    def never(least):
        raise ValueError("computed twice")

    return cache.get(never, "counts", {"least": -1.0}).withColumns({"cached": F.lit(",".join(cache)), "again": F.lit(("counts", {"least": -1.0}) in cache)})


def streamed(spark: SparkSession, sf_dir: str, compute) -> DataFrame:
    """What a stream over the events leaves in its sink when all input has been read."""
    folder = working_folder(spark, "stream")
    rows = events(spark, sf_dir)
    rows.write.parquet(f"{folder}/in")  # a stream's source is a folder
    out = compute(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def stream_samples(source: DataFrame) -> DataFrame:
    from ..model import samples_from

    return samples_from(source, "user_id", "ts", value="value")


@query("""WITH m AS (SELECT max(date_trunc('millisecond', ts)) AS now FROM events) SELECT user_id AS subject_id, 'value' AS channel, time_bucket(INTERVAL 6 HOUR, ts) AS ts, round(avg(value), 6) AS value_mean, CAST(count(*) AS BIGINT) AS value_n
FROM events, m WHERE time_bucket(INTERVAL 6 HOUR, events.ts) + INTERVAL 6 HOUR <= now - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    return streamed(spark, sf_dir, lambda source: live.tumbling(stream_samples(source), "6 hours", "1 hour", [Generic(("mean", "n"))]))


@query("""WITH m AS (SELECT max(date_trunc('millisecond', ts)) AS now FROM events), g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS subject_id, min(ts) AS start_ts, max(ts) + INTERVAL 6 HOUR AS end_ts, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT now - INTERVAL 1 HOUR FROM m)""")
def stream_sessions(spark, sf_dir):
    return streamed(spark, sf_dir, lambda source: live.sessions(stream_samples(source), "6 hours", "1 hour"))


@query(f"WITH {SQL_POSTURE} SELECT subject_id, begin AS ts, CAST(state AS INTEGER) AS posture FROM t")
def stream_posture(spark, sf_dir):
    """Changes of posture in a stream of written samples of pitch."""
    from ..model import instant

    folder = working_folder(spark, "stream")
    pitch(spark, sf_dir).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    out = live.posture_changes(source, 10.0, 10.0, 0.0)
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("subject_id", instant("us").alias("ts"), "posture")


