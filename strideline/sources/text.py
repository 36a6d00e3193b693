"""Text recordings: Actigraph counts, Actiheart, activPAL, GeneActiv and GT3X+ CSV, generic CSV and XLO tables.

A parser takes a recording's name and text and yields samples and a header; readers apply it to files, or to a table of
recordings (name, value). Formats whose header sets the clock are parsed by file; formats whose lines carry their own
time are read line by line, so their files can be split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import pin_utc

#: Samples in one Arrow batch of a reader: short recordings share one, as each has a cost of its own.
BLOCK = 1 << 17
SAMPLE_SCHEMA = "subject_id string, channel string, us long, value double, missing boolean"
#: Modes of count files and how many numbers stand for one epoch. Fixed values.
COUNT_MODES = {0: 1, 1: 2, 3: 2, 4: 2, 5: 3}
#: Columns of cardio-pulmonary tables, and how many at the start aren't read. Fixed values.
XLO_COLUMNS = [
    "T-body", "Pmean", "Time", "t-ph", "RPM", "Load", "Speed", "Elev.", "VTex", "VTin", "t-ex", "t-in", "BF", "V'E", "V'O2", "V'CO2", "RER", "FIO2", "FICO2", "FEO2", "FECO2", "FETO2", "FETCO2", "PEO2",
    "PECO2", "PETO2", "PETCO2", "EqO2", "EqCO2", "VDe", "VDc/VT", "VDe/VT",
]
XLO_SKIPPED, XLO_HEADER, XLO_EMPTY = 8, 15, "   -    "
#: A file's name without its extension.
STEM = r"^(.*?)(?:\.[^.]*)?$"


def as_us(t: datetime) -> int:
    return round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


class Block(NamedTuple):
    """Samples of one subject and channel."""

    subject: str
    channel: str
    us: np.ndarray
    values: np.ndarray
    missing: np.ndarray


def frame(subject: str, channel: str, us, values, missing=None) -> Block:
    values = np.asarray(values, float)
    return Block(subject, channel, np.asarray(us, np.int64), values, np.isnan(values) if missing is None else np.asarray(missing, bool))


def _joined(blocks: list[Block]) -> pa.RecordBatch:
    sizes = [len(x.us) for x in blocks]
    spread = pa.array(np.repeat(np.arange(len(blocks)), sizes))
    names = [pa.array(x, pa.string()).take(spread) for x in ([b.subject for b in blocks], [b.channel for b in blocks])]
    return pa.RecordBatch.from_arrays([*names, *(pa.array(np.concatenate(x)) for x in list(zip(*blocks, strict=True))[2:])], ["subject_id", "channel", "us", "value", "missing"])


def gathered(blocks: Iterable[Block]) -> Iterator[pa.RecordBatch]:
    """Blocks of samples in batches of BLOCK samples or one block; a recording's own blocks are short where it is."""
    held, size = [], 0
    for block in blocks:
        if held and size + len(block.us) > BLOCK:
            yield _joined(held)
            held, size = [], 0
        held.append(block)
        size += len(block.us)
    if held:
        yield _joined(held)


def finished(rows: DataFrame) -> DataFrame:
    return rows.select("subject_id", "channel", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), F.when(~F.isnan("value"), F.col("value")).alias("value"), "missing")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """name (without extension) and value (the whole text) of files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), STEM, 1).alias("name"), "value")


def parsed(files: DataFrame, parse: Callable[[str, str], Iterator[Block]]) -> DataFrame:
    """Samples that parse(subject, text) gives for each recording (name, value); a recording is one task's work."""
    return read_whole(files.select(F.col("name").cast("string"), "value"), parse)


def read_whole(files: DataFrame, read: Callable[..., Iterator[Block]]) -> DataFrame:
    """Samples that read(subject, whole) gives for each recording, a row of a name and the whole of it."""
    pin_utc(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(block for batch in batches for name, whole in zip(*batch.columns, strict=True) for block in read(name.as_py(), whole.as_py()))

    return finished(files.mapInArrow(run, SAMPLE_SCHEMA))


def _clock(text: str) -> timedelta:
    h, m, s = (int(x) for x in text.split(":"))
    return timedelta(hours=h, minutes=m, seconds=s)


def actigraph_header(lines: list[str], date_format: str = "%d/%m/%Y") -> dict:
    """Fields of the ten header lines of a count file."""
    tail = lambda i: lines[i].split()[-1]
    mode = re.search(r"Mode\s*=\s*(\d+)", lines[8])
    return {
        "version": lines[0].replace("-", "").strip(), "serial": tail(1), "start": datetime.strptime(f"{tail(3).replace('-', '/')} {tail(2)}", f"{date_format} %H:%M:%S"), "epoch": _clock(tail(4)),
        "download": datetime.strptime(f"{tail(6).replace('-', '/')} {tail(5)}", f"{date_format} %H:%M:%S"), "mode": int(mode[1]) if mode else 0,
    }


def parse_actigraph(subject: str, text: str, date_format: str = "%d/%m/%Y") -> Iterator[Block]:
    """Counts of a .dat file, one channel AG_Counts: every second or third number by mode, without sign, up to an empty line."""
    lines = text.splitlines()
    head = actigraph_header(lines[:10], date_format)
    if head["mode"] not in COUNT_MODES:
        raise ValueError(f"count mode {head['mode']} isn't known")
    body: list[str] = []
    for line in lines[10:]:
        if not line.strip():
            break
        body += line.split()
    values = np.abs(np.array(body[:: COUNT_MODES[head["mode"]]], float))
    step = round(head["epoch"] / timedelta(microseconds=1))
    yield frame(subject, "AG_Counts", as_us(head["start"]) + step * np.arange(len(values)), values)


def actiheart_header(lines: list[str]) -> dict:
    """Fields of an Actiheart export, with start, epoch and the index of the first row of data.

    Recording starts at the date and time of `Started`, or at the first row's clock time where that has a date only.
    """
    probe = [re.split(r"[\t,]", x.strip()) for x in lines[:30]]
    field = {p[0].strip().rstrip(":"): p[1].strip() for p in probe if len(p) > 1 and ":" not in p[0].strip().rstrip(":")}
    first = next(i for i, p in enumerate(probe) if p[0].strip() == "Time") + 1
    clocks = [_clock(re.split(r"[\t,]", x.strip())[0]) for x in lines[first : first + 2] if x.strip()]
    date, *time = field["Started"].split()
    start = datetime.strptime(date, "%d-%b-%Y")
    start += _clock(f"{time[0]}:0" if time[0].count(":") == 1 else time[0]) if time else clocks[0]
    epoch = (clocks[1] - clocks[0]) % timedelta(days=1) if len(clocks) > 1 else timedelta(minutes=1)
    trimmed = field.get("Start trimmed to")
    return field | {"start": start, "epoch": epoch, "data_start": first, "trimmed": datetime.strptime(trimmed, "%Y-%m-%d %H:%M") if trimmed else None}


def parse_actiheart(subject: str, text: str) -> Iterator[Block]:
    """Chest activity and heart rate; a heart rate of 0 or less is missing. Rows up to a `Start trimmed to` time are left out."""
    lines = text.splitlines()
    head = actiheart_header(lines)
    rows = [re.split(r"[\t,]", x.strip()) for x in lines[head["data_start"] :] if x.strip()]
    us = as_us(head["start"]) + round(head["epoch"] / timedelta(microseconds=1)) * np.arange(len(rows))
    keep = us > as_us(head["trimmed"]) if head["trimmed"] else np.ones(len(rows), bool)
    chest, hr = (np.array([float(r[i]) for r in rows]) for i in (1, 2))
    yield frame(subject, "Chest", us[keep], chest[keep])
    yield frame(subject, "HR", us[keep], np.where(hr > 0, hr, -1)[keep], (hr <= 0)[keep])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """name and value of the lines of files, which may be split between tasks."""
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), STEM, 1).alias("name"), "value")


def lines_of(files: DataFrame) -> DataFrame:
    """name and value of the lines of recordings that a table has whole."""
    return files.select("name", F.explode(F.split("value", "\r?\n")).alias("value"))


def _channels(rows: DataFrame, ts: Column, channels: dict[str, Column]) -> DataFrame:
    """Long samples from one row a time; what isn't a number is missing. Lines without a time, such as headers, are none."""
    pin_utc(rows.sparkSession)
    pairs = F.array(*(F.struct(F.lit(n).alias("channel"), c.try_cast("double").alias("value")) for n, c in channels.items()))
    long = rows.select(F.col("name").alias("subject_id"), ts.alias("ts"), F.explode(pairs).alias("x")).where(F.col("ts").isNotNull())
    return long.select("subject_id", "x.channel", "ts", F.when(~F.isnan("x.value"), F.col("x.value")).alias("value"), (F.col("x.value").isNull() | F.isnan("x.value")).alias("missing"))


def decode_activpal_csv(lines: DataFrame, separator: str = ",") -> DataFrame:
    """AP_X, AP_Y, AP_Z in g from lines of a serial day since 1899-12-30 and three readings about 128."""
    part = F.split("value", separator)
    serial = F.when(F.col("value").rlike(r"^\s*[0-9]+\.?[0-9]*\s*" + separator), F.get(part, F.lit(0)).try_cast("decimal(25,15)"))
    us = F.round((serial - 25569) * 86_400_000_000).cast("long")
    axis = lambda i: (F.get(part, F.lit(i)).try_cast("double") - 128) / 64
    return _channels(lines, F.timestamp_micros(us).cast("timestamp_ntz"), {"AP_X": axis(1), "AP_Y": axis(2), "AP_Z": axis(3)})


def decode_geneactiv_csv(lines: DataFrame) -> DataFrame:
    """GA_X, GA_Y, GA_Z, GA_Lux, GA_Event and GA_Temperature of the lines that begin with a time; header lines don't."""
    part = F.split("value", ",")
    stamp = F.regexp_replace(F.trim(F.get(part, F.lit(0))), r":(\d{3})$", ".$1")
    ts = F.when(stamp.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}$"), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSS"))).cast("timestamp_ntz")
    names = ["GA_X", "GA_Y", "GA_Z", "GA_Lux", "GA_Event", "GA_Temperature"]
    return _channels(lines, ts, {n: F.get(part, F.lit(i + 1)) for i, n in enumerate(names)})


def gt3x_header(lines: list[str]) -> dict:
    """Start, sampling frequency and date order of a raw export's first lines."""
    form, rate = re.search(r"format (\S+)", lines[0]), re.search(r"(\d+) Hz", lines[0])
    pattern = (form[1] if form else "dd/MM/yyyy").replace("dd", "%d").replace("MM", "%m").replace("yyyy", "%Y")
    day, clock = (next((x.split()[-1] for x in lines if x.startswith(key)), None) for key in ("Start Date", "Start Time"))
    start = datetime.strptime(f"{day} {clock}", f"{pattern} %H:%M:%S") if day and clock else None
    return {"frequency": int(rate[1]) if rate else None, "date_format": form[1] if form else "dd/MM/yyyy", "start": start}


def decode_gt3x_csv(lines: DataFrame) -> DataFrame:
    """X, Y, Z of the lines `timestamp,x,y,z`; header lines have no such form.

    Dates are day first unless a recording's header says otherwise: its order is joined to its lines, one row a recording.
    """
    form = F.regexp_extract("value", r"date format (\S+)", 1)
    orders = lines.where(form != "").groupBy("name").agg(F.min(form).alias("form"))
    rows = lines.where(F.col("value").rlike(r"^\d+[/-]\d+[/-]\d+ \d+:\d+:[\d.]+,")).join(orders, "name", "left")
    part, digits = F.split("value", ","), F.regexp_extract_all("value", F.lit(r"\d+"), F.lit(0))
    place = lambda letter: F.instr(F.coalesce("form", F.lit("dd/MM/yyyy")), letter)
    rank = lambda a, b, c: (F.when(place(a) > place(b), 1).otherwise(0) + F.when(place(a) > place(c), 1).otherwise(0)).cast("int")
    date = [F.get(digits, rank(*x)) for x in (("y", "M", "d"), ("M", "y", "d"), ("d", "y", "M"))]
    clock = F.regexp_extract("value", r"^\S+ ([\d:.]+)", 1)
    ts = F.try_to_timestamp(F.concat(F.concat_ws("-", *date), F.lit(" "), clock)).cast("timestamp_ntz")
    return _channels(rows, ts, {axis: F.get(part, F.lit(i + 1)) for i, axis in enumerate("XYZ")})


def read_csv(spark: SparkSession, path: str, datetime_format: str = "dd/MM/yyyy HH:mm:ss:SSSSSS", datetime_column: str | None = None, ignore: tuple[str, ...] = (), unique_names: bool = False) -> DataFrame:
    """Any CSV with a header: a channel for each column but that of time (the first) and those to ignore.

    With unique_names the file's name is put before channel names.
    """
    table = spark.read.csv(path, header=True)
    return decode_csv(table.withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), STEM, 1)), datetime_format, datetime_column or table.columns[0], ignore, unique_names)


def decode_csv(table: DataFrame, datetime_format: str = "dd/MM/yyyy HH:mm:ss:SSSSSS", datetime_column: str | None = None, ignore: tuple[str, ...] = (), unique_names: bool = False) -> DataFrame:
    """Samples of a table of strings with a name: a channel for each column but the time's (the first one unless given)."""
    when = datetime_column or next(c for c in table.columns if c != "name")
    names = [c for c in table.columns if c not in (when, "name", *ignore)]
    long = _channels(table, F.try_to_timestamp(F.col(f"`{when}`"), F.lit(datetime_format)).cast("timestamp_ntz"), {n: F.col(f"`{n}`") for n in names})
    return long.withColumn("channel", F.concat_ws("_", "subject_id", "channel")) if unique_names else long


def xlo_header(lines: list[str]) -> dict:
    """Day, height in cm and weight in kg from the header's eighth and fourth line."""
    _, height, weight = lines[3].strip().split(":")[:3]
    return {"start": datetime.strptime(lines[7].split()[1], "%d/%m/%Y"), "height": float(height.split()[0]), "weight": float(weight.split()[0])}


def parse_xlo(subject: str, text: str) -> Iterator[Block]:
    """Cardio-pulmonary variables of the tab-separated rows that begin with an empty value; columns have fixed places.

    Times are minutes and seconds from the start of the day; empty values are 0; oxygen and carbon dioxide are per kg.
    """
    lines = text.splitlines()
    head = xlo_header(lines[:XLO_HEADER])
    rows = [x for x in (line.split("\t") for line in lines[XLO_HEADER:]) if x[0] == XLO_EMPTY]
    clock = [x[XLO_COLUMNS.index("Time")].strip().split(":") for x in rows]
    us = as_us(head["start"]) + np.array([(int(m) * 60 + int(s)) * 1_000_000 for m, s, *_ in clock], np.int64)
    for i, name in list(enumerate(XLO_COLUMNS))[XLO_SKIPPED:]:
        values = np.array([0.0 if x[i] == XLO_EMPTY else float(x[i]) for x in rows])
        yield frame(subject, name, us, values / head["weight"] if name in ("V'O2", "V'CO2") else values)
