"""Readers and writers of samples and bouts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, store, text

#: Recordings that are parsed whole, by kind: what reads text, and what reads bytes.
TEXTS = {"actigraph": text.parse_actigraph, "actiheart": text.parse_actiheart, "xlo": text.parse_xlo}
BYTES = {"datx": binary.decode_datx, "geneactiv": binary.decode_geneactiv, "axivity": binary.decode_axivity}
#: Recordings that are read by line.
LINES = {"activpal_csv": text.decode_activpal_csv, "geneactiv_csv": text.decode_geneactiv_csv, "gt3x_csv": text.decode_gt3x_csv}
ZIPPED = {"axivity_zip": "axivity", "gt3x_zip": "gt3x_csv"}
HEADERS: dict[str, Callable] = {
    "actigraph": text.actigraph_header, "actiheart": text.actiheart_header, "gt3x_csv": text.gt3x_header, "xlo": text.xlo_header, "datx": binary.datx_header, "geneactiv": binary.geneactiv_header, "axivity": binary.axivity_header,
}
#: What a file's extension says about it.
KINDS = {"dat": "actigraph", "csv": "csv", "bin": "geneactiv", "datx": "datx", "cwa": "axivity", "parquet": "parquet"}


def kind_of(path: str) -> str:
    suffix = re.sub(r".*\.", "", path.rstrip("/")).lower()
    if suffix not in KINDS:
        raise ValueError(f"no reader for {path}")
    return KINDS[suffix]


def decode(recordings: DataFrame, kind: str, **options) -> DataFrame:
    """Samples of recordings in a table: name with value (text) or content (bytes)."""
    if kind in ZIPPED:
        if ZIPPED[kind] in BYTES:
            inner = BYTES[ZIPPED[kind]]
            return binary.decoded(recordings, lambda name, content: inner(name, binary.unzipped(content)))
        plain = F.udf(lambda content: binary.unzipped(bytes(content)).decode(), "string")
        return decode(recordings.select("name", plain("content").alias("value")), ZIPPED[kind], **options)
    if kind in TEXTS:
        return text.parsed(recordings, partial(TEXTS[kind], **options))
    if kind in BYTES:
        return binary.decoded(recordings, partial(BYTES[kind], **options))
    if kind in LINES:
        return LINES[kind](text.lines_of(recordings), **options)
    if kind == "csv":
        return text.decode_csv(recordings, **options)
    raise ValueError(f"unknown kind of file: {kind}")


def load(spark: SparkSession, path: str, kind: str = "infer", **options) -> DataFrame:
    """Samples of the files at a path; their kind is inferred from the extension unless given."""
    kind = kind_of(path) if kind == "infer" else kind
    if kind == "parquet":
        return store.read_samples(spark, path)
    if kind == "csv":
        return text.read_csv(spark, path, **options)
    if kind in LINES:
        return LINES[kind](text.text_lines(spark, path), **options)
    return decode(text.text_files(spark, path) if kind in TEXTS else binary.binary_files(spark, path), kind, **options)


def headers(recordings: DataFrame, kind: str) -> DataFrame:
    """subject_id and fields (a map of strings) of the headers of recordings in a table, as for decode.

    Times have the form yyyy-MM-dd HH:mm:ss, lengths of time are seconds; fields without a value are left out.
    """
    inner, zipped = ZIPPED.get(kind, kind), kind in ZIPPED
    parse, source = HEADERS[inner], "content" if zipped or inner in BYTES else "value"

    def shown(x) -> str:
        return x.strftime("%Y-%m-%d %H:%M:%S") if isinstance(x, datetime) else str(x.total_seconds()) if isinstance(x, timedelta) else str(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for whole in batch[source]:
                whole = binary.unzipped(bytes(whole)) if zipped else whole
                whole = whole.decode() if isinstance(whole, bytes) and inner not in BYTES else whole
                fields = parse(bytes(whole) if inner in BYTES else whole.splitlines()[:40])
                found.append({k: shown(v) for k, v in fields.items() if v is not None})
            yield pd.DataFrame({"subject_id": batch["name"], "fields": found})

    return recordings.select("name", source).mapInPandas(run, "subject_id string, fields map<string, string>")


def header(samples: DataFrame) -> DataFrame:
    """One row a subject: channels, samples, first and last timestamp."""
    return samples.groupBy("subject_id").agg(F.count_distinct("channel").alias("channels"), F.count("*").alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
