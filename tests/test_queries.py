"""Named queries against their DuckDB statements on a small table of events and embeddings."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from strideline.plans import catalogue

NAMES = [n for n in catalogue.QUERIES if n.startswith(("source_", "sink_", "stream_", "batch_"))] + ["bout_confusion", "percentiles", "fill_windows", "normalise", "calibrated_samples", "hpf_vm", "posture", "piecewise_by_channel", "result_cache"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(3)
    n = 160
    users = rng.integers(0, 9, n)
    ts = [datetime(2024, 1, 1) + timedelta(microseconds=int(x)) for x in rng.choice(20 * 86_400_000_000, n, replace=False)]
    frame = pd.DataFrame({"event_id": np.arange(n), "ts": pd.to_datetime(ts).astype("datetime64[us]"), "user_id": users, "event_type": rng.choice(["click", "error", "view"], n), "value": np.round(rng.exponential(60, n), 2)})
    frame.to_parquet(f"{folder}/events.parquet")
    pd.DataFrame({"vec_id": np.arange(100), "embedding": [list(v) for v in rng.normal(size=(100, 8)).astype(np.float32)]}).to_parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


def plain(frame):
    show = lambda x: "" if x is None or x is pd.NaT or x != x else str(round(float(x), 5) + 0.0) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(show(x) for x in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_as_duckdb(spark, tables, name):
    folder, con = tables
    got, want = catalogue.QUERIES[name](spark, folder).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert plain(got) == plain(want)


def test_every_query_has_a_statement():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and len(catalogue.QUERIES) > 80
