"""Queries of spectra, filters, posture, calibration, triaxial nonwear, bout statistics and requests by channel.

Recursive computations have recursive DuckDB statements, spectra sums of sines and cosines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as S
from ..model import HOUR, SECOND, instant, rename_channel, samples_from, select_channels
from ..operators import bouts as B
from ..operators import inference, spectral, windows
from ..spec import Cutpoints, FrequencyRanges, Generic, Percentiles, TopFrequencies, names
from .registry import SQL_VM, SQL_XYZ, axes, events, ntz, query, seconds, signal, sql_bouts, triaxial

# Spectra of windows of an hour: n samples each, bins k of 0 to n / 2.
SQL_BINS = f"""{SQL_XYZ}, long AS (SELECT subject_id, 'x' AS channel, ts, x AS v FROM xyz UNION ALL SELECT subject_id, 'y', ts, y FROM xyz UNION ALL SELECT subject_id, 'z', ts, z FROM xyz),
w AS (SELECT *, date_trunc('hour', ts) AS w, row_number() OVER (PARTITION BY subject_id, channel, date_trunc('hour', ts) ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY subject_id, channel, date_trunc('hour', ts)) AS n FROM long),
b AS (SELECT subject_id, channel, w, n, k, sum(v * cos(2 * pi() * k * i / n)) AS re, -sum(v * sin(2 * pi() * k * i / n)) AS im
  FROM (SELECT *, unnest(generate_series(0, n // 2)) AS k FROM w) GROUP BY subject_id, channel, w, n, k),
m AS (SELECT subject_id, channel, w, k, k * 0.1 / n AS f, CASE WHEN k = 0 THEN 0 ELSE sqrt(re * re + im * im) END AS mag FROM b),
p AS (SELECT *, count(*) FILTER (f < 0.001) OVER g AS lo, count(*) FILTER (f < 0.02) OVER g AS hi, row_number() OVER (PARTITION BY subject_id, channel, w ORDER BY mag DESC, k) - 1 AS place FROM m WINDOW g AS (PARTITION BY subject_id, channel, w)),
spine AS (SELECT subject_id, channel, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS w FROM long GROUP BY subject_id, channel)"""
_TOPS = ", ".join(f"round(coalesce(max(CASE WHEN place = {i} THEN {c} END), -1), 6) AS axis_{n}_{i}" for i in range(3) for n, c in (("topfreq", "f"), ("topmag", "mag")))


@query(f"""WITH {SQL_BINS} SELECT s.subject_id, s.channel, s.w AS ts, CASE WHEN count(p.k) = 0 THEN -1 ELSE round(coalesce(sum(mag) FILTER (k >= lo AND k < hi - 1), 0), 6) END AS "axis_0.001hz_0.02hz", {_TOPS}
FROM spine s LEFT JOIN p ON p.subject_id = s.subject_id AND p.channel = s.channel AND p.w = s.w GROUP BY s.subject_id, s.channel, s.w""")
def fft_stats(spark, sf_dir):
    return spectral.tumbling_spectra(axes(spark, sf_dir), HOUR, 0.1, [FrequencyRanges(((0.001, 0.02),)), TopFrequencies(3)], "axis")


@query(f"""WITH {SQL_XYZ}, n AS (SELECT subject_id, x AS v, row_number() OVER (PARTITION BY subject_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY subject_id) AS n FROM xyz)
SELECT subject_id, 'x' AS channel, CAST(k AS BIGINT) AS k, round(sum(v * cos(2 * pi() * k * i / n)), 6) + 0.0 AS re, round(0 - sum(v * sin(2 * pi() * k * i / n)), 6) + 0.0 AS im
FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM n) GROUP BY subject_id, k""")
def fft_coefficients(spark, sf_dir):
    """Coefficients near 0 keep no sign."""
    found = spectral.transform(select_channels(axes(spark, sf_dir), "x"))
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("re", "im")})


@query(f"WITH {SQL_XYZ} SELECT subject_id, 'x' AS channel, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY ts) - 1 AS BIGINT) AS i, round(x, 6) AS value FROM xyz")
def fft_inverse(spark, sf_dir):
    return spectral.inverse(spectral.transform(select_channels(axes(spark, sf_dir), "x")))


def sql_filter(order: int, cutoff: float, rate: float, high: bool, shown: str) -> str:
    """A recursive filter of vector magnitude, sample by sample, with the last values and results in lists."""
    b, a = spectral.butterworth(order, cutoff, rate, high)
    total = " + ".join(f"CAST({c!r} AS DOUBLE) * x[{i + 1}]" for i, c in enumerate(map(float, b)))
    total += "".join(f" - CAST({c!r} AS DOUBLE) * r.y[{i}]" for i, c in enumerate(map(float, a)) if i)
    zeros = "[" + ", ".join(["CAST(0 AS DOUBLE)"] * order) + "]"
    xs = ", ".join(f"CAST(coalesce(lag(v, {i}) OVER w, 0) AS DOUBLE)" for i in range(order + 1))
    return f"""WITH RECURSIVE {SQL_XYZ}, s AS (SELECT subject_id, ts, {SQL_VM} AS v FROM xyz),
n AS (SELECT subject_id, ts, row_number() OVER w AS i, [{xs}] AS x FROM s WINDOW w AS (PARTITION BY subject_id ORDER BY ts)),
r AS (SELECT DISTINCT subject_id, CAST(0 AS BIGINT) AS i, {zeros} AS y FROM s
  UNION ALL SELECT n.subject_id, n.i, list_prepend({total}, r.y[1:{order - 1}]) FROM r JOIN n ON n.subject_id = r.subject_id AND n.i = r.i + 1)
SELECT n.subject_id, 'vm' AS channel, n.ts, round({shown}, 6) AS value, false AS missing FROM r JOIN n USING (subject_id, i)"""


def magnitude(spark, sf_dir):
    return samples_from(triaxial(spark, sf_dir), "subject_id", "ts", vm=S.vector_magnitude("x", "y", "z"))


@query(sql_filter(4, 0.2, 1.0, True, "abs(r.y[1]) * 1000"))
def hpf_vm(spark, sf_dir):
    return spectral.magnitude_high_pass(magnitude(spark, sf_dir), 1.0)


@query(sql_filter(2, 0.1, 1.0, False, "r.y[1]"))
def low_pass_vm(spark, sf_dir):
    return spectral.low_pass(magnitude(spark, sf_dir), 0.1, 1.0, 2)


# A subject's state after each sample of pitch, where the run began that may change it, and whether the sample changed it.
SQL_POSTURE = f"""RECURSIVE {SQL_XYZ}, n AS (SELECT subject_id, ts, degrees(atan2(x, sqrt(y * y + z * z))) AS pitch, row_number() OVER (PARTITION BY subject_id ORDER BY ts) AS i FROM xyz),
r AS (SELECT subject_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(NULL AS TIMESTAMP) AS run, CAST(NULL AS TIMESTAMP) AS turned FROM n WHERE i = 1
  UNION ALL SELECT subject_id, i, CASE WHEN turn THEN 1 - state ELSE state END, CASE WHEN turn THEN NULL ELSE run END, CASE WHEN turn THEN run END
  FROM (SELECT *, run IS NOT NULL AND ts - run >= INTERVAL 10 SECOND AS turn
    FROM (SELECT n.subject_id, n.i, n.ts, r.state, CASE WHEN (r.state = 0 AND n.pitch >= 10) OR (r.state = 1 AND n.pitch <= 0) THEN coalesce(r.run, n.ts) END AS run FROM r JOIN n ON n.subject_id = r.subject_id AND n.i = r.i + 1))),
t AS (SELECT r.subject_id, n.ts AS at, r.turned AS begin, r.state FROM r JOIN n USING (subject_id, i) WHERE r.turned IS NOT NULL)"""


def pitch(spark, sf_dir):
    return samples_from(triaxial(spark, sf_dir), "subject_id", "ts", pitch=S.pitch("x", "y", "z"))


@query(f"""WITH {SQL_POSTURE} SELECT n.subject_id, 'pitch' AS channel, n.ts, CAST(coalesce((SELECT t.state FROM t WHERE t.subject_id = n.subject_id AND n.ts >= t.begin AND n.ts < t.at), r.state) AS INTEGER) AS posture
FROM n JOIN r USING (subject_id, i)""")
def posture(spark, sf_dir):
    return inference.posture(pitch(spark, sf_dir), stand=10.0, sit=0.0, hold=10.0)


# Offsets only, as for fewer than 500 points: each round moves the points by their mean distance from the unit sphere.
SQL_SOLVE = """o AS (SELECT subject_id, 0 AS step, CAST(0 AS DOUBLE) AS ox, CAST(0 AS DOUBLE) AS oy, CAST(0 AS DOUBLE) AS oz, list(x) AS xs, list(y) AS ys, list(z) AS zs FROM pts GROUP BY subject_id
  UNION ALL SELECT subject_id, step + 1, ox + list_avg(list_transform(range(1, len(xs) + 1), lambda k: (xs[k] + ox) / greatest(sqrt((xs[k] + ox) ** 2 + (ys[k] + oy) ** 2 + (zs[k] + oz) ** 2), 1e-12) - xs[k] - ox)),
    oy + list_avg(list_transform(range(1, len(xs) + 1), lambda k: (ys[k] + oy) / greatest(sqrt((xs[k] + ox) ** 2 + (ys[k] + oy) ** 2 + (zs[k] + oz) ** 2), 1e-12) - ys[k] - oy)),
    oz + list_avg(list_transform(range(1, len(xs) + 1), lambda k: (zs[k] + oz) / greatest(sqrt((xs[k] + ox) ** 2 + (ys[k] + oy) ** 2 + (zs[k] + oz) ** 2), 1e-12) - zs[k] - oz)), xs, ys, zs FROM o WHERE step < 1000),
fit AS (SELECT subject_id, ox, oy, oz FROM o WHERE step = 1000)"""
SQL_FITTED = """SELECT subject_id, CAST(count(*) AS BIGINT) AS points,
  CAST(8 - count(DISTINCT CASE WHEN x <> 0 AND y <> 0 AND z <> 0 THEN (x > 0, y > 0, z > 0) END) AS BIGINT) AS empty_octants,
  round(sqrt(sum(n * (1 - sqrt(x * x + y * y + z * z)) ** 2) / count(*)), 6) AS error_before,
  round(sqrt(sum(n * (1 - sqrt((x + ox) ** 2 + (y + oy) ** 2 + (z + oz) ** 2)) ** 2) / count(*)), 6) AS error_after,
  round(any_value(ox), 6) AS x_offset, CAST(1 AS DOUBLE) AS x_scale, round(any_value(oy), 6) AS y_offset, CAST(1 AS DOUBLE) AS y_scale, round(any_value(oz), 6) AS z_offset, CAST(1 AS DOUBLE) AS z_scale
FROM pts JOIN fit USING (subject_id) GROUP BY subject_id"""


@query(f"WITH RECURSIVE {SQL_XYZ}, pts AS (SELECT subject_id, x, y, z, 1 AS n FROM xyz), {SQL_SOLVE} {SQL_FITTED}")
def calibrate(spark, sf_dir):
    """Offsets only, however many points."""
    return inference.calibrate(triaxial(spark, sf_dir).withColumn("n", F.lit(1)), enough=1 << 31)


def held_still(spark, sf_dir):
    """Recordings that hold each embedding's direction, with an offset, for 80 s, then move for 10 s; two samples a window of 10 s."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    size = S.vector_magnitude(*part)
    at = (F.floor(F.col("vec_id") / 10) * 18 + F.col("k")) * 5 * SECOND
    moves = F.when(F.col("k") == 16, 0.2).when(F.col("k") == 17, -0.2).otherwise(0.0)
    rows = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(17))))
    return rows.select((F.col("vec_id") % 10).alias("subject_id"), instant(F.lit(1704067200 * SECOND).cast("long") + at.cast("long")).alias("ts"), *((p / size + shift + moves).alias(a) for p, a, shift in zip(part, "xyz", (0.03, -0.02, 0.01), strict=True)))


SQL_STILL = f"""{SQL_XYZ}, pts AS (SELECT subject_id, x / {SQL_VM} + 0.03 AS x, y / {SQL_VM} - 0.02 AS y, z / {SQL_VM} + 0.01 AS z, CAST(16 AS BIGINT) AS n FROM xyz)"""


@query(f"WITH RECURSIVE {SQL_STILL}, {SQL_SOLVE} {SQL_FITTED}")
def calibration_parameters(spark, sf_dir):
    """From raw samples: still and reasonable bouts, their points, the solution."""
    return inference.auto_calibrated(held_still(spark, sf_dir))[1]


@query(f"""WITH RECURSIVE {SQL_STILL}, {SQL_SOLVE}, k AS (SELECT unnest(generate_series(0, 17)) AS k),
rows_ AS (SELECT vec_id % 10 AS subject_id, TIMESTAMP '2024-01-01 00:00:00' + (vec_id // 10 * 18 + k) * INTERVAL 5 SECOND AS ts, k, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings, k),
moved AS (SELECT *, CASE k WHEN 16 THEN 0.2 WHEN 17 THEN -0.2 ELSE 0 END AS m, {SQL_VM} AS vm FROM rows_)
SELECT subject_id, ts, round(x / vm + 0.03 + m + ox, 6) AS x, round(y / vm - 0.02 + m + oy, 6) AS y, round(z / vm + 0.01 + m + oz, 6) AS z FROM moved JOIN fit USING (subject_id)""")
def calibrated_samples(spark, sf_dir):
    return inference.auto_calibrated(held_still(spark, sf_dir))[0]


@query(f"WITH {SQL_STILL} SELECT subject_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, n FROM pts")
def still_points(spark, sf_dir):
    xyz = held_still(spark, sf_dir)
    return inference.still_points(xyz, inference.still_bouts(samples_from(xyz, "subject_id", "ts", x="x", y="y", z="z")))


def worn(spark, sf_dir):
    """Triaxial recordings, a sample each 30 s for 5 hours, that lie still from the second hour to the end of the third and move before and after."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 10")
    rows = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3599))))
    still = F.col("k").between(720, 2159)
    value = lambda i: F.get("embedding", F.lit(i)).cast("double") + F.when(still, 0.0).otherwise(F.col("k") % 2 * 0.5)
    at = instant(F.lit(1704067200 * SECOND).cast("long") + F.col("k").cast("long") * 5 * SECOND)
    return samples_from(rows.select("vec_id", at.alias("ts"), *(value(i).alias(a) for i, a in enumerate("xyz"))), "vec_id", "ts", x="x", y="y", z="z")


@query("""SELECT vec_id AS subject_id, kind, TIMESTAMP '2024-01-01 00:00:00' + a * INTERVAL 1 SECOND AS start_ts, TIMESTAMP '2024-01-01 00:00:00' + b * INTERVAL 1 SECOND AS end_ts
FROM (SELECT vec_id FROM embeddings WHERE vec_id < 10), (VALUES ('off', 3600, 10800), ('wear', 0, 3600), ('wear', 10800, 17995)) AS t(kind, a, b)""")
def nonwear_triaxial(spark, sf_dir):
    off, wear = inference.nonwear_triaxial(worn(spark, sf_dir))
    return off.select("subject_id", F.lit("off").alias("kind"), "start_ts", "end_ts").unionByName(wear.select("subject_id", F.lit("wear").alias("kind"), "start_ts", "end_ts"))


def active(spark, sf_dir):
    return B.bouts(signal(spark, sf_dir), 20, 80).select(*B.INTERVAL)


def sql_bout_windows(spine: str, step: str) -> str:
    """Bout statistics of windows start_ts to end_ts, with sd50 of the whole lengths of the bouts that reach in."""
    inside = "sum(epoch_us(least(w.end_ts, b.end_ts)) - epoch_us(greatest(w.start_ts, b.start_ts))) FILTER (b.subject_id IS NOT NULL)"
    length = f"{seconds('b.start_ts', 'b.end_ts')} / 60"
    return f"""WITH {sql_bouts(20, 80)}, w AS ({spine}), p AS (SELECT w.*, b.start_ts AS c, b.end_ts AS d, {length} AS m FROM w JOIN bouts b ON b.subject_id = w.subject_id AND greatest(w.start_ts, b.start_ts) < least(w.end_ts, b.end_ts)),
t AS (SELECT subject_id, start_ts, end_ts, sum(m) AS total, floor(max(m)) AS lim FROM p GROUP BY ALL), l AS (SELECT subject_id, start_ts, end_ts, ceil(m) AS l, sum(m) AS m FROM p GROUP BY subject_id, start_ts, end_ts, ceil(m)),
c AS (SELECT subject_id, start_ts, end_ts, l, sum(m) OVER (PARTITION BY subject_id, start_ts, end_ts ORDER BY l) AS cum FROM l),
s AS (SELECT subject_id, start_ts, end_ts, min(CASE WHEN floor(total / 100 * 50) <= 0 AND lim >= 1 THEN 1 WHEN cum >= floor(total / 100 * 50) AND greatest(l, 1) <= lim THEN greatest(l, 1) END) AS sd50 FROM t JOIN c USING (subject_id, start_ts, end_ts) GROUP BY ALL)
SELECT w.subject_id, w.start_ts, w.end_ts, coalesce(CAST({inside} AS DOUBLE) / 1000000, -1) AS bout_sum, coalesce(CAST({inside} AS DOUBLE) / count(b.subject_id) / 1000000, -1) AS bout_mean, CAST(count(b.subject_id) AS BIGINT) AS bout_n, CAST(coalesce(any_value(s.sd50), -1) AS BIGINT) AS sd50
FROM w LEFT JOIN bouts b ON b.subject_id = w.subject_id AND greatest(w.start_ts, b.start_ts) < least(w.end_ts, b.end_ts) LEFT JOIN s ON s.subject_id = w.subject_id AND s.start_ts = w.start_ts AND s.end_ts = w.end_ts GROUP BY w.subject_id, w.start_ts, w.end_ts"""


_SPAN = "SELECT subject_id, min(start_ts) AS lo, max(end_ts) AS hi FROM bouts GROUP BY subject_id"


@query(sql_bout_windows(f"SELECT subject_id, s AS start_ts, s + INTERVAL 12 HOUR AS end_ts FROM (SELECT subject_id, unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi) + INTERVAL 12 HOUR, INTERVAL 12 HOUR)) AS s FROM ({_SPAN}))", "12 HOUR"), exact=True)
def bout_piecewise(spark, sf_dir):
    return B.piecewise_statistics(active(spark, sf_dir), 12 * HOUR, [50])


@query(sql_bout_windows(f"SELECT subject_id, lo AS start_ts, hi AS end_ts FROM ({_SPAN})", ""), exact=True)
def bout_summary(spark, sf_dir):
    return B.summary_statistics(active(spark, sf_dir), [50])


@query(sql_bout_windows(f"SELECT subject_id, TIMESTAMP '2024-01-05 00:00:00' AS start_ts, TIMESTAMP '2024-01-15 12:00:00' AS end_ts FROM ({_SPAN})", ""), exact=True)
def bout_summary_period(spark, sf_dir):
    return B.summary_statistics(active(spark, sf_dir), [50], (ntz("2024-01-05 00:00:00"), ntz("2024-01-15 12:00:00")))


@query(f"WITH {sql_bouts(20, 80)} SELECT * FROM bouts WHERE greatest(start_ts, TIMESTAMP '2024-01-10 00:00:00') < least(end_ts, TIMESTAMP '2024-01-12 00:00:00')")
def bouts_involved(spark, sf_dir):
    rows = active(spark, sf_dir)
    window = rows.select("subject_id").distinct().select("subject_id", ntz("2024-01-10 00:00:00").alias("start_ts"), ntz("2024-01-12 00:00:00").alias("end_ts"))
    return B.involved(rows, window)


@query("""SELECT e.user_id AS subject_id, 'value' AS channel, TIMESTAMP '2024-01-05 00:00:00' AS ts, round(coalesce(avg(v.value), -1), 6) AS value_mean, CAST(count(v.value) AS BIGINT) AS value_n, round(coalesce(quantile_cont(v.value, 0.5), -1), 6) AS value_p50
FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN events v ON v.user_id = e.user_id AND v.ts >= TIMESTAMP '2024-01-05 00:00:00' AND v.ts < TIMESTAMP '2024-01-06 00:00:00' GROUP BY e.user_id""")
def summary_period(spark, sf_dir):
    return windows.summary(signal(spark, sf_dir), [Generic(("mean", "n")), Percentiles((50,))], period=(ntz("2024-01-05 00:00:00"), ntz("2024-01-06 00:00:00")))


@query(f"""WITH {SQL_XYZ}, h AS (SELECT subject_id, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts, max(ts) AS hi, min(ts) AS lo FROM xyz GROUP BY subject_id)
SELECT h.subject_id, h.ts, round(coalesce(avg(x), -1), 6) AS x_mean, CAST(count(*) FILTER (y BETWEEN 0 AND 1) AS BIGINT) AS y_0_1, round(coalesce(max(y), -1), 6) AS y_max, round(coalesce(quantile_cont(z, 0.25), -1), 6) AS z_p25
FROM h LEFT JOIN xyz v ON v.subject_id = h.subject_id AND date_trunc('hour', v.ts) = h.ts AND NOT (h.ts = h.hi AND h.lo < h.hi) GROUP BY h.subject_id, h.ts""")
def piecewise_by_channel(spark, sf_dir):
    requests = {"x": [Generic(("mean",))], "y": [Cutpoints(((0, 1),)), Generic(("max",))], "z": [Percentiles((25,))]}
    return windows.per_channel(axes(spark, sf_dir), requests, lambda rows, statistics, name: windows.tumbling(rows, HOUR, statistics, signal=name))


@query(f"WITH {SQL_XYZ} SELECT subject_id, min(ts) AS ts, round(avg(x), 6) AS x_mean, CAST(count(*) FILTER (y BETWEEN 0 AND 1) AS BIGINT) AS y_0_1 FROM xyz GROUP BY subject_id")
def summary_by_channel(spark, sf_dir):
    requests = {"x": [Generic(("mean",))], "y": [Cutpoints(((0, 1),))]}
    return windows.per_channel(axes(spark, sf_dir), requests, lambda rows, statistics, name: windows.summary(rows, statistics, name))


@query(f"""WITH {SQL_XYZ} SELECT s.subject_id, TIMESTAMP '2024-01-01 00:00:00' AS ts, TIMESTAMP '2024-01-01 00:01:00' AS end_ts, round(coalesce(avg(x), -1), 6) AS x_mean, round(coalesce(min(y), -1), 6) AS y_min
FROM (SELECT DISTINCT subject_id FROM xyz) s LEFT JOIN xyz v ON v.subject_id = s.subject_id AND v.ts < TIMESTAMP '2024-01-01 00:01:00' GROUP BY s.subject_id""")
def given_by_channel(spark, sf_dir):
    rows = axes(spark, sf_dir)
    listed = rows.select("subject_id").distinct().select("subject_id", ntz("2024-01-01 00:00:00").alias("start_ts"), ntz("2024-01-01 00:01:00").alias("end_ts"))
    requests = {"x": [Generic(("mean",))], "y": [Generic(("min",))]}
    return windows.per_channel(rows, requests, lambda own, statistics, name: windows.given(own, listed, statistics, name))


@query(f"WITH {SQL_XYZ} SELECT subject_id, 'across' AS channel, ts, round(x, 6) AS value, false AS missing FROM xyz UNION ALL SELECT subject_id, 'z', ts, round(z, 6), false FROM xyz")
def renamed_channels(spark, sf_dir):
    return select_channels(rename_channel(axes(spark, sf_dir), "x", "across"), "across", "z")


@query("SELECT * FROM (VALUES (0, 'v_mean'), (1, 'v_0_20'), (2, 'v_1tr1'), (3, 'v_p5'), (4, 'v_0hz_2.5hz'), (5, 'v_topfreq_0'), (6, 'v_topmag_0')) AS t(place, name)")
def result_names(spark, sf_dir):
    from ..spec import Bigrams

    found = names("v", [Generic(("mean",)), Cutpoints(((0, 20),)), Bigrams((1,)), Percentiles((5,)), FrequencyRanges(((0, 2.5),)), TopFrequencies(1)])
    return spark.createDataFrame(list(enumerate(found)), "place int, name string")


@query("""SELECT user_id AS subject_id, 'value' AS channel, part AS part_number, min(ts) AS ts, round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(max(value), 6) AS high
FROM (SELECT *, least(floor((epoch_us(ts) - min(epoch_us(ts)) OVER w) / greatest(max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w, 1) * 20), 19) AS part FROM events WINDOW w AS (PARTITION BY user_id)) GROUP BY user_id, part""".replace(", part AS part_number", ""))
def plot_envelope(spark, sf_dir):
    from ..sources import media

    return media.envelope(signal(spark, sf_dir), 20)


@query("""WITH p AS (SELECT user_id, part, min(ts) AS ts, avg(value) AS mean FROM (SELECT *, least(floor((epoch_us(ts) - min(epoch_us(ts)) OVER w) / greatest(max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w, 1) * 20), 19) AS part FROM events WINDOW w AS (PARTITION BY user_id)) GROUP BY user_id, part)
SELECT e.user_id AS subject_id, e.ts, e.event_type AS text, round((SELECT arg_max(p.mean, p.ts) FROM p WHERE p.user_id = e.user_id AND p.ts <= e.ts), 6) AS height FROM events e WHERE e.event_type = 'error'""")
def plot_annotations(spark, sf_dir):
    from ..sources import media

    marks = events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("subject_id"), "ts", F.col("event_type").alias("text"))
    return media.annotated(marks, media.envelope(signal(spark, sf_dir), 20))


@query(f"WITH {sql_bouts(20, 80)} SELECT subject_id, 'active' AS label, start_ts, end_ts FROM bouts")
def plot_shades(spark, sf_dir):
    from ..sources import media

    return media.shaded(active(spark, sf_dir), "active")


@query("SELECT user_id AS subject_id, CAST(44 + 2 * 441 * count(*) AS BIGINT) AS wav_bytes FROM events GROUP BY user_id")
def tones(spark, sf_dir):
    from ..sources import media

    return media.tones(signal(spark, sf_dir)).select("subject_id", F.length("wav").cast("long").alias("wav_bytes"))


