"""Named queries over the driver's tables, with the same statements for DuckDB.

The signal is events.value, a record is a user. Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as S
from ..model import DAY, HOUR, SECOND, append, instant, micros, samples_from, timeframe, wide
from ..operators import batch, inference, values, windows
from ..operators import bouts as B
from ..spec import Bigrams, Cutpoints, Generic, Percentiles, dictionary
from .registry import ORACLES, QUERIES, SQL_VM, SQL_XYZ, axes, events, ntz, query, seconds, signal, sql_bouts, triaxial

TYPES = ["click", "error", "login", "purchase", "view"]


def active(spark, sf_dir):
    return B.bouts(signal(spark, sf_dir), 20, 80).select(*B.INTERVAL)


def quiet(spark, sf_dir):
    return B.bouts(signal(spark, sf_dir), 0, 30).select(*B.INTERVAL)


def days(spark, sf_dir):
    """Every day of every subject's record."""
    span = signal(spark, sf_dir).groupBy("subject_id").agg(F.floor(F.min(micros("ts")) / DAY).alias("a"), F.floor(F.max(micros("ts")) / DAY).alias("b"))
    return span.select("subject_id", F.explode(F.sequence("a", "b")).alias("d")).select("subject_id", instant(F.col("d") * DAY).alias("start_ts"), instant((F.col("d") + 1) * DAY).alias("end_ts"))


# Parts of the DuckDB statements.
def sql_complement(name: str, of: str) -> str:
    return f"""{name} AS (SELECT o.subject_id, coalesce(lag(o.end_ts) OVER (PARTITION BY o.subject_id ORDER BY o.start_ts), p.lo) AS start_ts, o.start_ts AS end_ts FROM {of} o JOIN periods p USING (subject_id)
  UNION ALL SELECT p.subject_id, coalesce(max(o.end_ts), p.lo), p.hi FROM periods p LEFT JOIN {of} o USING (subject_id) GROUP BY p.subject_id, p.lo, p.hi)"""


def sql_intersection(name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT a.subject_id, greatest(a.start_ts, b.start_ts) AS start_ts, least(a.end_ts, b.end_ts) AS end_ts FROM {a} a JOIN {b} b
  ON a.subject_id = b.subject_id AND greatest(a.start_ts, b.start_ts) < least(a.end_ts, b.end_ts))"""


SQL_PERIODS = "periods AS (SELECT user_id AS subject_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id)"
SQL_DAYS = "days AS (SELECT user_id AS subject_id, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS start_ts FROM events GROUP BY user_id)"
SQL_ENDS = "ends AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id)"
SQL_GENERIC = "round(coalesce(avg(value), -1), 6) AS value_mean, round(coalesce(sum(value), -1), 6) AS value_sum, round(coalesce(stddev_pop(value), -1), 6) AS value_std, round(coalesce(min(value), -1), 6) AS value_min, round(coalesce(max(value), -1), 6) AS value_max, CAST(count(value) AS BIGINT) AS value_n"
GENERIC = Generic(("mean", "sum", "std", "min", "max", "n"))


def sql_tumbling(spine: str, step: str, columns: str) -> str:
    return f"""WITH {SQL_ENDS}, spine AS ({spine})
SELECT s.user_id AS subject_id, 'value' AS channel, s.w AS ts, {columns} FROM spine s JOIN ends e ON e.user_id = s.user_id
LEFT JOIN events v ON v.user_id = s.user_id AND v.ts >= s.w AND v.ts < s.w + INTERVAL {step} AND NOT (s.w = e.hi AND e.lo < e.hi) GROUP BY s.user_id, s.w"""


SQL_CUTS = "CAST(count(*) FILTER (value BETWEEN 0 AND 20) AS BIGINT) AS value_0_20, CAST(count(*) FILTER (value BETWEEN 20 AND 80) AS BIGINT) AS value_20_80, CAST(count(*) FILTER (value BETWEEN 50 AND 1000) AS BIGINT) AS value_50_1000"
CUTS = Cutpoints(((0, 20), (20, 80), (50, 1000)))
SIX = "SELECT user_id, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 18 HOUR, INTERVAL 6 HOUR)) AS w FROM events GROUP BY user_id"


@query(sql_tumbling(SIX, "6 HOUR", f"{SQL_GENERIC}, {SQL_CUTS}"))
def piecewise_6h(spark, sf_dir):
    return windows.tumbling(signal(spark, sf_dir), 6 * HOUR, [GENERIC, CUTS])


@query(sql_tumbling("SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-05 03:00:00', TIMESTAMP '2024-01-12 00:00:00' - INTERVAL 1 MICROSECOND, INTERVAL 10 HOUR)) AS w FROM events GROUP BY user_id", "10 HOUR", SQL_GENERIC))
def piecewise_custom_period(spark, sf_dir):
    return windows.tumbling(signal(spark, sf_dir), 10 * HOUR, [GENERIC], (ntz("2024-01-05 03:00:00"), ntz("2024-01-12 00:00:00")))


@query(f"SELECT user_id AS subject_id, 'value' AS channel, min(ts) AS ts, {SQL_GENERIC}, CAST(0 AS BIGINT) AS value_missing FROM events GROUP BY user_id")
def summary_generic(spark, sf_dir):
    return windows.summary(signal(spark, sf_dir), [GENERIC, Generic(("missing",))])


@query("SELECT user_id AS subject_id, 'value' AS channel, min(ts) AS ts, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS value_p{p}" for p in (5, 25, 50, 75, 95)) + " FROM events GROUP BY user_id")
def percentiles(spark, sf_dir):
    return windows.summary(signal(spark, sf_dir), [Percentiles((5, 25, 50, 75, 95))])


@query(f"SELECT user_id AS subject_id, 'value' AS channel, min(ts) AS ts, {SQL_CUTS} FROM events GROUP BY user_id")
def cutpoints_summary(spark, sf_dir):
    return windows.summary(signal(spark, sf_dir), [CUTS])


_CODE = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " ELSE 9 END"
_PAIRS = ", ".join(f"CAST(count(*) FILTER (p = {a} AND c = {b}) AS BIGINT) AS state_{a}tr{b}" for a in (0, 1, 2) for b in (0, 1, 2))


@query(f"""WITH {SQL_ENDS}, v AS (SELECT user_id, ts, date_trunc('day', ts) AS w, {_CODE} AS c FROM events),
q AS (SELECT v.*, lag(c) OVER (PARTITION BY v.user_id, w ORDER BY v.ts) AS p FROM v JOIN ends e USING (user_id) WHERE NOT (w = e.hi AND e.lo < e.hi)),
{SQL_DAYS}
SELECT d.subject_id, 'state' AS channel, d.start_ts AS ts, {_PAIRS} FROM days d LEFT JOIN q ON q.user_id = d.subject_id AND q.w = d.start_ts GROUP BY d.subject_id, d.start_ts""")
def bigrams_daily(spark, sf_dir):
    code = F.lit(9)
    for i, t in enumerate(TYPES):
        code = F.when(F.col("event_type") == t, i).otherwise(code)
    return windows.tumbling(samples_from(events(spark, sf_dir), "user_id", "ts", state=code), DAY, [Bigrams((0, 1, 2))], signal="state")


@query("""SELECT user_id AS subject_id, 'value' AS channel, ts, round(avg(value) OVER w, 6) AS value_mean, CAST(count(*) OVER w AS BIGINT) AS value_n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43200000000 PRECEDING AND 43199999999 FOLLOWING)""")
def sliding_mean_24h(spark, sf_dir):
    return windows.sliding(signal(spark, sf_dir), DAY, [Generic(("mean", "n"))])


@query(f"""WITH {SQL_ENDS}, g AS (SELECT user_id, unnest(generate_series(0, 3)) AS k FROM ends), s AS (SELECT user_id, TIMESTAMP '2024-01-03 00:00:00' + k * INTERVAL 30 HOUR AS a, TIMESTAMP '2024-01-05 12:00:00' + k * INTERVAL 30 HOUR AS b FROM g)
SELECT s.user_id AS subject_id, 'value' AS channel, s.a AS ts, s.b AS end_ts, {SQL_GENERIC} FROM s JOIN ends e USING (user_id)
LEFT JOIN events v ON v.user_id = s.user_id AND v.ts >= s.a AND v.ts < s.b AND NOT (s.a = e.hi AND e.lo < e.hi) GROUP BY s.user_id, s.a, s.b""")
def given_windows(spark, sf_dir):
    rows = signal(spark, sf_dir)
    k = rows.select("subject_id").distinct().select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    begin = lambda text: instant(micros(ntz(text)) + F.col("k") * 30 * HOUR)
    return windows.given(rows, k.select("subject_id", begin("2024-01-03 00:00:00").alias("start_ts"), begin("2024-01-05 12:00:00").alias("end_ts")), [GENERIC])


@query("""SELECT user_id AS subject_id, 'value' AS channel, min(ts) AS ts, round(avg(value), 6) AS value_mean, CAST(count(*) AS BIGINT) AS value_n
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events) WHERE i BETWEEN 5 AND 24 GROUP BY user_id""")
def index_windows(spark, sf_dir):
    return windows.by_index(signal(spark, sf_dir), 5, 25, [Generic(("mean", "n"))])


@query(f"WITH {sql_bouts(20, 80)} SELECT subject_id, 'value' AS channel, start_ts, end_ts FROM bouts")
def bouts_20_80(spark, sf_dir):
    return B.bouts(signal(spark, sf_dir), 20, 80)


@query(f"WITH {sql_bouts(20, 80)} SELECT subject_id, start_ts, end_ts FROM bouts WHERE {seconds()} BETWEEN 7200 AND 86400")
def bouts_lengths(spark, sf_dir):
    return B.limit_lengths(active(spark, sf_dir), 2 * HOUR, DAY)


@query(f"WITH {sql_bouts(20, 80)} SELECT subject_id, round(sum({seconds()}), 6) AS total, CAST(count(*) AS BIGINT) AS n FROM bouts GROUP BY subject_id")
def bout_total_time(spark, sf_dir):
    return B.total_time(active(spark, sf_dir))


@query(f"WITH {sql_bouts(20, 80, name='a')}, {sql_bouts(0, 30, name='b')}, {sql_intersection('x', 'a', 'b')} SELECT * FROM x")
def bout_intersection(spark, sf_dir):
    return B.intersection(active(spark, sf_dir), quiet(spark, sf_dir))


@query(f"""WITH {sql_bouts(20, 80, name='a')}, {sql_bouts(0, 30, name='b')}, both_ AS (SELECT * FROM a UNION ALL SELECT * FROM b),
o AS (SELECT *, max(end_ts) OVER (PARTITION BY subject_id ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM both_ WHERE start_ts < end_ts),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR start_ts > m THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS r FROM o)
SELECT subject_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM g GROUP BY subject_id, r""")
def bout_union(spark, sf_dir):
    return B.union(active(spark, sf_dir), quiet(spark, sf_dir))


@query(f"WITH {SQL_PERIODS}, {sql_bouts(20, 80, name='a')}, {sql_complement('c', 'a')} SELECT * FROM c")
def bout_complement(spark, sf_dir):
    return B.complement(active(spark, sf_dir), inference.record_period(signal(spark, sf_dir)))


_CELLS = "".join(f", {sql_intersection(n, a, b)}" for n, a, b in (("a0b0", "na", "nb"), ("a1b0", "a", "nb"), ("a0b1", "na", "b"), ("a1b1", "a", "b")))


@query(f"""WITH {SQL_PERIODS}, {sql_bouts(20, 80, name='a')}, {sql_bouts(0, 30, name='b')}, {sql_complement('na', 'a')}, {sql_complement('nb', 'b')}{_CELLS},
cells AS ({' UNION ALL '.join(f"SELECT '{c}' AS cell, * FROM {c}" for c in ('a0b0', 'a1b0', 'a0b1', 'a1b1'))})
SELECT p.subject_id, k.cell, round(coalesce(sum({seconds()}), 0), 6) AS seconds, CAST(count(c.cell) AS BIGINT) AS n
FROM periods p CROSS JOIN (SELECT unnest(['a0b0', 'a1b0', 'a0b1', 'a1b1']) AS cell) k LEFT JOIN cells c ON c.subject_id = p.subject_id AND c.cell = k.cell GROUP BY p.subject_id, k.cell""")
def bout_confusion(spark, sf_dir):
    return B.confusion(active(spark, sf_dir), quiet(spark, sf_dir), inference.record_period(signal(spark, sf_dir)))


_DAILY = "greatest(d.start_ts, b.start_ts)", "least(d.start_ts + INTERVAL 1 DAY, b.end_ts)"
SQL_DAY_BOUTS = f"days d LEFT JOIN bouts b ON b.subject_id = d.subject_id AND {_DAILY[0]} < {_DAILY[1]}"


_INSIDE = f"sum(epoch_us({_DAILY[1]}) - epoch_us({_DAILY[0]})) FILTER (b.subject_id IS NOT NULL)"


@query(f"""WITH {SQL_DAYS}, {sql_bouts(20, 80)} SELECT d.subject_id, d.start_ts, d.start_ts + INTERVAL 1 DAY AS end_ts, coalesce(CAST({_INSIDE} AS DOUBLE) / 1000000, -1) AS bout_sum,
coalesce(CAST({_INSIDE} AS DOUBLE) / count(b.subject_id) / 1000000, -1) AS bout_mean, CAST(count(b.subject_id) AS BIGINT) AS bout_n FROM {SQL_DAY_BOUTS} GROUP BY d.subject_id, d.start_ts""", exact=True)
def bout_window_stats(spark, sf_dir):
    return B.window_statistics(active(spark, sf_dir), days(spark, sf_dir))


@query(f"""WITH {SQL_DAYS}, {sql_bouts(20, 80, name='al')}, bouts AS (SELECT * FROM al WHERE {seconds()} >= 3600) SELECT d.subject_id, d.start_ts, d.start_ts + INTERVAL 1 DAY AS end_ts,
round(coalesce(sum({seconds(*_DAILY)}) FILTER (b.subject_id IS NOT NULL), 0), 6) AS value_20_80_bouts_mt3600_sum, CAST(count(b.subject_id) AS BIGINT) AS value_20_80_bouts_mt3600_num FROM {SQL_DAY_BOUTS} GROUP BY d.subject_id, d.start_ts""")
def channel_bouts_stat(spark, sf_dir):
    return B.channel_bouts(signal(spark, sf_dir), days(spark, sf_dir), [(20, 80, 3600)])


_SD = (10, 50, 90)


@query(f"""WITH {sql_bouts(20, 80)}, m AS (SELECT subject_id, {seconds()} / 60 AS m FROM bouts), t AS (SELECT subject_id, sum(m) AS total, floor(max(m)) AS lim FROM m GROUP BY subject_id),
l AS (SELECT subject_id, ceil(m) AS l, sum(m) AS m FROM m GROUP BY subject_id, ceil(m)), c AS (SELECT subject_id, l, sum(m) OVER (PARTITION BY subject_id ORDER BY l) AS cum FROM l)
SELECT t.subject_id, {', '.join(f"CAST(min(CASE WHEN floor(total / 100 * {p}) <= 0 AND lim >= 1 THEN 1 WHEN cum >= floor(total / 100 * {p}) AND greatest(l, 1) <= lim THEN greatest(l, 1) END) AS BIGINT) AS sd{p}" for p in _SD)}
FROM t JOIN c USING (subject_id) GROUP BY t.subject_id""")
def sdx(spark, sf_dir):
    return B.sdx(active(spark, sf_dir), list(_SD))


@query("""SELECT user_id AS subject_id, 'value' AS channel, min(ts) AS ts, CAST(count(*) FILTER (NOT m) AS BIGINT) AS value_n, CAST(count(*) FILTER (m) AS BIGINT) AS value_missing, round(coalesce(sum(value) FILTER (NOT m), -1), 6) AS value_sum
FROM (SELECT *, (ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00') OR (ts >= TIMESTAMP '2024-01-11 00:00:00' AND ts < TIMESTAMP '2024-01-14 06:00:00') AS m FROM events) GROUP BY user_id""")
def mask_windows(spark, sf_dir):
    rows = signal(spark, sf_dir)
    pairs = F.array(*(F.struct(ntz(a).alias("a"), ntz(b).alias("b")) for a, b in (("2024-01-08 00:00:00", "2024-01-12 00:00:00"), ("2024-01-11 00:00:00", "2024-01-14 06:00:00"))))
    listed = rows.select("subject_id").distinct().select("subject_id", F.explode(pairs).alias("w")).select("subject_id", F.col("w.a").alias("start_ts"), F.col("w.b").alias("end_ts"))
    return windows.summary(values.delete_windows(rows, listed), [Generic(("n", "missing", "sum"))])


@query(f"""WITH {sql_bouts(0, 30)} SELECT e.user_id AS subject_id, 'value' AS channel, e.ts, round(CASE WHEN EXISTS (SELECT 1 FROM bouts b WHERE b.subject_id = e.user_id AND e.ts >= b.start_ts AND e.ts < b.end_ts) THEN 7 ELSE e.value END, 6) AS value, false AS missing FROM events e""")
def fill_windows(spark, sf_dir):
    return values.fill_windows(signal(spark, sf_dir), quiet(spark, sf_dir), 7)


@query("""SELECT user_id AS subject_id, 'value' AS channel, ts, round(CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 MICROSECOND OR ts > TIMESTAMP '2024-01-20 12:00:00' THEN -111 ELSE value END, 6) AS value,
ts < TIMESTAMP '2024-01-10 00:00:00' OR ts > TIMESTAMP '2024-01-20 12:00:00' AS missing FROM events""")
def restrict_timeframe(spark, sf_dir):
    return values.shown(values.restrict_timeframe(signal(spark, sf_dir), ntz("2024-01-10 00:00:00"), ntz("2024-01-20 12:00:00")))


SQL_OFF = f"""{SQL_PERIODS}, low AS (SELECT user_id, ts, CASE WHEN value < 60 THEN 0 ELSE value END AS value FROM events), {sql_bouts(-999999, 0, 'low', 'z')}, off AS (SELECT * FROM z WHERE {seconds()} >= 43200), {sql_complement('wear', 'off')}"""


def counts(spark, sf_dir):
    return values.collapse(signal(spark, sf_dir), [(0, 59.999999999, 0)])


@query(f"WITH {SQL_OFF} SELECT 'off' AS kind, * FROM off UNION ALL SELECT 'wear', * FROM wear")
def nonwear(spark, sf_dir):
    off, wear = inference.nonwear_counts(counts(spark, sf_dir), 12 * HOUR)
    return off.select(F.lit("off").alias("kind"), "*").unionByName(wear.select(F.lit("wear").alias("kind"), "*"))


@query(f"""WITH {SQL_DAYS}, {SQL_OFF}, bouts AS (SELECT * FROM wear) SELECT d.subject_id, d.start_ts, d.start_ts + INTERVAL 1 DAY AS end_ts,
coalesce(sum({seconds(*_DAILY)}) FILTER (b.subject_id IS NOT NULL), 0) >= 36000 AS valid FROM {SQL_DAY_BOUTS} GROUP BY d.subject_id, d.start_ts""")
def valid_days(spark, sf_dir):
    rows = counts(spark, sf_dir)
    bad, good = inference.valid_days(rows, inference.nonwear_counts(rows, 12 * HOUR)[1])
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query("""SELECT user_id AS subject_id, 'value' AS channel, ts, round(CASE WHEN value BETWEEN 30 AND 60 THEN 2 WHEN value BETWEEN 0 AND 40 THEN 1 ELSE value END, 6) AS value, false AS missing FROM events""")
def collapse(spark, sf_dir):
    return values.collapse(signal(spark, sf_dir), [(0, 40, 1), (30, 60, 2)])


@query("""SELECT user_id AS subject_id, 'value' AS channel, ts, CAST(coalesce(least(floor((value - lo) / nullif((hi - lo) / 10, 0)), 9), 0) AS DOUBLE) AS value, false AS missing
FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)""")
def collapse_auto(spark, sf_dir):
    return values.collapse_auto(signal(spark, sf_dir))


@query("""SELECT user_id AS subject_id, 'value' AS channel, ts, round((value - lo) / nullif(hi - lo, 0) * 10 - 5, 6) AS value, false AS missing
FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)""")
def normalise(spark, sf_dir):
    return values.normalise(signal(spark, sf_dir), -5, 5)


@query(f"""WITH {SQL_XYZ} SELECT subject_id, ts, round({SQL_VM}, 6) AS vm, round(greatest(({SQL_VM} - 1) * 1000, 0), 6) AS enmo, round(abs(({SQL_VM} - 1) * 1000), 6) AS enmo_a,
round(degrees(atan2(x, sqrt(y * y + z * z))), 6) AS pitch, round(degrees(atan2(y, sqrt(x * x + z * z))), 6) AS roll, round(x / nullif({SQL_VM}, 0), 6) AS sphere_x, round(y / nullif({SQL_VM}, 0), 6) AS sphere_y, round(z / nullif({SQL_VM}, 0), 6) AS sphere_z, round(0.01 + x * 1.02, 6) AS calibrated, round(x, 6) AS uncalibrated FROM xyz""")
def vm_enmo_pitch_roll(spark, sf_dir):
    rows = triaxial(spark, sf_dir).withColumn("vm", S.vector_magnitude("x", "y", "z"))
    fixed = S.calibrated("x", F.lit(0.01), F.lit(1.02))
    return rows.select("subject_id", "ts", "vm", S.enmo("vm").alias("enmo"), S.enmo_a("vm").alias("enmo_a"), S.pitch("x", "y", "z").alias("pitch"), S.roll("x", "y", "z").alias("roll"), *(S.on_sphere("x", "y", "z")[a].alias(f"sphere_{a}") for a in "xyz"), fixed.alias("calibrated"), S.uncalibrated(fixed, F.lit(0.01), F.lit(1.02)).alias("uncalibrated"))


def _still_sql() -> str:
    parts = []
    for a in "xyz":
        parts.append(f"w{a} AS (SELECT user_id, w AS ts, coalesce(stddev_pop(v.{a}), -1) AS value FROM (SELECT subject_id AS user_id, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND, INTERVAL 60 SECOND)) AS w, max(ts) AS hi, min(ts) AS lo FROM xyz GROUP BY subject_id) s LEFT JOIN xyz v ON v.subject_id = s.user_id AND v.ts >= s.w AND v.ts < s.w + INTERVAL 60 SECOND AND NOT (s.w = s.hi AND s.lo < s.hi) GROUP BY user_id, w)")
        parts.append(sql_bouts(0, 0.12, f"w{a}", f"r{a}"))
        parts.append(f"q{a} AS (SELECT * FROM r{a} WHERE {seconds()} >= 60)")
    return f"WITH {SQL_XYZ}, {', '.join(parts)}, {sql_intersection('xy', 'qx', 'qy')}, {sql_intersection('s', 'xy', 'qz')}"


@query(_still_sql() + " SELECT * FROM s")
def still_bouts(spark, sf_dir):
    return inference.still_bouts(axes(spark, sf_dir), window=60 * SECOND, limit=0.12)


def points(spark, sf_dir):
    return triaxial(spark, sf_dir).withColumn("n", F.lit(1))


@query(f"""WITH {SQL_XYZ} SELECT subject_id, {', '.join(f"CAST(count(*) FILTER (x {'>' if a == 'p' else '<'} 0 AND y {'>' if b == 'p' else '<'} 0 AND z {'>' if c == 'p' else '<'} 0) AS BIGINT) AS octant_{a}{b}{c}" for a in 'pm' for b in 'pm' for c in 'pm')} FROM xyz GROUP BY subject_id""")
def octants(spark, sf_dir):
    return inference.octants(points(spark, sf_dir))


@query(f"WITH {SQL_XYZ} SELECT subject_id, round(sqrt(sum((1 - {SQL_VM}) * (1 - {SQL_VM})) / count(*)), 6) AS rmse, CAST(count(*) AS BIGINT) AS points FROM xyz GROUP BY subject_id")
def calibration_rmse(spark, sf_dir):
    return inference.calibration_error(points(spark, sf_dir))


@query(f"""WITH {SQL_PERIODS}, {sql_bouts(20, 80)}, g AS (SELECT subject_id, lo, unnest(generate_series(0, CAST(floor((epoch_us(hi) - epoch_us(lo)) / 3600000000.0) AS BIGINT) - 1)) AS i FROM periods), t AS (SELECT subject_id, lo + i * INTERVAL 1 HOUR AS ts FROM g)
SELECT subject_id, ts, CAST(CASE WHEN EXISTS (SELECT 1 FROM bouts b WHERE b.subject_id = t.subject_id AND t.ts BETWEEN b.start_ts AND b.end_ts) THEN 1 ELSE 0 END AS DOUBLE) AS value FROM t""")
def bout_raster(spark, sf_dir):
    return B.raster(active(spark, sf_dir), inference.record_period(signal(spark, sf_dir)), HOUR)


@query("""WITH n AS (SELECT user_id, epoch_us(ts) AS us, value, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS zero, lead(epoch_us(ts)) OVER w AS us2, lead(value) OVER w AS value2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, unnest(generate_series(CAST(ceil((us - zero) / 21600000000.0) AS BIGINT), CAST(ceil((us2 - zero) / 21600000000.0) AS BIGINT) - 1)) AS k FROM n WHERE us2 > us)
SELECT user_id AS subject_id, 'value' AS channel, make_timestamp(zero + k * 21600000000) AS ts, round(value + (value2 - value) * ((zero + k * 21600000000 - us) / (us2 - us)), 6) AS value, false AS missing FROM k""")
def resample_linear(spark, sf_dir):
    return values.resample(signal(spark, sf_dir), 6 * HOUR)


@query("""SELECT user_id AS subject_id, 'value' AS channel, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 50) GROUP BY user_id""")
def append_union(spark, sf_dir):
    rows = signal(spark, sf_dir)
    both = append(rows, rows.where("value > 50"))
    return timeframe(both).join(both.groupBy("subject_id", "channel").agg(F.count("*").alias("n")), ["subject_id", "channel"])


_UNITS = ("day", "hour", "minute")
_STARTS = ", ".join(f"date_trunc('{u}', ts) AS {u}_start, date_trunc('{u}', ts) + INTERVAL 1 {u} - INTERVAL 1 MICROSECOND AS {u}_end" for u in _UNITS)


@query(f"""SELECT user_id AS subject_id, ts, round(sin((hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440), 6) AS sine,
round(cos((hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440), 6) AS cosine, {_STARTS}, ts = date_trunc('day', ts) AS midnight FROM events""")
def diurnal(spark, sf_dir):
    bounds = [c for u in _UNITS for c in (S.start_of(u, "ts").alias(f"{u}_start"), S.end_of(u, "ts").alias(f"{u}_end"))]
    return events(spark, sf_dir).select(
        F.col("user_id").alias("subject_id"), "ts", S.sine_wave("ts").alias("sine"), S.cosine_wave("ts").alias("cosine"), *bounds, S.is_midnight("ts").alias("midnight")
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(dayofyear(ts) AS INTEGER) AS doy FROM events""")
def time_parts(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", *S.time_parts("ts"))


@query("SELECT user_id AS job, CAST(ntile(7) OVER (ORDER BY user_id) AS INTEGER) AS shard FROM (SELECT DISTINCT user_id FROM events)")
def batch_shards(spark, sf_dir):
    return batch.shards(events(spark, sf_dir).select(F.col("user_id").alias("job")).distinct(), "job", 7)


@query("""SELECT user_id AS subject_id, 'value' AS channel, round(avg(g), 6) AS mean_gap, round(max(g), 6) AS max_gap, round(min(g), 6) AS min_gap FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000.0 AS g FROM events) GROUP BY user_id""")
def sampling_gaps(spark, sf_dir):
    return values.sampling_gaps(signal(spark, sf_dir))


@query("""SELECT user_id AS subject_id, ts, round(max(CASE WHEN event_type = 'purchase' THEN value END), 6) AS purchase, round(max(value), 6) AS value FROM events GROUP BY user_id, ts""")
def wide_channels(spark, sf_dir):
    rows = samples_from(events(spark, sf_dir), "user_id", "ts", value="value", purchase=F.when(F.col("event_type") == "purchase", F.col("value")))
    return wide(rows, "purchase", "value")


@query(f"""WITH {SQL_OFF}, w AS (SELECT subject_id, sum({seconds()}) AS wear_sum FROM wear GROUP BY subject_id), c AS (SELECT user_id AS subject_id, count(*) FILTER (value BETWEEN 20 AND 80) AS n FROM events GROUP BY user_id)
SELECT subject_id, round(n / nullif(wear_sum, 0), 6) AS value_20_80 FROM c JOIN w USING (subject_id)""")
def wear_proportions(spark, sf_dir):
    cuts = windows.summary(signal(spark, sf_dir), [Cutpoints(((20, 80),))])
    wear = B.total_time(inference.nonwear_counts(counts(spark, sf_dir), 12 * HOUR)[1]).select("subject_id", F.col("total").alias("wear_sum"))
    return batch.proportions(cuts.join(wear, "subject_id"), ["value_20_80"], "wear_sum").select("subject_id", "value_20_80")


_MEANINGS = {
    "value_mean": "Mean of value", "value_missing": "Number of missing samples of value", "value_0_20": "Samples of value from 0 to 20", "value_p11": "11th percentile of value", "value_p22": "22nd percentile of value",
    "value_1tr1": "Transitions of value from 1 to 1", "value_1tr2": "Transitions of value from 1 to 2", "value_2tr1": "Transitions of value from 2 to 1", "value_2tr2": "Transitions of value from 2 to 2",
}


@query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {chr(39)}{m}{chr(39)})' for n, m in _MEANINGS.items())}) AS t(name, meaning)")
def data_dictionary(spark, sf_dir):
    kept = dictionary("value", [Generic(("mean", "missing")), Cutpoints(((0, 20),)), Percentiles((11, 22)), Bigrams((1, 2))])
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS name, '{m}' AS meaning" for n, m in kept))


from . import inferred, recorded  # noqa: E402, F401  (they register their queries here, too)

__all__ = ["ORACLES", "QUERIES"]
