"""Queries on the sun and on visibility events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cragline.functions import solar
from cragline.operators import events as ev
from cragline.plans import fixtures as fx
from cragline.session import table
from cragline.streaming import controls

AT_MS = 43_200_000
_TIME = {"day_of_year": "dayofyear(ts)", "year_days": "(CASE WHEN (year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 THEN 366.0 ELSE 365.0 END::DOUBLE)", "hour": "((epoch_us(ts) % 86400000000) / 3.6e9::DOUBLE)"}


def _sun_sql(want: str, lat: str, lon: str) -> str:
    return solar.position_sql(_TIME["day_of_year"], _TIME["year_days"], _TIME["hour"], lat, lon, want)


def _day_sql(want: str, second: str) -> str:
    return solar.position_sql("15", "366.0::DOUBLE", f"(({second})::DOUBLE / 3600)", f"{fx.LATITUDE}::DOUBLE", f"{fx.LONGITUDE}::DOUBLE", want)


def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    sun = solar.at_timestamp(F.col("ts"), F.col("lat"), F.col("lon"))
    at = fx.events(spark, sf_dir).withColumns({"lat": 40 + F.col("cell") % 20 * 1.0, "lon": F.col("cell") % 30 * 1.0 - 15})
    return at.select("event_id", *[F.round(sun[n], 6).alias(n) for n in ("azimuth", "altitude", "up")])


def solar_events_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's lit state by the sun at its events, the transitions, and the state at an instant by parity."""
    sun = solar.at_timestamp(F.col("ts"), F.lit(fx.LATITUDE), F.col("cell") % 30 * 1.0 - 15)
    states = fx.events(spark, sf_dir).withColumn("lit", sun["altitude"] > 0)
    flips = ev.transitions(states, ["t_us", "event_id"]).select("cell", "t_us")
    at = F.lit(1_705_320_000_000_000)
    happened = flips.groupBy("cell").agg(F.count(F.lit(1)).alias("n_transitions"), F.count_if(F.col("t_us") <= at).alias("n_before"))
    first = states.groupBy("cell").agg(F.min_by("lit", F.struct("t_us", "event_id")).alias("initial"))
    n = F.coalesce("n_before", F.lit(0))
    return first.join(happened, "cell", "left").select(
        "cell", "initial", F.coalesce("n_transitions", F.lit(0)).alias("n_transitions"), (F.col("initial") != (n % 2 == 1)).alias("lit")
    )


def solar_day_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand, the strongest light of the day on any of its surfaces, held to 0.1..1."""
    k = F.col("p_partkey")
    normal = {"nx": (k % 7 - 3) / 6.0, "ny": (k % 5 - 2) / 6.0}
    parts = table(spark, sf_dir, "part").select("p_brand", *[v.alias(n) for n, v in normal.items()])
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + 1)
    surfaces = parts.distinct().select("p_brand", (F.col("nx") / length).alias("nx"), (F.col("ny") / length).alias("ny"), (1 / length).alias("nz"))
    at = solar.at_second(fx.DAY, F.col("id"), F.lit(fx.LATITUDE), F.lit(fx.LONGITUDE))
    sun = spark.range(0, 86_400, 300).select(at["east"].alias("e"), at["north"].alias("n"), at["up"].alias("u")).where("u > 0")  # 288 at most
    light = F.col("nx") * F.col("e") + F.col("ny") * F.col("n") + F.col("nz") * F.col("u")
    peak = surfaces.crossJoin(F.broadcast(sun)).groupBy("p_brand").agg(F.max(light).alias("peak"))
    return peak.select("p_brand", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("peak"))), 6).alias("peak"))


def utc_day_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each local day and zone offset in use, the UTC dates it touches while the sun is above -2 degrees, and that of local noon."""
    days = fx.events(spark, sf_dir).select(F.to_date("ts").alias("day"), (F.col("cell") % 25 - 12).alias("zone")).distinct()
    start = F.col("day").cast("timestamp_ntz")
    samples = days.select("day", "zone", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("k"))
    utc = F.timestamp_add("MINUTE", (F.col("k") * 15 - F.col("zone") * 60).cast("int"), start)
    samples = samples.withColumn("utc", utc)
    sun = solar.at_timestamp(F.col("utc"), F.lit(fx.LATITUDE), F.col("zone") * 15.0)
    return samples.where((sun["altitude"] > -2) | (F.col("k") == 48)).select("day", "zone", F.to_date("utc").alias("utc_day")).distinct().select(
        F.col("day").cast("string").alias("local_day"), "zone", F.col("utc_day").cast("string").alias("utc_day")
    )


def event_parity_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial = fx.toggles(spark, sf_dir).select("cell").distinct().withColumn("initial", F.col("cell") % 3 == 0)
    return ev.state_at(initial, fx.toggles(spark, sf_dir), F.lit(AT_MS))


def event_bit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bit_words(event_parity_at(spark, sf_dir))


def event_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    return ev.reversals(e.select("cell", F.struct("t_us", "event_id").alias("k"), "value"))


def skyline_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon towards the sun at each event, and whether the sun is above it."""
    sun = solar.at_timestamp(F.col("ts"), F.lit(fx.LATITUDE), F.lit(fx.LONGITUDE))
    at = fx.events(spark, sf_dir).select("event_id", "cell", sun["azimuth"].alias("azimuth"), sun["altitude"].alias("altitude"))
    joined = at.join(fx.skylines(spark, sf_dir), "cell")
    horizon = ev.horizon_at(F.col("elevations"), F.col("azimuth"), fx.ANGLES)
    return joined.select("event_id", F.round(horizon.cast("double"), 3).alias("horizon"), (F.col("altitude").cast("float") > horizon).alias("above"))


def day_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.compile_day(fx.skylines(spark, sf_dir), fx.ANGLES, fx.DAY, fx.LATITUDE, fx.LONGITUDE, bounded=False)


def day_compile_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.compile_day(fx.skylines(spark, sf_dir), fx.ANGLES, fx.DAY, fx.LATITUDE, fx.LONGITUDE)


NOON = 43_200


def day_lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's state at noon, directly from the sun and its horizon."""
    lit = ev.lit_at(F.col("elevations"), fx.ANGLES, fx.DAY, NOON, fx.LATITUDE, fx.LONGITUDE)
    return fx.skylines(spark, sf_dir).select("cell", lit.alias("lit"))


def day_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from the day's compiled transitions: the state at the day's start, flipped by each one until noon."""
    skylines = fx.skylines(spark, sf_dir)
    initial = skylines.select("cell", ev.lit_at(F.col("elevations"), fx.ANGLES, fx.DAY, 0, fx.LATITUDE, fx.LONGITUDE).alias("initial"))
    return ev.state_at(initial, ev.compile_day(skylines, fx.ANGLES, fx.DAY, fx.LATITUDE, fx.LONGITUDE), F.lit(NOON * 1000))


def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t_ms, place, cell): transitions in order of time, with their place in it (equal times by cell)."""
    toggles = fx.toggles(spark, sf_dir).groupBy("t_ms", "cell").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("t_ms", "cell")
    within = F.row_number().over(Window.partitionBy("t_ms").orderBy("cell"))
    ends = ev.timeline(toggles).select("t_ms", (F.col("end") - F.col("n_events")).alias("before"))
    return toggles.withColumn("k", within).join(ends, "t_ms").select("t_ms", (F.col("before") + F.col("k")).alias("place"), "cell")


def control_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of controls: for each key the last value, and whether it was ever asked to persist."""
    k = F.col("event_id")
    patch = F.create_map(F.concat(F.lit("k"), (k % 3).cast("string")), F.col("value"), F.lit("last"), k.cast("double"))
    messages = fx.events(spark, sf_dir).select(F.col("cell").alias("control"), k.alias("seq"), patch.alias("patch"), F.when(k % 7 != 0, k % 50 == 0).alias("persist"))
    return controls.latest_patches(messages)


def day_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The UTC days of each cell's events, each once, in the order in which they first come by value."""
    first = fx.events(spark, sf_dir).groupBy("cell", F.to_date("ts").alias("day")).agg(F.min(F.struct("value", "event_id")).alias("first"))
    days = F.transform(F.array_sort(F.collect_list(F.struct("first", "day"))), lambda x: x["day"].cast("string"))  # a row a day
    return first.groupBy("cell").agg(F.array_join(days, ",").alias("days"))


ZONES = ("Europe/Zurich", "America/New_York", "Asia/Tokyo", "Asia/Kolkata", "Australia/Lord_Howe")


def zone_utc_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day with orders and each zone, the UTC dates that the local day touches, and its length in minutes."""
    days = table(spark, sf_dir, "orders").select(F.to_date(F.col("o_orderdate").cast("timestamp_ntz")).alias("day")).distinct()
    zoned = days.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in ZONES])))
    return zoned.select(F.col("day").cast("string").alias("local_day"), "zone", F.explode(ev.utc_dates("day", "zone")).alias("utc_day"), ev.minutes_of_day("day", "zone").alias("minutes")).select(
        "local_day", "zone", F.col("utc_day").cast("string").alias("utc_day"), "minutes"
    )


def day_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 05:00 to 21:00 of each day with events, an instant every 90 minutes."""
    days = fx.events(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    return days.select(F.explode(ev.bake_instants(F.col("day"), 90)).alias("at")).select(F.col("at").cast("string").alias("at"))


def skyline_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of skylines, each XOR the one before."""
    return ev.xor_deltas(_codes(spark, sf_dir))


def skyline_xor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.unxor(ev.xor_deltas(_codes(spark, sf_dir)))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.skylines(spark, sf_dir).select("cell", F.posexplode("elevations").alias("k", "e")).select("cell", "k", F.rint(F.col("e") * 1000).cast("long").alias("code"))


def skyline_delta_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.zigzag_deltas(_codes(spark, sf_dir))


def skyline_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.unzigzag(ev.zigzag_deltas(_codes(spark, sf_dir)))


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day of orders without events, the nearest day that has some (the earlier one of two)."""
    ready = fx.events(spark, sf_dir).select(F.to_date("ts").alias("ready")).distinct()  # a row a day: small
    asked = table(spark, sf_dir, "orders").select(F.to_date(F.col("o_orderdate").cast("timestamp_ntz")).alias("day")).distinct()
    missing = asked.join(ready, asked["day"] == ready["ready"], "left_anti")
    near = missing.crossJoin(F.broadcast(ready)).groupBy("day").agg(F.min(F.struct(F.abs(F.datediff("day", "ready")).alias("off"), "ready")).alias("x"))
    return near.select(F.col("day").cast("string").alias("day"), F.col("x.ready").cast("string").alias("nearest"))


_ELEV = f"[((cell * 31 + a * 17) % 70 / 2.0)::FLOAT FOR a IN range({fx.ANGLES})]"


def _horizon_sql(azimuth: str) -> str:
    q = f"(({azimuth}) * {fx.ANGLES} / 360::DOUBLE)"
    e = lambda i: f"(((cell * 31 + ({i}) % {fx.ANGLES} * 17) % 70) / 2.0)::FLOAT"
    return f"({e(f'floor({q})::BIGINT')} * (1 - ({q} - floor({q})))::FLOAT + {e(f'floor({q})::BIGINT + 1')} * ({q} - floor({q}))::FLOAT)::FLOAT"


_LIT = lambda second: f"({_day_sql('altitude', second)} > 0 AND {_day_sql('altitude', second)}::FLOAT > {_horizon_sql(_day_sql('azimuth', second))})"
_COMPILE = f"""
WITH RECURSIVE cells AS (SELECT c_custkey AS cell FROM customer),
states AS (SELECT cell, s, {_LIT('s')} AS lit FROM cells CROSS JOIN range(0, 86401, 600) t(s)),
changed AS (SELECT * FROM (SELECT cell, s, lit, lag(lit) OVER (PARTITION BY cell ORDER BY s) AS was FROM states) WHERE was <> lit),
bis(cell, was, lo, hi, depth) AS (
  SELECT cell, was, (s - 600)::DOUBLE, s::DOUBLE, 0 FROM changed
  UNION ALL SELECT cell, was, CASE WHEN same THEN mid ELSE lo END, CASE WHEN same THEN hi ELSE mid END, depth + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, {_LIT('(lo + hi) / 2')} = was AS same FROM bis WHERE depth < 14)
)
SELECT cell, round_even((lo + hi) / 2 * 1000, 0)::BIGINT AS t_ms FROM bis WHERE depth = 14
"""
_CODES = f"codes AS (SELECT c_custkey AS cell, k::INT AS k, ((c_custkey * 31 + k * 17) % 70 * 500)::BIGINT AS code FROM customer CROSS JOIN range({fx.ANGLES}) t(k))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "solar_position": solar_position,
    "solar_events_asof": solar_events_asof,
    "solar_day_peak": solar_day_peak,
    "utc_day_set": utc_day_set,
    "event_parity_at": event_parity_at,
    "event_csr_offsets": lambda s, d: ev.csr_offsets(fx.toggles(s, d)),
    "event_timeline_rle": lambda s, d: ev.timeline(fx.toggles(s, d)),
    "event_intervals": lambda s, d: ev.intervals(fx.toggles(s, d)),
    "event_histogram": lambda s, d: ev.histogram(fx.toggles(s, d)),
    "event_bit_words": event_bit_words,
    "event_reversals": event_reversals,
    "skyline_interp": skyline_interp,
    "day_compile": day_compile,
    "day_compile_bounded": day_compile_bounded,
    "skyline_delta_zigzag": skyline_delta_zigzag,
    "skyline_decode": skyline_decode,
    "control_patches": control_patches, "day_order": day_order, "missing_days": missing_days, "day_lit": day_lit, "day_replay": day_replay, "event_order": event_order, "zone_utc_days": zone_utc_days,
    "day_instants": day_instants, "skyline_xor": skyline_xor, "skyline_xor_decode": skyline_xor_decode,
}

_PARITY = f"""WITH {fx.TOGGLES} SELECT cell, (cell % 3 = 0) <> (count(*) FILTER (WHERE t_ms <= {AT_MS}) % 2 = 1) AS lit FROM toggles GROUP BY cell"""
ORACLES: dict[str, str] = {
    "solar_position": f"""SELECT event_id, {', '.join(f"round({_sun_sql(w, 'lat', 'lon')}, 6) AS {w}" for w in ('azimuth', 'altitude', 'up'))}
FROM (SELECT *, (40 + user_id % 20)::DOUBLE AS lat, (user_id % 30 - 15)::DOUBLE AS lon FROM events)""",
    "solar_events_asof": f"""
WITH states AS (SELECT user_id AS cell, epoch_us(ts) AS t_us, event_id, {_sun_sql('altitude', f'{fx.LATITUDE}::DOUBLE', '(user_id % 30 - 15)::DOUBLE')} > 0 AS lit FROM events),
marked AS (SELECT *, lag(lit) OVER (PARTITION BY cell ORDER BY t_us, event_id) AS was FROM states)
SELECT cell, arg_min(lit, struct_pack(t := t_us, e := event_id)) AS initial, count(*) FILTER (WHERE was <> lit) AS n_transitions,
       arg_min(lit, struct_pack(t := t_us, e := event_id)) <> (count(*) FILTER (WHERE was <> lit AND t_us <= 1705320000000000) % 2 = 1) AS lit
FROM marked GROUP BY cell""",
    "solar_day_peak": f"""
WITH surfaces AS (SELECT DISTINCT p_brand, (p_partkey % 7 - 3) / 6.0::DOUBLE AS nx, (p_partkey % 5 - 2) / 6.0::DOUBLE AS ny FROM part),
unit AS (SELECT p_brand, nx / sqrt(nx * nx + ny * ny + 1) AS nx, ny / sqrt(nx * nx + ny * ny + 1) AS ny, 1 / sqrt(nx * nx + ny * ny + 1) AS nz FROM surfaces),
sun AS (SELECT {_day_sql('east', 's')} AS e, {_day_sql('north', 's')} AS n, {_day_sql('up', 's')} AS u FROM range(0, 86400, 300) t(s))
SELECT p_brand, round(greatest(0.1, least(1.0, max(nx * e + ny * n + nz * u))), 6) AS peak FROM unit CROSS JOIN sun WHERE u > 0 GROUP BY p_brand""",
    "utc_day_set": f"""
WITH days AS (SELECT DISTINCT ts::DATE AS day, user_id % 25 - 12 AS zone FROM events),
samples AS (SELECT day, zone, k, day::TIMESTAMP + to_minutes((k * 15 - zone * 60)::BIGINT) AS ts FROM days CROSS JOIN range(96) t(k))
SELECT DISTINCT day::VARCHAR AS local_day, zone, ts::DATE::VARCHAR AS utc_day FROM samples
WHERE k = 48 OR {_sun_sql('altitude', f'{fx.LATITUDE}::DOUBLE', '(zone * 15.0::DOUBLE)')} > -2""",
    "event_parity_at": _PARITY,
    "event_csr_offsets": f"WITH {fx.TOGGLES}, n AS (SELECT cell, count(*) AS n_events FROM toggles GROUP BY cell) SELECT cell, n_events, (sum(n_events) OVER (ORDER BY cell) - n_events)::BIGINT AS \"offset\" FROM n",
    "event_timeline_rle": f"WITH {fx.TOGGLES}, n AS (SELECT t_ms, count(*) AS n_events FROM toggles GROUP BY t_ms) SELECT t_ms, n_events, sum(n_events) OVER (ORDER BY t_ms)::BIGINT AS \"end\" FROM n",
    "event_intervals": f"WITH {fx.TOGGLES}, k AS (SELECT *, row_number() OVER w AS k, lead(t_ms) OVER w AS end_ms FROM toggles WINDOW w AS (PARTITION BY cell ORDER BY t_ms)) SELECT cell, (k + 1) // 2 AS n, t_ms AS begin_ms, end_ms FROM k WHERE k % 2 = 1",
    "event_histogram": f"WITH {fx.TOGGLES}, n AS (SELECT cell, count(*) AS n_events FROM toggles GROUP BY cell) SELECT n_events, count(*) AS n_cells FROM n GROUP BY n_events",
    "event_bit_words": f"WITH s AS ({_PARITY}) SELECT cell // 32 AS word, sum(CASE WHEN lit THEN 1::BIGINT << (cell % 32)::INT ELSE 0 END)::BIGINT AS bits FROM s GROUP BY 1",
    "event_reversals": """
WITH steps AS (SELECT user_id AS cell, ts, event_id, sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events),
turned AS (SELECT cell, (step <> lag(step) OVER (PARTITION BY cell ORDER BY ts, event_id))::INT AS turn FROM steps WHERE step <> 0)
SELECT cell, count(*) AS n_changes, coalesce(sum(turn), 0)::BIGINT AS n_reversals FROM turned GROUP BY cell""",
    "skyline_interp": f"""
WITH seen AS (SELECT event_id, user_id AS cell, {_sun_sql('azimuth', f'{fx.LATITUDE}::DOUBLE', f'{fx.LONGITUDE}::DOUBLE')} AS az, {_sun_sql('altitude', f'{fx.LATITUDE}::DOUBLE', f'{fx.LONGITUDE}::DOUBLE')} AS alt
  FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
h AS (SELECT event_id, alt, {_horizon_sql('az')} AS h FROM seen)
SELECT event_id, round(h::DOUBLE, 3) AS horizon, alt::FLOAT > h AS above FROM h""",
    "day_compile": _COMPILE,
    "day_compile_bounded": _COMPILE,
    "skyline_delta_zigzag": f"WITH {_CODES}, d AS (SELECT cell, k, code - coalesce(lag(code) OVER (PARTITION BY cell ORDER BY k), 0) AS d FROM codes) SELECT cell, k, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS zz FROM d",
    "skyline_decode": f"WITH {_CODES} SELECT cell, k, code FROM codes",
    "control_patches": """
WITH m AS (SELECT user_id AS control, event_id AS seq, 'k' || event_id % 3 AS key, value, CASE WHEN event_id % 7 <> 0 THEN event_id % 50 = 0 END AS persist FROM events),
e AS (SELECT control, seq, key, value FROM m UNION ALL SELECT control, seq, 'last', seq::DOUBLE FROM m),
l AS (SELECT control, max(seq) AS seq, bool_or(coalesce(persist, false)) AS persist FROM m GROUP BY control)
SELECT e.control, key, arg_max(value, e.seq) AS value, any_value(persist) AS persist, any_value(l.seq) AS seq FROM e JOIN l ON l.control = e.control GROUP BY e.control, key""",
    "day_order": """
WITH d AS (SELECT user_id AS cell, ts::DATE AS day, min(struct_pack(v := value, e := event_id)) AS f FROM events GROUP BY ALL)
SELECT cell, string_agg(day::VARCHAR, ',' ORDER BY f, day) AS days FROM d GROUP BY cell""",
    "day_lit": f"SELECT c_custkey AS cell, {_LIT(NOON)} AS lit FROM (SELECT c_custkey, c_custkey AS cell FROM customer)",
    "day_replay": f"SELECT c_custkey AS cell, {_LIT(NOON)} AS lit FROM (SELECT c_custkey, c_custkey AS cell FROM customer)",
    "event_order": f"WITH {fx.TOGGLES}, odd AS (SELECT t_ms, cell FROM toggles GROUP BY ALL HAVING count(*) % 2 = 1) SELECT t_ms, row_number() OVER (ORDER BY t_ms, cell) AS place, cell FROM odd",
    "zone_utc_days": f"""
WITH days AS (SELECT DISTINCT o_orderdate::DATE AS day, zone FROM orders CROSS JOIN (SELECT unnest({list(ZONES)!r}) AS zone)),
ends AS (SELECT *, timezone('UTC', timezone(zone, day::TIMESTAMP)) AS lo, timezone('UTC', timezone(zone, (day + 1)::TIMESTAMP)) AS hi FROM days)
SELECT day::VARCHAR AS local_day, zone, unnest(generate_series(lo::DATE::TIMESTAMP, hi - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY))::DATE::VARCHAR AS utc_day, date_diff('minute', lo, hi) AS minutes FROM ends""",
    "day_instants": "SELECT strftime(d + to_minutes(300 + 90 * k), '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT DISTINCT ts::DATE::TIMESTAMP AS d FROM events) CROSS JOIN range(11) t(k)",
    "skyline_xor": f"WITH {_CODES} SELECT cell, k, xor(code, coalesce(lag(code) OVER (PARTITION BY cell ORDER BY k), 0)) AS x FROM codes",
    "skyline_xor_decode": f"WITH {_CODES} SELECT cell, k, code FROM codes",
    "missing_days": """
WITH ready AS (SELECT DISTINCT ts::DATE AS ready FROM events), asked AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day::VARCHAR AS day, arg_min(ready, struct_pack(o := abs(day - ready), r := ready))::VARCHAR AS nearest FROM asked CROSS JOIN ready
WHERE day NOT IN (SELECT ready FROM ready) GROUP BY day""",
}
