"""Visibility events: transitions by cell and time, replay at an instant, and a day's compilation from horizons.

A cell's state starts at ``initial`` and flips at every transition; an event at exactly t has happened, and events of equal
time cancel in pairs. Everything is partitioned by cell, so it scales with cells; instants of a day are a bounded list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cragline.functions import solar
from cragline.operators.scan import running_total


def by_cell(*order: str) -> WindowSpec:
    return Window.partitionBy("cell").orderBy(*order)


def transitions(states: DataFrame, order: list[str]) -> DataFrame:
    """Rows of (cell, ..., lit) where lit differs from the cell's previous row."""
    before = F.lag("lit").over(by_cell(*order))
    return states.withColumn("_before", before).where(F.col("_before").isNotNull() & (F.col("_before") != F.col("lit"))).drop("_before")


def initial_states(states: DataFrame, order: str) -> DataFrame:
    """(cell, initial): each cell's first state."""
    return states.groupBy("cell").agg(F.min_by("lit", order).alias("initial"))


def parity_at(events: DataFrame, at: Column) -> DataFrame:
    """(cell, flipped): whether an odd number of the cell's events (cell, t_ms) have happened by at, inclusive."""
    return events.groupBy("cell").agg((F.count_if(F.col("t_ms") <= at) % 2 == 1).alias("flipped"))


def state_at(initial: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """(cell, lit) at an instant; cells without events keep their initial state."""
    joined = initial.join(parity_at(events, at), "cell", "left")
    return joined.select("cell", (F.col("initial") != F.coalesce("flipped", F.lit(False))).alias("lit"))


def csr_offsets(events: DataFrame) -> DataFrame:
    """(cell, n_events, offset): how many events a cell has, and how many lie in cells before it."""
    counts = events.groupBy("cell").agg(F.count(F.lit(1)).alias("n_events"))
    return running_total(counts, "cell", "n_events", "upto").select("cell", "n_events", (F.col("upto") - F.col("n_events")).alias("offset"))


def timeline(events: DataFrame) -> DataFrame:
    """(t_ms, n_events, end): run-length timeline; end is the number of events up to and at t_ms."""
    return running_total(events.groupBy("t_ms").agg(F.count(F.lit(1)).alias("n_events")), "t_ms", "n_events", "end")


def intervals(events: DataFrame) -> DataFrame:
    """(cell, n, begin_ms, end_ms): half-open spans between an odd event of a cell and the next; the last may stay open."""
    order = by_cell("t_ms")
    placed = events.select("cell", "t_ms", F.row_number().over(order).alias("k"), F.lead("t_ms").over(order).alias("end_ms"))
    return placed.where("k % 2 = 1").select("cell", ((F.col("k") + 1) / 2).cast("long").alias("n"), F.col("t_ms").alias("begin_ms"), "end_ms")


def histogram(events: DataFrame) -> DataFrame:
    """(n_events, n_cells)."""
    return events.groupBy("cell").agg(F.count(F.lit(1)).alias("n_events")).groupBy("n_events").agg(F.count(F.lit(1)).alias("n_cells"))


def bit_words(states: DataFrame, width: int = 32) -> DataFrame:
    """(word, bits): the lit cells packed, the lowest cell in the lowest bit."""
    bit = F.when(F.col("lit"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % width).cast("int"))).otherwise(F.lit(0).cast("long"))
    return states.select(F.floor(F.col("cell") / width).alias("word"), bit.alias("bit")).groupBy("word").agg(F.sum("bit").alias("bits"))


def reversals(samples: DataFrame) -> DataFrame:
    """(cell, n_changes, n_reversals) of samples (cell, k, value): steps that move, and turns of direction between such steps."""
    order = by_cell("k")
    steps = samples.withColumn("step", F.signum(F.col("value") - F.lag("value").over(order))).where("step <> 0")
    turned = steps.withColumn("turn", (F.col("step") != F.lag("step").over(order)).cast("long"))
    return turned.groupBy("cell").agg(F.count(F.lit(1)).alias("n_changes"), F.coalesce(F.sum("turn"), F.lit(0)).alias("n_reversals"))


def horizon_at(elevations: Column, azimuth: Column, angles: int) -> Column:
    """Horizon of a cell (array of FLOAT, one for each of so many azimuths) at an azimuth, interpolated in FLOAT around the circle."""
    q = F.pmod(azimuth, F.lit(360.0)) * angles / 360
    i = F.floor(q)
    left, right = (1 - (q - i)).cast("float"), (q - i).cast("float")
    return (F.get(elevations, (i % angles).cast("int")) * left + F.get(elevations, ((i + 1) % angles).cast("int")) * right).cast("float")


def lit_at(elevations: Column, angles: int, day: str, second: float, latitude: float, longitude: float) -> Column:
    """Whether a cell is lit at a second of a UTC date: the sun is above 0 and, as FLOAT, above the horizon."""
    azimuth, altitude = (float(x) for x in solar.of_day(day, np.float64(second), latitude, longitude))
    return F.lit(altitude > 0) & (F.lit(altitude).cast("float") > horizon_at(elevations, F.lit(azimuth), angles))


def _lit(horizons: np.ndarray, azimuth: np.ndarray, altitude: np.ndarray) -> np.ndarray:
    """lit_at for rows of horizons (FLOAT), each with its own sun."""
    angles = horizons.shape[1]
    q = azimuth * angles / 360
    i = np.floor(q).astype(np.int64)
    f, row = (q - i).astype(np.float32), np.arange(len(horizons))
    left = (1 - (q - i)).astype(np.float32)
    return (altitude > 0) & (altitude.astype(np.float32) > horizons[row, i % angles] * left + horizons[row, (i + 1) % angles] * f)


def compile_day(
    skylines: DataFrame, angles: int, day: str, latitude: float, longitude: float, step: int = 600, precision: float = 0.05, bounded: bool = True
) -> DataFrame:
    """(cell, t_ms) of a day's transitions, from skylines (cell, elevations).

    States are sampled every step seconds, both ends of the day included, and each change is bisected until it is known to precision
    seconds. bounded: of each hour, only cells whose horizon lies between the lowest and highest sun are sampled; the others keep one
    state, so the result is the same. Cells are independent: no shuffle, and a task sees a batch of them at a time.
    """
    seconds = np.arange(0, 86_400 + step, step, dtype=np.float64)
    seconds = np.append(seconds[seconds < 86_400], 86_400.0)
    halvings = max(0, math.ceil(math.log2(step / precision)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        azimuth, altitude = solar.of_day(day, seconds, latitude, longitude)
        for batch in batches:
            cell = batch.column(0)
            horizons = np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, angles)
            rows, at = [], []
            for block in filter(len, np.array_split(np.arange(1, len(seconds)), 24)):
                ends = np.append(block[0] - 1, block)
                if altitude[ends].max() <= 0:
                    continue
                met = np.arange(len(horizons))
                if bounded and altitude[ends].min() > 0:
                    knots = np.arange(math.floor(azimuth[ends].min() * angles / 360), math.floor(azimuth[ends].max() * angles / 360) + 2) % angles
                    low, high = horizons[:, knots].min(axis=1), horizons[:, knots].max(axis=1)
                    margin = 1e-4  # wider than any rounding of FLOAT interpolation
                    met = np.flatnonzero((high + margin >= altitude[ends].min()) & (low - margin < altitude[ends].max()))
                lit = np.stack([_lit(horizons[met], azimuth[k : k + 1], altitude[k : k + 1]) for k in ends], axis=1)
                changed, k = np.nonzero(lit[:, 1:] != lit[:, :-1])
                rows.append(met[changed])
                at.append(block[k])
            row, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, at))
            low, high = seconds[k - 1], seconds[k]
            was = _lit(horizons[row], azimuth[k - 1], altitude[k - 1])
            for _ in range(halvings):
                middle = (low + high) / 2
                same = _lit(horizons[row], *solar.of_day(day, middle, latitude, longitude)) == was
                low, high = np.where(same, middle, low), np.where(same, high, middle)
            times = np.rint((low + high) / 2 * 1000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([cell.take(pa.array(row)), pa.array(times)], ["cell", "t_ms"])

    kind = skylines.schema["cell"].dataType.simpleString()
    return skylines.select("cell", F.col("elevations").cast("array<float>")).mapInArrow(run, f"cell {kind}, t_ms long")


def zigzag_deltas(codes: DataFrame) -> DataFrame:
    """(cell, k, zz): differences along k, folded to non-negative numbers, of codes (cell, k, code)."""
    delta = F.col("code") - F.coalesce(F.lag("code").over(by_cell("k")), F.lit(0))
    return codes.select("cell", "k", delta.cast("long").alias("d")).select("cell", "k", F.shiftleft("d", 1).bitwiseXOR(F.shiftright("d", 63)).alias("zz"))


def unzigzag(deltas: DataFrame) -> DataFrame:
    """(cell, k, code) back from zigzag_deltas."""
    delta = F.shiftrightunsigned("zz", 1).bitwiseXOR(-F.col("zz").bitwiseAND(F.lit(1).cast("long")))
    upto = by_cell("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select("cell", "k", F.sum(delta).over(upto).alias("code"))


def xor_deltas(codes: DataFrame) -> DataFrame:
    """(cell, k, x): each code XOR the one before it along k."""
    return codes.select("cell", "k", F.col("code").bitwiseXOR(F.coalesce(F.lag("code").over(by_cell("k")), F.lit(0))).alias("x"))


def unxor(deltas: DataFrame) -> DataFrame:
    """(cell, k, code) back from xor_deltas."""
    upto = by_cell("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select("cell", "k", F.bit_xor("x").over(upto).alias("code"))


def _begins(day: Column, zone: Column) -> Column:
    """The UTC instant (without zone) at which a local day of an IANA zone begins; where midnight doesn't exist, the first instant after."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def utc_dates(day: str, zone: str) -> Column:
    """Array of the UTC dates that a local day touches."""
    last = _begins(F.date_add(day, 1), F.col(zone)) - F.expr("INTERVAL 1 MICROSECOND")
    return F.sequence(F.to_date(_begins(F.col(day), F.col(zone))), F.to_date(last))


def minutes_of_day(day: str, zone: str) -> Column:
    """Length of a local day: 1440, or another on days that change the offset."""
    return F.timestamp_diff("MINUTE", _begins(F.col(day), F.col(zone)), _begins(F.date_add(day, 1), F.col(zone)))


def bake_instants(day: Column, step_minutes: int) -> Column:
    """Array of instants from 05:00 to 21:00 of a day, both included where the step meets them."""
    start = day.cast("timestamp_ntz")
    return F.transform(F.sequence(F.lit(300), F.lit(1260), F.lit(step_minutes)), lambda m: F.timestamp_add("MINUTE", m, start))
