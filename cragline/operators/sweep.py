"""Shadow horizons of rasters under a sun from any side, cells (raster, r, c, z).

The sweep goes from the sun's side along the axis on which it moves more, a row (or column) a step: a cell's horizon is its own height or,
if that is more, what lies upstream in the row before, interpolated between two of that row's horizons, less the fall of a step. As each row
needs the one before, a raster is a task's, but the task holds two rows of it at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragline.operators import tiles


def horizons(cells: DataFrame, spacing: tuple[float, float], sun: tuple[float, float, float], single: bool = False) -> DataFrame:
    """(raster, r, c, horizon) of dense rasters: the height below which a cell lies in shadow. spacing is the length of a column and a
    row; sun points to the sun (east, north, up), rows go south. At night it is infinite, under a sun straight above the cell's own height.

    single: all arithmetic on rows in single precision. Void and absent cells have no horizon and throw no shadow.
    """
    east, south = sun[0] / spacing[0], -sun[1] / spacing[1]
    across_c = abs(east) >= abs(south)
    main, other = (east, south) if across_c else (south, east)
    known = cells.where(F.col("z").isNotNull() & ~F.isnan("z"))
    if sun[2] <= 0 or abs(main) < 1e-12:
        return known.select("raster", "r", "c", (F.lit(float("inf")) if sun[2] <= 0 else F.col("z").cast("double")).alias("horizon"))
    step, place = ("c", "r") if across_c else ("r", "c")
    kind = np.float32 if single else np.float64
    offset, fall = other / abs(main), kind(sun[2] / abs(main))
    shift = int(np.floor(offset))
    part = kind(offset - shift)

    # steps in the order of the sweep; a row is an array of (place, height)
    order = -F.col(step) if main > 0 else F.col(step)
    rows = known.select("raster", order.cast("int").alias("k"), F.struct(F.col(place).cast("int").alias("a"), F.col("z").cast("double").alias("z")).alias("p"))
    rows = rows.groupBy("raster", "k").agg(F.collect_list("p").alias("p"))  # as many as a raster is wide
    wide = tiles.extents(cells).select("raster", F.col("height" if across_c else "width").alias("n"))
    dealt = rows.join(wide, "raster").select("raster", "k", "n", "p").repartition("raster").sortWithinPartitions("raster", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raster, last_k, before = None, None, np.empty(0, kind)
        for batch in batches:
            for i in range(batch.num_rows):
                now, k, n = (batch.column(name)[i].as_py() for name in ("raster", "k", "n"))
                points = batch.column("p")[i].values
                at, z = points.field("a").to_numpy(), np.full(n, np.nan, kind)
                z[at] = points.field("z").to_numpy().astype(kind)
                upstream = np.full(n, np.nan, kind)
                if now == raster and k == last_k + 1:
                    first, last = max(0, -shift), n - shift - (part != 0)
                    first, last = min(first, n), max(min(last, n), min(first, n))
                    low = before[first + shift : last + shift]
                    upstream[first:last] = (low if part == 0 else low + (before[first + shift + 1 : last + shift + 1] - low) * part) - fall
                found = np.where(np.isnan(z), z, np.fmax(z, upstream))
                raster, last_k, before = now, k, found
                steps = np.full(len(at), -k if main > 0 else k, np.int32)
                r, c = (at, steps) if across_c else (steps, at)
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(at), batch.schema.field("raster").type), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(found[at].astype(np.float64))], ["raster", "r", "c", "horizon"])

    return dealt.mapInArrow(run, f"raster {cells.schema['raster'].dataType.simpleString()}, r int, c int, horizon double")
