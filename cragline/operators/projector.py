"""Projectors over a mesh: where a place on the map shows in the projected picture, and whether the projector's light reaches it."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.operators import plane
from cragline.session import written


class Projector(NamedTuple):
    """A lens at a place that looks at the origin, turned by roll (radians). The picture is throw times as far away as it is wide."""

    place: tuple[float, float, float]
    roll: float
    throw: float
    width: int
    height: int
    shift: tuple[float, float] = (0.0, 0.0)
    mirror: bool = False

    def matrix(self) -> np.ndarray:
        """3 x 4: from (x, y, z, 1) to (u, v, 1) times the depth along the optical axis."""
        eye = np.array(self.place)
        axis = -eye / np.linalg.norm(eye)
        side = np.cross(axis, (0.0, 1.0, 0.0))
        if np.linalg.norm(side) < 1e-9:
            raise ValueError("a projector can't look along the y axis")
        side /= np.linalg.norm(side)
        turned = complex(math.cos(self.roll), math.sin(self.roll)) * (side - 1j * np.cross(axis, side))
        focal = self.width * self.throw
        centre = np.array([self.width / 2 + self.shift[0], self.height / 2 + self.shift[1]])
        rows = np.array([focal * turned.real + centre[0] * axis, -focal * turned.imag + centre[1] * axis, axis])
        if self.mirror:
            rows[0] = self.width * axis - rows[0]
        return np.column_stack((rows, -rows @ eye))


def shown(x: Column, y: Column, z: Column, matrix: np.ndarray) -> dict[str, Column]:
    """u, v and depth of a place in the picture; u and v are null behind the lens."""
    u, v, depth = (row[0] * x + row[1] * y + row[2] * z + row[3] for row in matrix.tolist())
    ahead = F.when(depth > 0, depth)
    return {"u": u / ahead, "v": v / ahead, "depth": depth}


def point_query(places: DataFrame, triangles: DataFrame, projector: Projector, size: float, tolerance: float = 0.02) -> DataFrame:
    """(id, z, u, v, status) of places (id, x, y, ox, oy): the mesh's height there, where that shows in the picture of a projector that stands
    over (ox, oy), and whether it is 'visible', 'hidden' (the projector's ray meets something else first, further than the tolerance),
    'outside' the picture, or a 'miss' of the mesh (then all else is null).

    Two rounds of rays: straight down for the height, then from the lens to what was hit.
    """
    triangles = written(triangles, "mesh")  # read by both rounds
    top = triangles.agg((F.max(F.greatest("z1", "z2", "z3")) + 100.0).alias("oz"))  # one row
    down = places.crossJoin(F.broadcast(top)).select(F.col("id").alias("ray"), F.col("x").alias("ox"), F.col("y").alias("oy"), "oz", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"))
    under = plane.first_hits(down, triangles, size).select(F.col("ray").alias("id"), "t")
    hit = places.join(under, "id", "left").crossJoin(F.broadcast(top)).withColumn("z", F.col("oz") - F.col("t")).drop("oz", "t")
    ex, ey, ez = (F.lit(p) for p in projector.place)
    way = {"dx": F.col("x") - F.col("ox") - ex, "dy": F.col("y") - F.col("oy") - ey, "dz": F.col("z") - ez}
    far = F.sqrt(sum((v * v for v in way.values()), F.lit(0.0)))
    aimed = hit.where("z IS NOT NULL").withColumn("far", far)
    sent = aimed.select(F.col("id").alias("ray"), (F.col("ox") + ex).alias("ox"), (F.col("oy") + ey).alias("oy"), ez.alias("oz"), *[(v / F.col("far")).alias(k) for k, v in way.items()])
    first = plane.first_hits(sent, triangles, size).select(F.col("ray").alias("id"), F.col("t").alias("first"))
    seen = shown(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("z"), projector.matrix())
    found = hit.withColumn("far", far).join(first, "id", "left").withColumns({"u": seen["u"], "v": seen["v"]})
    inside = (F.col("u") >= 0) & (F.col("u") < projector.width) & (F.col("v") >= 0) & (F.col("v") < projector.height)
    reached = F.abs(F.col("first") - F.col("far")) < tolerance
    status = F.when(F.col("z").isNull(), "miss").when(~F.coalesce(inside, F.lit(False)), "outside").when(F.coalesce(reached, F.lit(False)), "visible").otherwise("hidden")
    return found.select("id", "z", "u", "v", status.alias("status"))
