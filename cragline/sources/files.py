"""Readers and writers of the formats around terrain work: GPX, gazetteers, height tiles, STL meshes, OBJ lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a gazetteer dump.
GAZETTEER = (
    "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, class string, code string, country string, "
    "cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation string, dem string, timezone string, modified string"
)
#: Fixed value: a height tile's mark for no data.
VOID = -32768

_GPX = "trk array<struct<trkseg:array<struct<trkpt:array<struct<_lat:string,_lon:string,ele:string,time:string>>>>>>"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(path, trk, seg, idx, lat, lon, ele, ts) of GPX files, points in order; a point without a valid place has null lat and lon,
    a missing elevation is 0."""
    files = spark.read.format("xml").option("rowTag", "gpx").schema(_GPX).load(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode("trk").alias("trk", "t"))
    segments = files.select("path", "trk", F.posexplode("t.trkseg").alias("seg", "s"))
    points = segments.select("path", "trk", "seg", F.posexplode("s.trkpt").alias("idx", "p"))
    lat, lon = F.col("p._lat").try_cast("double"), F.col("p._lon").try_cast("double")
    valid = lat.between(-90, 90) & lon.between(-180, 180)
    return points.select(
        "path", "trk", "seg", "idx", F.when(valid, lat).alias("lat"), F.when(valid, lon).alias("lon"),
        F.coalesce(F.col("p.ele").try_cast("double"), F.lit(0.0)).alias("ele"), F.to_timestamp_ntz(F.regexp_replace("p.time", "Z$", "")).alias("ts"),
    )


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tab-separated gazetteer dumps with all 19 fields; shorter lines are left out."""
    rows = spark.read.schema(GAZETTEER).option("sep", "\t").option("quote", "").csv(path)
    return rows.where(F.col("timezone").isNotNull())


def peaks(gazetteer: DataFrame) -> DataFrame:
    return gazetteer.where((F.col("class") == "T") & F.col("code").isin("PK", "PKS", "MT"))


def read_height_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(lat0, lon0, r, c, z) of height tiles named by their south-west corner (N45E006.hgt): square, big-endian 16-bit, north first;
    voids are null. A tile is decoded by itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path).select("path", "content")
    ns, ew = F.regexp_extract("path", r"([NS])(\d+)([EW])(\d+)\.hgt$", 1), F.regexp_extract("path", r"([NS])(\d+)([EW])(\d+)\.hgt$", 3)
    number = lambda i: F.regexp_extract("path", r"([NS])(\d+)([EW])(\d+)\.hgt$", i).cast("int")
    named = files.select(F.when(ns == "S", -number(2)).otherwise(number(2)).alias("lat0"), F.when(ew == "W", -number(4)).otherwise(number(4)).alias("lon0"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lat0, lon0, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                z = np.frombuffer(content.as_py(), ">i2").astype(np.int32)
                side = int(len(z) ** 0.5)
                if side * side != len(z):
                    raise ValueError("a height tile is not square")
                n = np.arange(len(z), dtype=np.int32)
                columns = [pa.array(np.full(len(z), v.as_py(), np.int32)) for v in (lat0, lon0)] + [pa.array(n // side), pa.array(n % side), pa.array(z, mask=z <= VOID)]
                yield pa.RecordBatch.from_arrays(columns, ["lat0", "lon0", "r", "c", "z"])

    return named.mapInArrow(decode, "lat0 int, lon0 int, r int, c int, z int")


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """(path, tri, x1, y1, z1, .. z3) of binary STL files. A file whose length doesn't fit its count, or a value that isn't finite,
    raises an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.stl").load(path).select("path", "content")
    names = [f"{a}{i}" for i in (1, 2, 3) for a in "xyz"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = np.dtype([("normal", "<f4", 3), ("v", "<f4", 9), ("attribute", "<u2")])
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_py()
                n = int.from_bytes(raw[80:84], "little")
                if len(raw) != 84 + 50 * n:
                    raise ValueError(f"{file} has another length than {n} triangles")
                v = np.frombuffer(raw, record, offset=84)["v"]
                if not np.isfinite(v).all():
                    raise ValueError(f"{file} has values that are not finite")
                columns = [pa.array([file.as_py()] * n), pa.array(np.arange(n, dtype=np.int64))] + [pa.array(np.ascontiguousarray(v[:, i])) for i in range(9)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "tri", *names])

    return files.mapInArrow(decode, "path string, tri long, " + ", ".join(f"{n} float" for n in names))


def upward(triangles: DataFrame) -> DataFrame:
    """Triangles whose cross product looks up by more than 1e-12."""
    ux, uy, wx, wy = (F.col(a).cast("double") - F.col(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("x3", "x1"), ("y3", "y1")))
    return triangles.where(ux * wy - uy * wx > 1e-12)


def mesh_bounds(triangles: DataFrame) -> DataFrame:
    ends = [f(g(*[F.col(f"{a}{i}") for i in (1, 2, 3)])).alias(f"{name}_{a}") for a in "xyz" for name, f, g in (("min", F.min, F.least), ("max", F.max, F.greatest))]
    return triangles.groupBy("path").agg(*ends)


def write_obj_lines(points: DataFrame, path: str) -> None:
    """Lines (line, idx, x, y, z) as OBJ text, one file a partition of lines: vertices, then an l row with relative numbers."""
    vertex = F.format_string("v %.6f %.6f %.6f", "x", "y", "z")
    lines = points.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("idx", vertex.alias("v")))).alias("p"))
    numbers = F.transform(F.sequence(F.size("p"), F.lit(1), F.lit(-1)), lambda i: (-i).cast("string"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["v"]), "\n"), F.lit("\nl "), F.array_join(numbers, " "))
    lines.select(text.alias("value")).write.text(path)
