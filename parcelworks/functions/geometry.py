"""Parcel geometry: well-known binary to nested rings, area and centroid of polygons with holes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: GeoJSON coordinates of a MultiPolygon: polygons, rings (the outer one first), points, and (x, y).
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
# Fixed values of well-known binary: kinds of geometry, and flags of its extended form.
POINT, POLYGON, MULTIPOINT, MULTIPOLYGON, Z, M, SRID = 1, 3, 4, 6, 0x80000000, 0x40000000, 0x20000000


def decode_wkb(data: bytes | None) -> list | None:
    """The rings of a Polygon or MultiPolygon as RINGS has them; null for null, other kinds, and bytes that do not end where
    they should. Both byte orders, the extended form with an SRID and further ordinates (left out) are read."""

    def shape(at: int) -> tuple[int, list]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        size = 2 + bool(kind & Z) + bool(kind & M) + (0, 1, 1, 2)[(kind & 0xFFFF) // 1000 % 4]  # ordinates of a point
        at += 9 if kind & SRID else 5
        kind = (kind & 0xFFFF) % 1000
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        found = []
        if kind == MULTIPOLYGON:
            for _ in range(n):
                at, inner = shape(at)
                found += inner
            return at, found
        if kind != POLYGON:
            raise ValueError("no polygon")
        for _ in range(n):
            (points,) = struct.unpack_from(order + "I", data, at)
            values = struct.unpack_from(f"{order}{points * size}d", data, at + 4)
            found.append([list(values[i : i + 2]) for i in range(0, len(values), size)])
            at += 4 + 8 * points * size
        return at, [found]

    if data is None:
        return None
    try:
        end, rings = shape(0)
    except (struct.error, ValueError, IndexError, RecursionError):
        return None
    return rings if end == len(data) else None


@F.pandas_udf(RINGS)
def rings(wkb: pd.Series) -> pd.Series:
    """decode_wkb() of a binary column."""
    return wkb.map(decode_wkb)


def _cross(ring: Column, what) -> Column:
    """The sum of ``what(p, q, p x q)`` over the edges of a ring; a ring that is not closed is closed by its first point.
    Points are taken from the first one on, which keeps the digits of small parcels far from the origin."""
    x0, y0 = ring[0][0], ring[0][1]
    near = F.transform(ring, lambda p: F.struct((p[0] - x0).alias("x"), (p[1] - y0).alias("y")))
    edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(near, i).alias("p"), F.get(near, F.when(i + 1 < F.size(ring), i + 1).otherwise(0)).alias("q")))
    return F.aggregate(F.when(F.size(ring) > 2, edges).otherwise(F.slice(edges, 1, 0)), F.lit(0.0), lambda s, e: s + what(e["p"], e["q"], e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))


def _ring_moments(ring: Column, sign: Column) -> Column:
    """area, and area times centroid, of a ring; holes (sign -1) count negative whichever way they turn."""
    area = _cross(ring, lambda p, q, c: c) / 2
    turn = F.when(area < 0, -sign).otherwise(sign)
    x = _cross(ring, lambda p, q, c: (p["x"] + q["x"]) * c) / 6
    y = _cross(ring, lambda p, q, c: (p["y"] + q["y"]) * c) / 6
    return F.struct((turn * area).alias("a"), (turn * (x + area * ring[0][0])).alias("x"), (turn * (y + area * ring[0][1])).alias("y"))


def _moments(multipolygon: Column) -> Column:
    """All rings' moments; outer rings count, holes count off."""
    one = lambda polygon: F.transform(F.filter(polygon, lambda r: F.size(r) > 0), lambda r, i: _ring_moments(r, F.when(i == 0, 1.0).otherwise(-1.0)))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(F.flatten(F.transform(multipolygon, one)), zero, lambda s, m: F.struct((s["a"] + m["a"]).alias("a"), (s["x"] + m["x"]).alias("x"), (s["y"] + m["y"]).alias("y")))


def area(multipolygon: Column) -> Column:
    """The area by the shoelace formula, holes off, in squared units of the coordinates; null for null."""
    return _moments(multipolygon)["a"]


def centroid(multipolygon: Column) -> Column:
    """The centroid as struct(lon, lat); null for null, and where there is no area."""
    m = _moments(multipolygon)
    return F.when(m["a"] != 0, F.struct((m["x"] / m["a"]).alias("lon"), (m["y"] / m["a"]).alias("lat")))
