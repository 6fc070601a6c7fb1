"""Parcel geometry against plain Python, and exports as one document made of parallel parts."""

import csv
import io
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from parcelworks.functions import geometry
from parcelworks.plans import catalogue
from parcelworks.sources import documents, export

DATA = "/root/testdata/sf0.001"


def wkb(polygons, order="<", srid=None, z=False, multi=True):
    def one(rings):
        head = struct.pack(order + "BI", order == "<", geometry.POLYGON | (geometry.Z if z else 0))
        return head + struct.pack(order + "I", len(rings)) + b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "dd", *p) + (struct.pack(order + "d", 9.0) if z else b"") for p in r) for r in rings)

    if not multi:
        return one(polygons[0])
    kind = geometry.MULTIPOLYGON | (geometry.SRID if srid else 0) | (geometry.Z if z else 0)
    return struct.pack(order + "BI", order == "<", kind) + (struct.pack(order + "I", srid) if srid else b"") + struct.pack(order + "I", len(polygons)) + b"".join(map(one, polygons))


def moments_by_definition(polygons):
    total, mx, my = 0.0, 0.0, 0.0
    for rings in polygons:
        for n, ring in enumerate(rings):
            x0, y0 = ring[0]
            edges = [((a[0] - x0, a[1] - y0), (b[0] - x0, b[1] - y0)) for a, b in zip(ring, [*ring[1:], ring[0]])]
            cross = [(p, q, p[0] * q[1] - q[0] * p[1]) for p, q in edges]
            area = sum(c for _, _, c in cross) / 2
            sign = (1 if n == 0 else -1) * (-1 if area < 0 else 1)
            total += sign * area
            mx += sign * (sum((p[0] + q[0]) * c for p, q, c in cross) / 6 + area * x0)
            my += sign * (sum((p[1] + q[1]) * c for p, q, c in cross) / 6 + area * y0)
    return total, mx / total if total else None, my / total if total else None


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]


def test_polygons_with_holes(spark):
    rng = random.Random(1)
    far = [(77.5 + rng.random() / 1000, 28.6 + rng.random() / 1000) for _ in range(7)]
    shapes = [[[SQUARE]], [[SQUARE, HOLE]], [[SQUARE[::-1], HOLE]], [[SQUARE, HOLE[::-1]], [[(x + 10, y) for x, y in SQUARE]]], [[[*far, far[0]]]], [[far]]]
    rows = [(n, wkb(s, "<>"[n % 2], srid=4326 if n % 3 else None, z=n == 2)) for n, s in enumerate(shapes)]
    rows += [(10, wkb([[SQUARE]], multi=False)), (11, None), (12, b"\x01"), (13, wkb([[SQUARE]]) + b"x"), (14, struct.pack("<BIdd", 1, geometry.POINT, 1, 2)), (15, wkb([])), (16, b""), (17, struct.pack("<BI", 1, 1003) + struct.pack("<II", 1, 4) + b"".join(struct.pack("<ddd", *p, 5) for p in SQUARE[:4]))]
    made = spark.createDataFrame(rows, "n int, wkb binary").withColumn("rings", geometry.rings("wkb"))
    found = {r.n: r for r in made.select("n", "rings", geometry.area(F.col("rings")).alias("area"), geometry.centroid(F.col("rings")).alias("at")).collect()}
    for n, s in enumerate(shapes):
        area, x, y = moments_by_definition(s)
        assert found[n].rings == [[[list(p) for p in ring] for ring in polygon] for polygon in s]
        assert found[n].area == pytest.approx(area, rel=1e-9) and (found[n].at.lon, found[n].at.lat) == (pytest.approx(x, rel=1e-12), pytest.approx(y, rel=1e-12))
    assert found[1].area == 15 and found[3].area == 31 and found[10].area == 16 and found[17].area == 16
    assert all(found[n].rings is None and found[n].area is None and found[n].at is None for n in (11, 12, 13, 14, 16))
    assert found[15].rings == [] and found[15].area == 0 and found[15].at is None


def test_one_feature_collection_of_many_parts(spark, tmp_path):
    _, parcels, owners, _, routed = catalogue._reported(spark, DATA)
    villages = catalogue.load(spark, DATA, "v_villages")[0]
    shaped = parcels.withColumn("rings", F.when(F.col("pos") == 0, F.array(F.array(F.array(F.array("lon", "lat"), F.array(F.col("lon") + 1, "lat"), F.array("lon", F.col("lat") + 1), F.array("lon", "lat"))))))
    shaped = shaped.withColumn("lat", F.when(F.col("pos") != 2, F.col("lat")))
    rows = export.geojson_lines(routed, shaped, owners, villages, only_approved=False)
    export.export_geojson(rows, str(tmp_path / "one"), collection=True)
    assert [p.name for p in (tmp_path / "one").iterdir() if not p.name.endswith(".crc")] == ["export.geojson"]
    whole = json.loads((tmp_path / "one/export.geojson").read_text())
    assert [whole[k] for k in ("type", "name", "crs")] == ["FeatureCollection", "DILRMP_RoR_Export", {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::4326"}}]
    want = [json.loads(r.feature) for r in rows.orderBy("khata_id", "pos").collect()]
    assert whole["features"] == want and len(want) > 1000
    assert {(f["geometry"] or {}).get("type") for f in want} == {"MultiPolygon", "Point", None}
    with pytest.raises(FileExistsError):
        export.export_geojson(rows, str(tmp_path / "one"), collection=True)
    export.export_geojson(rows.limit(0), str(tmp_path / "none"), collection=True)
    assert json.loads((tmp_path / "none/export.geojson").read_text())["features"] == []
    assert not [p for p in tmp_path.iterdir() if p.name not in ("one", "none")]  # nothing is left aside


def test_document_of_parts_in_order(spark, tmp_path):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("ü"), F.col("id").cast("string"))).alias("line")).repartition(7)
    documents.write(rows, str(tmp_path / "a/doc.txt"), "line", ["id"], "<", ">", separator="€")
    want = "<" + "\n€".join(f"ü{i}" for i in range(5000) if i % 7) + "\n>"
    assert (tmp_path / "a/doc.txt").read_text() == want
    bad = rows.withColumn("line", F.when(F.col("id") == 99, F.raise_error(F.lit("bad line")).cast("string")).otherwise(F.col("line")))
    with pytest.raises(Exception, match="bad line"):
        documents.write(bad, str(tmp_path / "b/doc.txt"), "line", ["id"], "<", ">")
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_csv_in_one_file(spark, tmp_path):
    rows = [("2", 'a "b", c', None), ("10", "line\nbreak", "x"), ("1", "", " y ")]
    table = spark.createDataFrame([(k, n, v) for k, n, v in rows], "khata_number string, khasra_number string, note string")
    export.export_csv(table, str(tmp_path / "one"), single_file=True)
    text = (tmp_path / "one/export.csv").read_bytes().decode("utf-8-sig")
    assert list(csv.reader(io.StringIO(text))) == [["khata_number", "khasra_number", "note"], ["1", "", " y "], ["10", "line\nbreak", "x"], ["2", 'a "b", c', ""]]
