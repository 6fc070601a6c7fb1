"""Register exports: CSV, GeoJSON lines, the export view."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.operators.register import approved_only, by_village, join_owners, join_village
from parcelworks.sources import documents

# Fixed value: the columns of the CSV export, in order.
CSV_COLUMNS = (
    "state", "district", "tehsil", "village_code", "village_name", "khata_number", "fasli_year", "khasra_number", "ulpin", "plot_area_sqm", "land_classification", "khata_total_area_sqm",
    "owner_names", "owner_shares", "confidence_score", "approval_status",
)


def _text(c, scale: int | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c.cast(f"decimal(22,{scale})") if scale is not None else c).cast("string"), F.lit(""))


def _optional(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def csv_rows(khata: DataFrame, parcels: DataFrame, owners: DataFrame, villages: DataFrame, village: str | None = None, only_approved: bool = True) -> DataFrame:
    """One row for each parcel, all text: areas and score with 4 decimals, shares with 2, nulls empty."""
    head = join_village(join_owners(by_village(approved_only(khata, only_approved), village), owners), villages, "left")
    rows = parcels.join(head, "khata_id")
    values = {
        "ulpin": _text(_optional(rows, "ulpin")), "khata_number": _text("khata_number"), "khasra_number": _text("khasra_number"), "village_code": _text("village_code"), "village_name": _text("village_name"), "tehsil": _text("tehsil"), "district": _text("district"), "state": _text("state"),
        "plot_area_sqm": _text("plot_area_sqm", 4), "khata_total_area_sqm": _text("total_area_sqm", 4), "land_classification": _text(_optional(rows, "land_classification")), "owner_names": _text("owner_names"), "owner_shares": _text("owner_shares"),
        "fasli_year": _text(_optional(rows, "fasli_year")), "approval_status": _text("approval_status"), "confidence_score": _text("final_score", 4),
    }
    return rows.select(*[values[c].alias(c) for c in CSV_COLUMNS])


def export_csv(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """Write CSV with a header, sorted by khata number. A folder of files, each with a header and sorted in itself; or with
    ``single_file`` export.csv there, in order over all, which begins with a byte order mark."""
    if not single_file:
        return rows.sortWithinPartitions("khata_number", "khasra_number").write.mode("errorifexists").option("emptyValue", "").csv(path, header=True, encoding="UTF-8")
    quoted = lambda c: F.when(F.col(c).rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    line = F.concat_ws(",", *[F.coalesce(quoted(c), F.lit("")) for c in rows.columns])
    documents.write(rows.select("khata_number", "khasra_number", line.alias("line")), f"{path}/export.csv", "line", ["khata_number", "khasra_number"], "\ufeff" + ",".join(rows.columns) + "\n", "", separator="")


def geojson_lines(khata: DataFrame, parcels: DataFrame, owners: DataFrame, villages: DataFrame, village: str | None = None, only_approved: bool = True) -> DataFrame:
    """khata_id, pos, feature: a GeoJSON Feature in CRS 4326 for each parcel, owners nested (S7). The geometry is the
    MultiPolygon in the column ``rings`` (functions.geometry) where there is one, else the point of lat and lon, else null."""
    head = join_village(join_owners(by_village(approved_only(khata, only_approved), village), owners), villages, "left")
    rows = parcels.join(head, "khata_id")
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    number = lambda c: F.col(c).cast("double").alias(c)
    own = dict(rows.select(F.explode("owners").alias("o")).select("o.*").dtypes)
    field = lambda o, c: o[c] if c in own else F.lit(None).cast("string")
    nested = F.transform("owners", lambda o: F.struct(o["owner_name_vernacular"].alias("name"), field(o, "owner_name_en").alias("name_en"), field(o, "relation_type").alias("relation"), field(o, "relative_name").alias("relative"), o["share_percentage"].cast("double").alias("share_pct")))
    owned = F.coalesce(nested, F.array().cast("array<struct<name:string,name_en:string,relation:string,relative:string,share_pct:double>>"))
    properties = F.struct(
        _optional(rows, "ulpin").alias("ulpin"), "khata_number", "khasra_number", _optional(rows, "fasli_year").alias("fasli_year"), number("plot_area_sqm"), F.col("total_area_sqm").cast("double").alias("khata_total_area_sqm"), _optional(rows, "land_classification").alias("land_classification"),
        "village_code", "village_name", "tehsil", "district", "state", owned.alias("owners"), F.col("final_score").cast("double").alias("confidence_score"), "approval_status",
    )
    geometry = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.to_json(point)) if {"lat", "lon"} <= set(rows.columns) else F.lit(None).cast("string")
    if "rings" in rows.columns:
        geometry = F.coalesce(F.when(F.col("rings").isNotNull(), F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("rings").alias("coordinates")))), geometry)
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.to_json(properties, {"ignoreNullFields": "false"}), F.lit("}"))
    return rows.select("khata_id", "pos", feature.alias("feature"))


# Name and reference system of the exported collection.
COLLECTION, CRS = "DILRMP_RoR_Export", "urn:ogc:def:crs:EPSG::4326"


def export_geojson(rows: DataFrame, path: str, collection: bool = False) -> None:
    """Write the features as lines, each file a sequence of features that readers of GeoJSON lines take; or with
    ``collection`` one FeatureCollection in the file export.geojson there, by khata_id and pos."""
    if not collection:
        return rows.select("feature").write.mode("errorifexists").text(path)
    head = json.dumps({"type": "FeatureCollection", "name": COLLECTION, "crs": {"type": "name", "properties": {"name": CRS}}, "features": []}, separators=(",", ":"))[:-2]
    documents.write(rows, f"{path}/export.geojson", "feature", ["khata_id", "pos"], head + "\n", "]}\n", separator=",")


def export_view(khata: DataFrame, parcels: DataFrame, villages: DataFrame) -> DataFrame:
    """Holdings of known villages with their parcels, if any; no filter on approval."""
    return join_village(khata, villages, "inner").join(parcels, "khata_id", "left")
