"""Register tables derived from the base tables, as SELECTs that Spark and other SQL engines run unchanged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from parcelworks.sources import layout

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    "v_parcels": """
SELECT l_orderkey AS khata_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos,
  CASE WHEN l_partkey % 97 = 0 THEN ''
       WHEN l_partkey % 89 = 0 THEN concat(CAST(l_linenumber AS STRING), '*', CAST(l_partkey % 20 AS STRING))
       ELSE concat(CAST(l_linenumber AS STRING), '/', CAST(l_partkey % 20 AS STRING)) END AS khasra_number,
  CAST(CASE WHEN l_partkey % 83 = 0 THEN 0 ELSE l_quantity END AS DECIMAL(12,4)) AS plot_area_sqm,
  CAST(l_partkey % 101 AS DOUBLE) / 100 AS conf_khasra,
  CAST(l_suppkey % 97 AS DOUBLE) / 100 AS conf_area,
  8 + CAST(l_partkey % 2000 AS DOUBLE) / 100 AS lat,
  68 + CAST(l_suppkey % 100 AS DOUBLE) * 0.29 AS lon
FROM lineitem""",
    "v_khata": """
SELECT o_orderkey AS khata_id,
  concat('V', CAST(c_nationkey AS STRING)) AS village_code,
  CASE WHEN o_orderkey % 41 = 0 THEN 'UNREAD' WHEN o_orderkey % 43 = 0 THEN ' ' ELSE CAST(o_orderkey AS STRING) END AS khata_number,
  CAST(coalesce(s.area, 0) + CASE WHEN o_orderkey % 7 = 0 THEN 150 WHEN o_orderkey % 11 = 0 THEN 0.005 WHEN o_orderkey % 13 = 0 THEN 0.006 ELSE 0 END AS DECIMAL(12,4)) AS total_area_sqm,
  0.70 + CAST(o_orderkey % 30 AS DOUBLE) / 100 AS ocr_confidence,
  0.60 + CAST(o_custkey % 40 AS DOUBLE) / 100 AS layout_confidence,
  o_orderdate AS created_at
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT khata_id, sum(plot_area_sqm) AS area FROM v_parcels GROUP BY khata_id) s ON s.khata_id = o_orderkey""",
    "v_owners": """
SELECT khata_id, pos, concat('Owner ', CAST(pos AS STRING)) AS owner_name_vernacular,
  CAST(CASE WHEN n = 1 THEN 100 WHEN n = 2 THEN 50 WHEN pos = 0 THEN 33.34 ELSE 33.33 END
     - CASE WHEN pos = 0 AND khata_id % 17 = 0 THEN 10 WHEN pos = 0 AND khata_id % 19 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(5,2)) AS share_percentage
FROM (SELECT khata_id, pos, count(*) OVER (PARTITION BY khata_id) AS n FROM v_parcels WHERE pos < 3) t""",
    "v_villages": """
SELECT concat('V', CAST(n_nationkey AS STRING)) AS village_code, n_name AS village_name, r_name AS tehsil,
  CASE WHEN n_nationkey % 6 = 1 AND n_nationkey % 4 = 1 THEN 'Meerut' ELSE concat('District ', CAST(n_nationkey AS STRING)) END AS district,
  CASE n_nationkey % 6 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Uttar Pradesh' WHEN 2 THEN 'Bihar' WHEN 3 THEN 'Tamil Nadu' WHEN 4 THEN 'Karnataka' ELSE 'Rajasthan' END AS state
FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "v_audit": """
SELECT event_id AS log_id, user_id AS khata_id, event_type AS field_name,
  CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS STRING) AS raw_value,
  CAST(event_id AS STRING) AS corrected_value, concat('u', CAST(user_id % 9 AS STRING)) AS modified_by_user_id,
  CASE WHEN user_id % 3 = 0 THEN 'TEHSILDAR' ELSE 'PATWARI' END AS role, ts
FROM events""",
    "v_area_text": """
SELECT p.khata_id, p.pos, k.village_code,
  concat(CAST(CAST(p.plot_area_sqm AS INT) AS STRING),
    CASE p.khata_id % 6 WHEN 0 THEN ' hectare' WHEN 1 THEN ' guntha' WHEN 2 THEN ' bigha' WHEN 3 THEN ' बीघा 10 बिस्वा' WHEN 4 THEN '/4 acre' ELSE ' furlong' END) AS declared_text
FROM v_parcels p JOIN v_khata k ON k.khata_id = p.khata_id""",
    "v_tokens": """
SELECT khata_id AS doc_id, pos * 3 AS tok, CASE WHEN pos < 8 THEN 0 ELSE 1 END AS page, khasra_number AS text, 'hi' AS language,
  CASE WHEN pos % 5 = 4 THEN 'handwritten' ELSE 'printed' END AS source, conf_khasra AS confidence,
  100 + (pos % 8) * 40 + CAST(khata_id % 5 AS INT) AS ymin, 100 AS xmin,
  130 + (pos % 8) * 40 + CAST(khata_id % 5 AS INT) AS ymax, 180 AS xmax FROM v_parcels
UNION ALL
SELECT khata_id, pos * 3 + 1, CASE WHEN pos < 8 THEN 0 ELSE 1 END, khasra_number, 'en', 'printed', conf_area,
  101 + (pos % 8) * 40 + CAST(khata_id % 5 AS INT), 101, 131 + (pos % 8) * 40 + CAST(khata_id % 5 AS INT), 181 FROM v_parcels
UNION ALL
SELECT khata_id, pos * 3 + 2, CASE WHEN pos < 8 THEN 0 ELSE 1 END, concat(CAST(CAST(plot_area_sqm AS INT) AS STRING), ' hectare'), 'hi', 'printed', conf_khasra,
  104 + (pos % 8) * 40, 300, 134 + (pos % 8) * 40, 420 FROM v_parcels""",
    "v_zones": """
SELECT khata_id AS doc_id, 0 AS page, 'table' AS kind, 90 AS ymin, 80 AS xmin, 260 AS ymax, 500 AS xmax, 0.55 + CAST(khata_id % 45 AS DOUBLE) / 100 AS confidence FROM v_khata WHERE khata_id % 9 <> 0
UNION ALL
SELECT khata_id, 0, 'header', 0, 0, 90, 600, 0.8 FROM v_khata
UNION ALL
SELECT khata_id, 0, 'margin_remarks', 90, 500, 260, 600, 0.7 FROM v_khata WHERE khata_id % 2 = 0
UNION ALL
SELECT khata_id, 0, 'seal', 300, 300, 360, 360, 0.75 FROM v_khata WHERE khata_id % 5 = 0""",
    "v_parcel_corr": """
SELECT khata_id, CASE WHEN pos = 3 THEN NULL ELSE pos END AS pos, concat(khasra_number, CASE WHEN khata_id % 4 = 0 AND pos = 0 THEN '-अ' ELSE '' END) AS khasra_number,
  CAST(plot_area_sqm + CASE WHEN pos = 1 THEN 1 ELSE 0 END AS DECIMAL(12,4)) AS plot_area_sqm, pos = 2 AS is_delete
FROM v_parcels WHERE khata_id % 3 = 0 AND pos <> 4""",
}

#: The same rows in one pass over what they are made of, where the view names it several times; used by Spark alone.
ONE_PASS = {
    "v_tokens": """
SELECT khata_id AS doc_id, inline(array(
  struct(pos * 3 AS tok, CASE WHEN pos < 8 THEN 0 ELSE 1 END AS page, khasra_number AS text, 'hi' AS language, CASE WHEN pos % 5 = 4 THEN 'handwritten' ELSE 'printed' END AS source, conf_khasra AS confidence,
    100 + (pos % 8) * 40 + CAST(khata_id % 5 AS INT) AS ymin, 100 AS xmin, 130 + (pos % 8) * 40 + CAST(khata_id % 5 AS INT) AS ymax, 180 AS xmax),
  struct(pos * 3 + 1 AS tok, CASE WHEN pos < 8 THEN 0 ELSE 1 END AS page, khasra_number AS text, 'en' AS language, 'printed' AS source, conf_area AS confidence,
    101 + (pos % 8) * 40 + CAST(khata_id % 5 AS INT) AS ymin, 101 AS xmin, 131 + (pos % 8) * 40 + CAST(khata_id % 5 AS INT) AS ymax, 181 AS xmax),
  struct(pos * 3 + 2 AS tok, CASE WHEN pos < 8 THEN 0 ELSE 1 END AS page, concat(CAST(CAST(plot_area_sqm AS INT) AS STRING), ' hectare') AS text, 'hi' AS language, 'printed' AS source, conf_khasra AS confidence,
    104 + (pos % 8) * 40 AS ymin, 300 AS xmin, 134 + (pos % 8) * 40 AS ymax, 420 AS xmax)))
FROM v_parcels""",
}

#: Which views and tables each view reads.
NEEDS = {
    "v_parcels": (), "v_khata": ("v_parcels",), "v_owners": ("v_parcels",), "v_villages": (), "v_audit": (),
    "v_area_text": ("v_parcels", "v_khata"), "v_tokens": ("v_parcels",), "v_zones": ("v_khata", "v_parcels"), "v_parcel_corr": ("v_parcels",),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


#: Views that all rules share, and the column that makes folders; they are laid out once for each state of their files.
LAID_OUT = {"v_parcels": None, "v_khata": "village_code", "v_owners": None}
#: What a laid out view is made of, dealt into the buckets by this column at once, so that its windows and its files share one shuffle.
DEALT = {("v_parcels", "lineitem"): "l_orderkey"}
SOURCES = ("lineitem", "orders", "customer")
_MADE: dict[tuple, str] = {}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over the tables in ``sf_dir``.

    The parcels, holdings and owners are written once as tables bucketed by khata_id (sources.layout) and read from
    there, for as long as the session lasts and the files of ``sf_dir`` stay as they are; other views are plans alone.
    """
    parts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
    needed = _order(names)
    state = buckets = None
    if any(n in LAID_OUT for n in needed):
        files = layout.signature(spark, *[f"{sf_dir}/{t}.parquet" for t in SOURCES])
        buckets = layout.buckets_for(spark, sum(size for _, size, _ in files))
        state = (spark.sparkContext.applicationId, buckets, sf_dir, files)
    found: dict[str, DataFrame] = {}
    for name in needed:
        if name in LAID_OUT and (name, state) in _MADE:
            found[name] = layout.read(spark, _MADE[name, state])
            continue
        inputs = {**parts, **found}
        view = ONE_PASS.get(name, VIEWS[name])
        used = {k: v.repartition(buckets, DEALT[name, k]) if (name, k) in DEALT else v for k, v in inputs.items() if _reads(view, k)}
        found[name] = spark.sql(_braced(view, used), **used)
        if name in LAID_OUT:
            found[name], _MADE[name, state] = layout.bucketed(found[name], name, buckets=buckets, partition=LAID_OUT[name])
    return [found[n] for n in names]


def keeper(spark: SparkSession, sf_dir: str):
    """A function (table, name) that writes a table of holdings in the layout of those in ``sf_dir`` and reads it again."""
    buckets = layout.buckets_for(spark, sum(size for _, size, _ in layout.signature(spark, *[f"{sf_dir}/{t}.parquet" for t in SOURCES])))
    return lambda rows, name: layout.bucketed(rows, name, buckets=buckets)[0]


def _reads(sql: str, name: str) -> bool:
    return any(f"{word} {name}" in sql for word in ("FROM", "JOIN"))


def _braced(sql: str, used: dict) -> str:
    """The SELECT with its tables as parameters of spark.sql, longest names first."""
    return reduce(lambda s, k: s.replace(f"FROM {k}", f"FROM {{{k}}}").replace(f"JOIN {k}", f"JOIN {{{k}}}"), sorted(used, key=len, reverse=True), sql)


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind a WITH of the named views, for engines that know the base tables only."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _order(names))
    head, _, rest = sql.strip().partition(" ")
    if head.upper() == "WITH":
        if rest.startswith("RECURSIVE "):
            return f"WITH RECURSIVE {views},\n{rest.removeprefix('RECURSIVE ')}"
        return f"WITH {views},\n{rest}"
    return f"WITH {views}\n{sql.strip()}"
