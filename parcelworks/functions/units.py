"""Regional area units: resolution by region, conversion to square metres, compound expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelworks.functions.text import let, normalise_digits, strip

# Unit, square metres, aliases, regions (zones; * is any), authority.
UNITS = (
    ("hectare", "10000", ("hectare", "hect", "ha", "हेक्टेयर", "हेक्टर", "हे"), "*", "SI / DILRMP standard"),
    ("acre", "4046.8564224", ("acre", "एकड़", "एकर"), "*", "International acre"),
    ("sqm", "1", ("sqm", "sq m", "m2", "square metre", "square meter", "वर्ग मीटर"), "*", "SI base"),
    ("bigha_western_up", "2529.3", ("bigha", "बीघा", "पक्का बीघा", "pucca bigha"), "UTTAR PRADESH:WEST", "UP Board of Revenue (Western zone)"),
    ("bigha_eastern_up", "1618.7", ("bigha", "बीघा", "कच्चा बीघा", "kaccha bigha"), "UTTAR PRADESH:EAST|BIHAR|JHARKHAND", "UP/Bihar Revenue (Eastern zone)"),
    ("guntha", "101.17", ("guntha", "gunta", "गुंठा", "ಗುಂಟೆ"), "MAHARASHTRA|KARNATAKA", "Maharashtra Land Revenue Code"),
    ("cent", "40.46", ("cent", "సెంటు", "சென்ட்", "ಸೆಂಟ್"), "TAMIL NADU|KERALA|ANDHRA PRADESH|TELANGANA|KARNATAKA", "South India survey standard"),
    ("biswa_western_up", "126.465", ("biswa", "बिस्वा"), "UTTAR PRADESH:WEST", "1/20 Bigha (Western UP)"),
    ("are", "100", ("are", "आर"), "*", "SI derived"),
)

# The districts of Uttar Pradesh that use the western units.
WESTERN_DISTRICTS = ("MEERUT", "SAHARANPUR", "MUZAFFARNAGAR", "BAGHPAT", "GHAZIABAD", "GAUTAM BUDDHA NAGAR", "BULANDSHAHR", "ALIGARH", "HATHRAS", "AGRA", "MATHURA", "FIROZABAD", "ETAH", "KASGANJ", "SHAMLI", "BIJNOR", "MORADABAD")

# Fixed value: a quantity (group 1), white space (2) and a unit of one or two words (3).
AREA = r"(?U)(\d+(?:[.,]\d+)?(?:\s*/\s*\d+)?)(\s*)([^\d\s,;]+(?:\s[^\d\s,;]+)?)"

AREA_TYPE = "decimal(24,4)"


def unit_table(spark: SparkSession) -> DataFrame:
    """The catalogue: key, sqm, aliases, region, authority."""
    rows = [(k, s, list(a), r, who) for k, s, a, r, who in UNITS]
    return spark.createDataFrame(rows, "key string, sqm string, aliases array<string>, region string, authority string").withColumn("sqm", F.col("sqm").cast("decimal(14,7)"))


def _catalogue() -> Column:
    """alias -> candidates in catalogue order, as a literal map: the catalogue has a fixed size."""
    by_alias: dict[str, list] = {}
    for key, sqm, aliases, scope, _ in UNITS:
        for alias in aliases:
            by_alias.setdefault(alias, []).append(F.struct(F.lit(key).alias("key"), F.lit(sqm).cast("decimal(14,7)").alias("sqm"), F.array(*[F.lit(z) for z in scope.split("|")]).alias("zones")))
    return F.create_map(*[x for alias, units in by_alias.items() for x in (F.lit(alias), F.array(*units))])


def zone_for(state: Column, district: Column) -> Column:
    """Uttar Pradesh in a western and an eastern zone, any other state as it is; empty for none."""
    s, d = (F.upper(strip(F.coalesce(c, F.lit("")))) for c in (state, district))
    return F.when(s == "UTTAR PRADESH", F.when(d.isin(*WESTERN_DISTRICTS), "UTTAR PRADESH:WEST").otherwise("UTTAR PRADESH:EAST")).otherwise(s)


def resolve_unit(unit: Column, zone: Column) -> Column:
    """struct(key, sqm, error): one candidate is taken whatever the region, of several the first whose scope has the zone."""
    return _resolved(normalise_digits(F.coalesce(unit, F.lit(""))), zone)


def _resolved(unit: Column, zone: Column) -> Column:
    """As resolve_unit, of a unit whose digits are normalised."""

    def chosen(c: Column) -> Column:
        fit = F.when(F.size(c["found"]) == 1, c["found"][0]).when(F.size(c["found"]) > 1, F.get(F.filter(c["found"], lambda u: F.array_contains(u["zones"], zone)), F.lit(0)))
        error = F.when(c["token"] == "", "empty").when(c["found"].isNull(), "unknown")
        return let(fit, lambda u: F.struct(u["key"].alias("key"), u["sqm"].alias("sqm"), F.coalesce(error, F.when(u.isNull(), "region-dependent")).alias("error")))

    token = F.regexp_replace(F.lower(strip(F.coalesce(unit, F.lit("")))), r"\.+$", "")
    return let(let(token, lambda t: F.struct(t.alias("token"), F.element_at(_catalogue(), t).alias("found"))), chosen)


def to_sqm(value: Column, factor: Column) -> Column:
    """Quantity (a number or a/b, commas dropped) times factor, 4 decimals half to even; null if it is no number."""
    return _product(normalise_digits(value), factor)


def _product(value: Column, factor: Column) -> Column:
    """As to_sqm, of a value whose digits are normalised."""

    def product(raw: Column) -> Column:
        whole = F.when(raw.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), raw).try_cast("decimal(18,6)")
        top, bottom = (F.when(raw.rlike(r"^[^/]+/[^/]+$"), F.split_part(raw, F.lit("/"), F.lit(i))).try_cast("decimal(18,6)") for i in (1, 2))
        return F.coalesce(whole * factor, F.try_divide(top * factor, bottom))

    return F.bround(let(F.regexp_replace(value, r"[,\s]", ""), product), 4).cast(AREA_TYPE)


def parse_area(text: Column, zone: Column) -> Column:
    """Sum of all components of an expression such as "2 bigha 10 biswa" in square metres; unknown units are skipped, and
    null is returned if none is known."""
    both = lambda clean: F.arrays_zip(F.regexp_extract_all(clean, F.lit(AREA), 1).alias("value"), F.regexp_extract_all(clean, F.lit(AREA), 3).alias("unit"))
    parts = let(normalise_digits(text), both)
    areas = F.filter(F.transform(parts, lambda p: _product(p["value"], _resolved(p["unit"], zone)["sqm"])), lambda a: a.isNotNull())
    total = lambda found: F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast(AREA_TYPE), lambda acc, a: (acc + a).cast(AREA_TYPE)))
    return let(areas, total)


def extract_area(text: Column, zone: Column) -> Column:
    """The area of a table cell that may have been read twice: a letter O before a digit is a zero; components are added
    until a unit comes again or more than 3 characters lie between; a unit of two words is retried by its first word."""
    clean = F.regexp_replace(normalise_digits(text), r"(?<![A-Za-z])[Oo](?=[.,]?\d)", "0")
    marked = F.split(F.regexp_replace(clean, AREA, "\x01$1\x02$2\x03$3\x04"), "\x01")
    cut = lambda c, mark, i: F.split_part(c, F.lit(mark), F.lit(i))

    def piece(m: Column) -> Column:
        """A reading (none before the first mark): its unit and area, its length and that of what follows it."""
        rest, tail = cut(m, "\x02", 2), cut(m, "\x03", 2)
        return F.struct(cut(m, "\x02", 1).alias("value"), F.length(cut(rest, "\x03", 1)).alias("space"), cut(tail, "\x04", 1).alias("unit"), F.length(cut(tail, "\x04", 2)).alias("after"))

    def resolved(p: Column) -> Column:
        both, one = _resolved(p["unit"], zone), _resolved(F.regexp_extract(p["unit"], r"^(?U)(\S+)", 1), zone)
        unit = let(both, lambda u: F.when(u["key"].isNotNull(), u).otherwise(one))
        length = F.length(p["value"]) + p["space"] + F.length(p["unit"])
        return let(unit, lambda u: F.struct(u["key"].alias("key"), _product(p["value"], u["sqm"]).alias("sqm"), length.alias("length"), p["after"].alias("after")))

    pieces = F.transform(F.transform(marked, piece), resolved)
    state = F.struct(F.lit(0).cast(AREA_TYPE).alias("total"), F.array().cast("array<string>").alias("units"), F.lit(0).alias("gap"), F.lit(False).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        readable = p["sqm"].isNotNull()
        stop = acc["done"] | F.coalesce(readable & (F.size(acc["units"]) > 0) & (F.array_contains(acc["units"], p["key"]) | (acc["gap"] > 3)), F.lit(False))
        return let(
            F.struct(stop.alias("stop"), (readable & ~stop).alias("taken")),
            lambda s: F.struct(
                F.when(s["taken"], acc["total"] + p["sqm"]).otherwise(acc["total"]).cast(AREA_TYPE).alias("total"),
                F.when(s["taken"], F.concat(acc["units"], F.array(p["key"]))).otherwise(acc["units"]).alias("units"),
                F.when(s["taken"], p["after"]).otherwise(acc["gap"] + p["length"] + p["after"]).alias("gap"),
                s["stop"].alias("done"),
            ),
        )

    return F.aggregate(pieces, state, step, lambda acc: F.when(F.size(acc["units"]) > 0, acc["total"]))


def hectares(sqm: Column) -> Column:
    return F.bround(sqm / F.lit(10000).cast("decimal(5,0)"), 4).cast(AREA_TYPE)
