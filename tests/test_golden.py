"""Golden values of units, ids, text parsing and scenarios."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parcelworks.functions import ids, text, units
from parcelworks.operators import extract, merge, rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("expression", "state", "district", "sqm"),
    [
        ("1 hectare", None, None, "10000"), ("1 guntha", None, None, "101.17"), ("1 cent", None, None, "40.46"),
        ("1 bigha", "Uttar Pradesh", "Meerut", "2529.3"), ("1 bigha", "Uttar Pradesh", "Varanasi", "1618.7"), ("1 bigha", "Bihar", "Patna", "1618.7"),
        ("1 bigha", None, None, None), ("२ हेक्टेयर", None, None, "20000"), ("2 बीघा 10 बिस्वा", "Uttar Pradesh", "Meerut", "6323.25"),
        ("3 furlong-squared", None, None, None), ("1/4 acre", None, None, "1011.7141"), ("1/0 acre", None, None, None), ("", None, None, None), (None, None, None, None),
    ],
)
def test_area_expressions(spark, expression, state, district, sqm):
    zone = units.zone_for(F.lit(state).cast("string"), F.lit(district).cast("string"))
    found = one(spark, units.parse_area(F.lit(expression).cast("string"), zone))
    assert found == (None if sqm is None else Decimal(sqm))


@pytest.mark.parametrize(("cell", "sqm"), [("0.55 0.55 hectare. hectare", "5500"), ("O.35 hectare", "3500"), ("0.35 hectare 0.35 hectare", "3500"), ("40 guntha", "4046.8"), ("2 बीघा 10 बिस्वा", "6323.25"), ("nothing", None)])
def test_area_of_a_cell(spark, cell, sqm):
    found = one(spark, units.extract_area(F.lit(cell), F.lit("UTTAR PRADESH:WEST")))
    assert found == (None if sqm is None else Decimal(sqm))


def test_ulpin(spark):
    made = ids.mint(F.lit(18.5793), F.lit(73.9776), F.lit("Maharashtra"))
    value = one(spark, made)
    assert len(value) == 14 and value.startswith("MH") and one(spark, ids.is_valid(F.lit(value)))
    wrong = value[:5] + ("0" if value[5] != "0" else "1") + value[6:]
    assert not one(spark, ids.is_valid(F.lit(wrong)))
    lat, lon, error = ids.centre(F.lit(one(spark, ids.mint(F.lit(25.5760), F.lit(85.0640), F.lit("Bihar")))))
    row = spark.range(1).select(lat.alias("lat"), lon.alias("lon"), error.alias("error")).first()
    assert abs(row.lat - 25.576) < 1e-4 and abs(row.lon - 85.064) < 1e-4 and row.error is None
    assert one(spark, ids.mint(F.lit(120.0), F.lit(0.0), F.lit(None).cast("string"))) is None
    assert not one(spark, ids.is_valid(F.lit(None).cast("string")))


@pytest.mark.parametrize("name", ["पुत्री", "पुत्र", "s/o"])
def test_relation(spark, name):
    owner, code, relative = text.relation(F.lit(f"राम लाल {name} श्याम 1/2"))
    row = spark.range(1).select(owner.alias("o"), code.alias("c"), relative.alias("r")).first()
    assert (row.o, row.c, row.r) == ("राम लाल", text.RELATIONS[name], "श्याम")


@pytest.mark.parametrize(("line", "share", "printed"), [("a 1/3", "33.33", "1/3"), ("12.5 %", "12.50", "12.5%"), ("1/0", None, None), ("none", None, None), (None, None, None)])
def test_share(spark, line, share, printed):
    percent, said = text.share(F.lit(line).cast("string"))
    row = spark.range(1).select(percent.alias("p"), said.alias("s")).first()
    assert (row.p, row.s) == (None if share is None else Decimal(share), printed)


def test_numbers_and_classes(spark):
    number, labelled = text.khasra_number(F.lit("खसरा सं. 112/1 0.5 hectare"))
    assert spark.range(1).select(number.alias("n"), labelled.alias("l")).first() == ("112/1", True)
    assert one(spark, text.khata_number(F.lit("खाता सखया : ३०५"))) == "305"
    assert one(spark, text.land_class(F.lit("असिंचित"))) == "Unirrigated"
    assert one(spark, text.unexpected_characters(F.lit("1*2#*"))) == "#*"
    assert one(spark, text.confidence_band(F.lit(None).cast("double"))) == "medium"


def record(spark, total, areas, shares, ocr=0.9, layout=0.9, number="7", numbers=None):
    khata = spark.createDataFrame([(1, number, Decimal(total), ocr, layout)], "khata_id long, khata_number string, total_area_sqm decimal(12,4), ocr_confidence double, layout_confidence double")
    parcels = spark.createDataFrame([(1, i, (numbers or [str(j) for j in range(len(areas))])[i], None if a is None else Decimal(a)) for i, a in enumerate(areas)], "khata_id long, pos int, khasra_number string, plot_area_sqm decimal(12,4)")
    owners = spark.createDataFrame([(1, i, f"o{i}", Decimal(s)) for i, s in enumerate(shares)], "khata_id long, pos int, owner_name_vernacular string, share_percentage decimal(5,2)")
    found = rules.all_findings(khata, parcels, owners)
    return rules.route(rules.report(khata, found)).first(), {r.code for r in found.collect()}


def test_scenarios(spark):
    good, codes = record(spark, "10015.83", ["4046.8", "2529.25", "3439.78"], ["50", "50"], 0.972, 0.961)
    assert (good.final_score, good.approval_status, codes) == (0.9743, "AUTO_APPROVED", set())
    low, _ = record(spark, "4", ["2", "1", "1"], ["33.34", "33.33", "33.33"], 0.741, 0.802)
    assert (low.final_score, low.approval_status, low.critical) == (0.8111, "PENDING", 0)
    off, codes = record(spark, "10000", ["5500", "3500", "2500"], ["100"], 0.944, 0.930)
    assert off.approval_status == "PENDING" and codes == {"AREA_SUM_MISMATCH"} and "1500.0000 sqm" in off.first_critical


@pytest.mark.parametrize(
    ("kw", "code", "there"),
    [
        ({"total": "10000", "areas": ["9999.998"], "shares": ["100"]}, "AREA_SUM_MISMATCH", False), ({"total": "10000", "areas": ["9999.98"], "shares": ["100"]}, "AREA_SUM_MISMATCH", True),
        ({"total": "1", "areas": ["1"], "shares": ["60", "30"]}, "INVALID_OWNER_SHARES", True), ({"total": "1", "areas": ["1"], "shares": []}, "ORPHAN_OWNER", True),
        ({"total": "2", "areas": ["1", "1"], "shares": ["100"], "numbers": ["5", " 5 "]}, "DUPLICATE_KHASRA", True), ({"total": "1", "areas": ["1"], "shares": ["100"], "number": "unread "}, "MISSING_KHATA_NUMBER", True),
        ({"total": "0", "areas": [None], "shares": ["100"]}, "NON_POSITIVE_AREA", True),
    ],
)
def test_rules(spark, kw, code, there):
    assert (code in record(spark, **kw)[1]) is there


def test_rows_and_owners(spark):
    tokens = spark.createDataFrame(
        [(1, 0, 1, "b", 0.9, 101, 50, 121, 90), (1, 0, 0, "a", 0.8, 100, 0, 120, 40), (1, 0, 2, "c", 0.7, 140, 0, 160, 40), (1, 0, 3, "d", 0.6, 142, 50, 162, 90), (1, 0, 4, "e", 0.5, 139, 100, 159, 140)],
        "doc_id long, page int, tok int, text string, confidence double, ymin int, xmin int, ymax int, xmax int",
    )
    rows = {r.line: r.text for r in extract.assemble_rows(tokens).collect()}
    assert rows == {0: "a b", 1: "c d e"}
    owners = spark.createDataFrame([(1, i, None) for i in range(3)], "khata_id long, pos int, share_percentage decimal(5,2)")
    assert sum(r.share_percentage for r in merge.implied_shares(owners).collect()) == 100


def test_unit_table(spark):
    rows = {r.key: r for r in units.unit_table(spark).collect()}
    assert len(rows) == len(units.UNITS) and rows["hectare"].sqm == 10000 and "hectare" in rows["hectare"].aliases
    aliases = spark.createDataFrame([(a,) for r in rows.values() for a in r.aliases], "a string").select("a", units.resolve_unit(F.col("a"), F.lit("")).alias("u")).collect()
    assert all(r.u.error in (None, "region-dependent") for r in aliases)


def test_normalised_text_is_composed(spark):
    import unicodedata

    cases = ["क\u093c १२", "\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f", "न\u093c र\u093c ळ\u093c", "खसरा\u200b ४५\u200d", "plain 7", ""]
    found = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(text.normalise_digits("t")).collect()]
    assert found == ["".join(str(text.DEVANAGARI_DIGITS.index(x)) if x in text.DEVANAGARI_DIGITS else x for x in unicodedata.normalize("NFC", c) if x not in text.ZERO_WIDTH) for c in cases]
    decomposed = spark.createDataFrame([("e\u0301", ), (None,)], "t string").select(text.nfc("t")).collect()
    assert [r[0] for r in decomposed] == ["\u00e9", None]
