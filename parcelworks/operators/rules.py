"""Validation rules, scores and routing: one pass over the details of each holding, one shuffle key throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.functions import ids
from parcelworks.functions.text import is_unread, strip, unexpected_characters
from parcelworks.functions.units import hectares

AREA_TOLERANCE, SHARE_TOLERANCE = "0.005", "0.01"
CONFIDENCE_FLOOR, THRESHOLD = 0.50, 0.85
MATH_RULES = ("AREA_SUM_MISMATCH", "INVALID_OWNER_SHARES", "DUPLICATE_KHASRA", "NON_POSITIVE_AREA")
WEIGHTS = (0.5, 0.3, 0.2)

#: The order of a holding's findings: record, areas, shares, the parcels one after another, the confidences of parcels and owners.
PLACE = ("section", "pos", "rule_order", "entry")
COLUMNS = (*PLACE, "code", "severity", "message", "field_path", "observed", "observed_text", "expected", "expected_text", "delta")
#: Section of each rule; the rules from 3 to 6 take turns parcel by parcel.
SECTIONS = {7: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 8: 4, 9: 5}


def finding(order: int, code: str, severity: str, message: Column, path: Column, observed=None, observed_text=None, expected=None, expected_text=None, delta=None, pos=None, entry=None) -> list[Column]:
    """The columns of a finding; ``pos`` is the row of the detail and ``entry`` the field in it, where it has them."""
    number = lambda c: F.lit(None).cast("double") if c is None else c.cast("double")
    text = lambda c: F.lit(None).cast("string") if c is None else c
    at = lambda c: F.lit(0) if c is None else F.coalesce(c.cast("int"), F.lit(0))
    return [F.lit(SECTIONS[order]).alias("section"), at(pos).alias("pos"), F.lit(order).alias("rule_order"), at(entry).alias("entry"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), path.alias("field_path"), number(observed).alias("observed"), text(observed_text).alias("observed_text"), number(expected).alias("expected"), text(expected_text).alias("expected_text"), number(delta).alias("delta")]


def parcel_sum(parcels: DataFrame) -> DataFrame:
    """khata_id, parcel_sum, parcels: areas added up exactly, null as 0."""
    return parcels.groupBy("khata_id").agg(F.sum(F.coalesce("plot_area_sqm", F.lit(0).cast("decimal(12,4)"))).alias("parcel_sum"), F.count(F.lit(1)).alias("parcels"))


def share_sum(owners: DataFrame) -> DataFrame:
    """khata_id, share_sum, owners: shares added up exactly, null as 0."""
    return owners.groupBy("khata_id").agg(F.sum(F.coalesce("share_percentage", F.lit(0).cast("decimal(5,2)"))).alias("share_sum"), F.count(F.lit(1)).alias("owners"))


def balance(khata: DataFrame, parcels: DataFrame, owners: DataFrame) -> DataFrame:
    """Live figures of each holding: sums, signed differences, and whether areas and shares close."""
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    rows = khata.join(parcel_sum(parcels), "khata_id", "left").join(share_sum(owners), "khata_id", "left")
    rows = rows.withColumns({"parcel_sum": zero("parcel_sum", "decimal(22,4)"), "parcels": zero("parcels", "long"), "share_sum": zero("share_sum", "decimal(15,2)"), "owners": zero("owners", "long")})
    total = zero("total_area_sqm", "decimal(12,4)")
    rows = rows.withColumns({"area_delta": F.col("parcel_sum") - total, "share_delta": F.col("share_sum") - F.lit(100).cast("decimal(5,2)")})
    return rows.withColumns({"area_ok": F.abs("area_delta") <= F.lit(AREA_TOLERANCE).cast("decimal(5,3)"), "share_ok": (F.col("owners") > 0) & (F.abs("share_delta") <= F.lit(SHARE_TOLERANCE).cast("decimal(4,2)"))})


Rules = list[tuple[Column, list[Column]]]


def listed(rows: DataFrame, rules: Rules) -> DataFrame:
    """khata_id and the findings of the rules whose test holds, in one pass over the rows."""
    return rows.select("khata_id", F.inline(F.array_compact(F.array(*[F.when(test, F.struct(*row)) for test, row in rules]))))


def _area_rules() -> Rules:
    gap = F.abs("area_delta")
    message = F.concat(F.lit("Parcel areas total "), F.col("parcel_sum").cast("string"), F.lit(" sqm but the Khata declares "), F.coalesce(F.col("total_area_sqm"), F.lit(0).cast("decimal(12,4)")).cast("string"), F.lit(" sqm — a difference of "), gap.cast("string"), F.lit(" sqm ("), hectares(gap).cast("string"), F.lit(" ha)."))
    return [(~F.col("area_ok"), finding(1, "AREA_SUM_MISMATCH", "CRITICAL", message, F.lit("khata.total_area_sqm"), observed=F.col("parcel_sum"), expected=F.col("total_area_sqm"), delta=gap))]


def _share_rules() -> Rules:
    message = F.concat(F.lit("Ownership shares total "), F.col("share_sum").cast("string"), F.lit("%, which does not close to 100%."))
    return [
        (F.col("owners") == 0, finding(2, "ORPHAN_OWNER", "CRITICAL", F.lit("No owner recorded against this Khata."), F.lit("owners"), observed=F.lit(0), expected_text=F.lit("at least 1"))),
        ((F.col("owners") > 0) & ~F.col("share_ok"), finding(2, "INVALID_OWNER_SHARES", "CRITICAL", message, F.lit("owners.share_percentage"), observed=F.col("share_sum"), expected=F.lit(100), delta=F.col("share_delta"))),
    ]


def _metadata_rules() -> Rules:
    message = F.lit("Khata number could not be read from the document.")
    return [(is_unread("khata_number"), finding(7, "MISSING_KHATA_NUMBER", "CRITICAL", message, F.lit("khata.khata_number"), observed_text=F.col("khata_number")))]


def area_mismatch(balanced: DataFrame) -> DataFrame:
    return listed(balanced, _area_rules())


def share_findings(balanced: DataFrame) -> DataFrame:
    """No owner at all, or shares that do not close to 100."""
    return listed(balanced, _share_rules())


def duplicate_rows(parcels: DataFrame) -> DataFrame:
    """Every occurrence of a survey number in a holding after its first: pos, first_pos."""
    number = strip(F.coalesce("khasra_number", F.lit("")))
    same = Window.partitionBy("khata_id", "khasra").orderBy("pos")
    rows = parcels.withColumn("khasra", number).where("khasra <> ''").withColumns({"first_pos": F.first("pos").over(same), "nth": F.row_number().over(same)})
    return rows.where("nth > 1").select("khata_id", "pos", "khasra", "first_pos")


def parcel_findings(parcels: DataFrame) -> DataFrame:
    """Format, duplicates, areas and ids of each parcel. One pass with an array of findings, and one for duplicates."""
    number = strip(F.coalesce("khasra_number", F.lit("")))
    bad = unexpected_characters(number)
    path = lambda field: F.concat(F.lit("parcels["), F.col("pos").cast("string"), F.lit("]." + field))
    area = F.coalesce("plot_area_sqm", F.lit(0).cast("decimal(12,4)"))
    ulpin = F.coalesce("ulpin", F.lit("")) if "ulpin" in parcels.columns else None
    rules = [
        (number == "", finding(3, "INVALID_KHASRA_FORMAT", "CRITICAL", F.lit("Khasra number is blank."), path("khasra_number"), pos=F.col("pos"))),
        ((number != "") & (bad != ""), finding(3, "INVALID_KHASRA_FORMAT", "WARNING", F.concat(F.lit("Khasra number '"), number, F.lit("' contains unexpected characters ("), bad, F.lit(").")), path("khasra_number"), observed_text=number, pos=F.col("pos"))),
        (area <= 0, finding(5, "NON_POSITIVE_AREA", "CRITICAL", F.concat(F.lit("Plot area for Khasra "), F.when(number == "", "?").otherwise(number), F.lit(" is "), area.cast("string"), F.lit(" sqm.")), path("plot_area_sqm"), observed=area, expected_text=F.lit("> 0"), pos=F.col("pos"))),
    ]
    if ulpin is not None:
        rules += [
            ((ulpin != "") & ~ids.is_valid(ulpin), finding(6, "ULPIN_INVALID", "WARNING", F.concat(F.lit("ULPIN "), ulpin, F.lit(" fails its check character.")), path("ulpin"), observed_text=ulpin, pos=F.col("pos"))),
            (ulpin == "", finding(6, "ULPIN_MISSING", "INFO", F.lit("No ULPIN assigned; parcel geometry is required to mint one."), path("ulpin"), pos=F.col("pos"))),
        ]
    plain = listed(parcels, rules)
    twice = F.concat(F.lit("Khasra "), F.col("khasra"), F.lit(" appears twice (rows "), (F.col("first_pos") + 1).cast("string"), F.lit(" and "), (F.col("pos") + 1).cast("string"), F.lit(")."))
    doubled = duplicate_rows(parcels).select("khata_id", *finding(4, "DUPLICATE_KHASRA", "CRITICAL", twice, path("khasra_number"), observed_text=F.col("khasra"), pos=F.col("pos")))
    return plain.unionByName(doubled)


def metadata_findings(khata: DataFrame) -> DataFrame:
    return listed(khata, _metadata_rules())


def confidence_findings(rows: DataFrame, label: str, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Every entry of ``field_confidence`` (map<string,double>) below ``floor``."""
    low = rows.select("khata_id", "pos", F.posexplode("field_confidence").alias("entry", "field", "conf")).where(F.col("conf") < floor)
    message = F.concat(F.col("field"), F.lit(" read with "), F.format_string("%.0f", F.col("conf") * 100), F.lit("% confidence; needs a human read."))
    path = F.concat(F.lit(label + "["), F.col("pos").cast("string"), F.lit("]."), F.col("field"))
    return low.select("khata_id", *finding(8 if label == "parcels" else 9, "LOW_FIELD_CONFIDENCE", "WARNING", message, path, observed=F.col("conf"), expected=F.lit(floor), pos=F.col("pos"), entry=F.col("entry")))


def all_findings(khata: DataFrame, parcels: DataFrame, owners: DataFrame) -> DataFrame:
    """All findings as a table: khata_id and the finding's columns, of which PLACE orders those of a holding (O1).

    Every part has its rows by khata_id where the tables have: bucketed tables need no exchange here nor in counts()."""
    parts = [listed(balance(khata, parcels, owners), _metadata_rules() + _area_rules() + _share_rules()), parcel_findings(parcels)]
    parts += [confidence_findings(d, name) for d, name in ((parcels, "parcels"), (owners, "owners")) if "field_confidence" in d.columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score(ocr: Column, layout: Column, math: Column) -> Column:
    a, b, c = WEIGHTS
    return F.round(a * ocr + b * layout + c * math, 4)


def counts(findings: DataFrame) -> DataFrame:
    """Findings of each holding: by severity, failed arithmetic rules, the first critical message."""
    severity = lambda s: F.count_if(F.col("severity") == s)
    rank = F.struct(*PLACE, "message")
    return findings.groupBy("khata_id").agg(
        F.count(F.lit(1)).alias("findings"), severity("CRITICAL").alias("critical"), severity("WARNING").alias("warnings"), severity("INFO").alias("infos"),
        F.bit_count(F.bit_or(F.element_at(F.create_map(*[F.lit(x) for n, c in enumerate(MATH_RULES) for x in (c, 1 << n)]), F.col("code")))).cast("long").alias("math_failed"),
        F.min(F.when(F.col("severity") == "CRITICAL", rank))["message"].alias("first_critical"),
    )


def report(khata: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each holding: counts, the four scores, whether it may be committed."""
    rows = khata.join(counts(findings), "khata_id", "left").fillna(0, ["findings", "critical", "warnings", "infos", "math_failed"])
    math = F.lit(1.0) - F.col("math_failed") / F.lit(float(len(MATH_RULES)))
    ocr, layout = F.coalesce("ocr_confidence", F.lit(0.0)), F.coalesce("layout_confidence", F.lit(0.0))
    rows = rows.withColumns({"ocr_score": F.round(ocr, 4), "layout_score": F.round(layout, 4), "math_score": F.round(math, 4), "final_score": score(ocr, layout, math)})
    return rows.withColumn("committable", (F.col("critical") == 0) & (F.col("final_score") >= THRESHOLD))


def with_findings(reported: DataFrame, findings: DataFrame) -> DataFrame:
    """Reports with their findings as an array, in order."""
    listed = findings.groupBy("khata_id").agg(F.array_sort(F.collect_list(F.struct(*COLUMNS))).alias("finding_list"))
    return reported.join(listed, "khata_id", "left")


def route(reported: DataFrame) -> DataFrame:
    """Approval, processing status, progress and the reason for review."""
    auto = F.col("committable")
    reason = F.coalesce("first_critical", F.concat(F.lit("Confidence "), F.format_string("%.2f", F.col("final_score") * 100), F.lit(f"% is below the {THRESHOLD:.0%} threshold")))
    return reported.withColumns({
        "approval_status": F.when(auto, "AUTO_APPROVED").otherwise("PENDING"), "processing_status": F.when(auto, "COMMITTED").otherwise("NEEDS_REVIEW"),
        "progress_pct": F.when(auto, 100).otherwise(95), "review_reason": F.when(~auto, reason),
    })


def route_log(routed: DataFrame, ts: Column, *kept: str) -> DataFrame:
    """The ledger row of each routed holding (V14), to be numbered and appended; ``kept`` columns come along."""
    auto = F.col("committable")
    done = F.concat(F.lit("Auto-committed at "), F.format_string("%.2f", F.col("final_score") * 100), F.lit("% confidence with no critical findings"))
    return routed.select(
        "khata_id", F.when(auto, "approval_status").otherwise("routing").alias("field_name"), F.when(auto, "PENDING").otherwise("AUTO").alias("raw_value"), F.when(auto, "AUTO_APPROVED").otherwise("NEEDS_REVIEW").alias("corrected_value"),
        F.lit("system").alias("modified_by_user_id"), F.lit("SYSTEM").alias("role"), F.when(auto, done).otherwise(F.col("review_reason")).alias("reason"), ts.cast("timestamp").alias("ts"), *kept,
    )
