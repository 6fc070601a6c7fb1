"""Reviewer corrections as change data: merge, change log, decision, document status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.functions.ids import identity_digest
from parcelworks.functions.text import RELATIONS
from parcelworks.operators import ledger, rules

PARCEL, OWNER = ("khasra_number", "plot_area_sqm"), ("owner_name_vernacular", "share_percentage")
OVERRIDE_REASON = "Tehsildar override on open critical findings"
HEADER_FIELDS = ("khata_number", "total_area_sqm", "fasli_year")


def merge_detail(existing: DataFrame, corrections: DataFrame, values: tuple[str, ...], key: str = "pos", carried: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows against the corrections of the same holdings.

    Corrections have khata_id, ``key`` (null for a new row), ``values`` and is_delete. Only holdings with a correction
    are merged. Returns action (insert, update, delete, keep), the new values and, as old_*, the old ones; a delete of an
    unknown row is left out, an unknown key is an insert, an existing row that is not mentioned is deleted. ``carried``
    columns of the corrections come along without making a row an update; where they are null the old ones stay.
    """
    touched = corrections.select("khata_id").distinct()
    old = existing.join(touched, "khata_id", "left_semi").select("khata_id", F.col(key).alias("key_"), *[F.col(v).alias(f"old_{v}") for v in values], *[(F.col(c) if c in existing.columns else F.lit(None).cast("string")).alias(f"old_{c}") for c in carried])
    new = corrections.select("khata_id", F.col(key).alias("key_"), *values, *carried, F.coalesce("is_delete", F.lit(False)).alias("is_delete"), F.lit(True).alias("said"))
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"old_{v}"))
    action = F.when(F.col("said").isNull() | F.col("is_delete"), "delete").when(changed, "update").otherwise("keep")
    # An outer join in two halves, since both keep the rows where their holding's are; a full one would deal them anew.
    known = old.join(new, ["khata_id", "key_"], "left").withColumn("action", action)
    added = new.where("not is_delete").join(old.select("khata_id", "key_"), ["khata_id", "key_"], "left_anti")
    added = added.select("*", *[F.lit(None).cast(old.schema[f"old_{v}"].dataType).alias(f"old_{v}") for v in (*values, *carried)], F.lit("insert").alias("action"))
    columns = ["khata_id", F.col("key_").alias(key), "action", *values, *[f"old_{v}" for v in values], *[F.coalesce(c, f"old_{c}").alias(c) for c in carried]]
    return known.select(*columns).unionByName(added.select(*columns))


def merge_parcels(parcels: DataFrame, corrections: DataFrame) -> DataFrame:
    return merge_detail(parcels, corrections, ("khasra_number", "plot_area_sqm"))


def merge_owners(owners: DataFrame, corrections: DataFrame, salt: str | None = None) -> DataFrame:
    """As for parcels; with a salt an identity_number of the corrections, also of new owners, is kept as its digest. Where the corrections
    have a relation_type and a relative_name these are merged too, relation words as their codes (C3)."""
    values = OWNER
    if "relation_type" in corrections.columns:
        values = (*OWNER, "relation_type", "relative_name")
        codes = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
        said = F.lower(F.col("relation_type"))
        corrections = corrections.withColumn("relation_type", F.coalesce(F.element_at(codes, said), F.when(F.col("relation_type").isin(*RELATIONS.values()), F.col("relation_type"))))
        owners = owners.withColumns({c: F.lit(None).cast("string") for c in values if c not in owners.columns})
    if salt is None:
        return merge_detail(owners, corrections, values)
    return merge_detail(owners, corrections.withColumn("identity_digest", identity_digest(F.col("identity_number"), salt)), values, carried=("identity_digest",))


def merged_rows(merged: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """The rows that stand after the merge, numbered anew: inserted ones come last."""
    order = Window.partitionBy("khata_id").orderBy(F.col("action") == "insert", F.col("pos").asc_nulls_last(), *values)
    return merged.where("action <> 'delete'").select("khata_id", (F.row_number().over(order) - 1).alias("pos"), *values)


def standing_rows(existing: DataFrame, merged: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """All rows after the merge: those of merged holdings, and the existing ones of holdings without a correction."""
    other = existing.join(merged.select("khata_id").distinct(), "khata_id", "left_anti").select("khata_id", "pos", *values)
    return other.unionByName(merged_rows(merged, values))


def revalidate(khata: DataFrame, parcels: DataFrame, owners: DataFrame) -> DataFrame:
    """Report on corrected records as a reviewer's: full trust in the reading, a layout of 0.9 at least, no confidences of
    fields (C5)."""
    checked = khata.withColumns({"ocr_confidence": F.lit(1.0), "layout_confidence": F.greatest(F.coalesce("layout_confidence", F.lit(0.0)), F.lit(0.9))})
    return rules.report(checked, rules.all_findings(checked, parcels.drop("field_confidence"), owners.drop("field_confidence")))


def decided(khata: DataFrame, parcels: DataFrame, owners: DataFrame, requests: DataFrame, p: DataFrame, o: DataFrame) -> DataFrame:
    """Decisions on requests, by what stands after the merges ``p`` and ``o`` of parcels and owners."""
    return decide(revalidate(khata, standing_rows(parcels, p, PARCEL), standing_rows(owners, o, OWNER)), requests)


def reviewed(khata: DataFrame, parcels: DataFrame, owners: DataFrame, requests: DataFrame, parcel_corrections: DataFrame, owner_corrections: DataFrame, audit: DataFrame, headers: DataFrame | None = None, keep=None) -> dict[str, DataFrame]:
    """What requests with corrections do, in parts: the merged ``parcels`` and ``owners``, ``decisions``, ``log`` and the ``report``.

    ``keep`` (table, name) writes a table and reads it again. With it each part is made once, though several others read
    it; of ``audit`` just the latest entries are kept. Without it all is one plan, in which they are made again and again.
    """
    keep = keep or (lambda d, _: d)
    asked = lambda d: d.join(requests.select("khata_id"), "khata_id", "left_semi")
    khata = asked(khata)
    new = khata if headers is None else asked(headers)
    p, o = keep(merge_parcels(parcels, asked(parcel_corrections)), "merged_parcels"), keep(merge_owners(owners, asked(owner_corrections)), "merged_owners")
    decisions = keep(decided(new, asked(parcels), asked(owners), requests, p, o), "decisions")
    row = lambda d, stage: d.select("khata_id", F.lit(stage).alias("stage"), (F.col("pos") if "pos" in d.columns else F.lit(0)).cast("long").alias("pos"), "field_name", "raw_value", "corrected_value")
    override = decisions.where("override").select("khata_id", F.lit("approval.override").alias("field_name"), F.format_string("%d critical finding(s) open", F.col("critical")).alias("raw_value"), F.lit("MANUALLY_APPROVED").alias("corrected_value"))
    changes = row(detail_changes(p, "parcel", "khasra_number", {c: c for c in PARCEL}), 1).union(row(detail_changes(o, "owner", "owner_name_vernacular", {"owner_name_vernacular": "name", "share_percentage": "share_percentage"}), 2)).union(row(override, 3))
    if headers is not None:
        changes = changes.union(row(header_changes(khata, new, tuple(f for f in HEADER_FIELDS if f in khata.columns)), 0))
    said = requests.select("khata_id", F.col("user").alias("modified_by_user_id"), "role", "reason", "ts")
    last = keep(ledger.latest(audit), "latest")
    rows = ledger.numbered(last.select("khata_id", F.col("most").alias("log_id")), changes.join(said, "khata_id").withColumn("reason", F.when(F.col("field_name") == "approval.override", F.coalesce("reason", F.lit(OVERRIDE_REASON))).otherwise(F.col("reason"))), "stage", F.col("pos").asc_nulls_last(), "field_name", "raw_value", "corrected_value").drop("stage", "pos")
    log = keep(ledger.append(last, rows), "log")
    entries = [d.select("khata_id", "log_id", "ts", "entry_hash") for d in (last, log)]
    heads = ledger.heads(entries[0].union(entries[1])).select("khata_id", F.col("head").alias("ledger_head"))
    return {"parcels": p, "owners": o, "decisions": decisions, "log": log, "report": decision_report(decisions, log).join(heads, "khata_id", "left")}


def verify(khata: DataFrame, parcels: DataFrame, owners: DataFrame, requests: DataFrame, parcel_corrections: DataFrame, owner_corrections: DataFrame, audit: DataFrame, headers: DataFrame | None = None, keep=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What requests with corrections do: decisions on the merged and re-validated records, the chained ledger rows of all
    changes and overrides, and the report with the ledger's head (C1-C6, C10).

    ``requests`` is (khata_id, user, role, force_approve, reason, ts), ``headers`` the corrected headers if there are any;
    corrections count for holdings with a request only, and an override without a reason has OVERRIDE_REASON. ``ts`` is not before a holding's latest entry in ``audit``.
    """
    made = reviewed(khata, parcels, owners, requests, parcel_corrections, owner_corrections, audit, headers, keep)
    return made["decisions"], made["log"], made["report"]


def orphans(existing: DataFrame, corrections: DataFrame, key: str = "pos") -> DataFrame:
    """Existing rows of corrected holdings that no correction mentions."""
    touched = corrections.select("khata_id").distinct()
    return existing.join(touched, "khata_id", "left_semi").join(corrections.where(f"{key} is not null").select("khata_id", key), ["khata_id", key], "left_anti")


def header_changes(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = HEADER_FIELDS) -> DataFrame:
    """khata_id, field_name, raw_value, corrected_value for each header value that differs; typed, so 100 is 100.0000."""
    both = old.select("khata_id", *[F.col(f).alias(f"old_{f}") for f in fields]).join(new.select("khata_id", *fields), "khata_id")
    rows = [F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.struct(F.lit(f).alias("field_name"), F.col(f"old_{f}").cast("string").alias("raw_value"), F.col(f).cast("string").alias("corrected_value"))) for f in fields]
    return both.select("khata_id", F.inline(F.array_compact(F.array(*rows))))


def detail_changes(merged: DataFrame, entity: str, label: str, fields: dict[str, str]) -> DataFrame:
    """Change log of a merged detail: entity.added, .deleted and one row for each changed field (C4)."""
    row = lambda test, name, raw, new: F.when(test, F.struct(F.lit(f"{entity}.{name}").alias("field_name"), raw.cast("string").alias("raw_value"), new.cast("string").alias("corrected_value")))
    none = F.lit(None)
    action = F.col("action")
    rows = [row(action == "insert", "added", none, F.col(label)), row(action == "delete", "deleted", F.col(f"old_{label}"), none)]
    rows += [row((action == "update") & ~F.col(f).eqNullSafe(F.col(f"old_{f}")), name, F.col(f"old_{f}"), F.col(f)) for f, name in fields.items()]
    return merged.select("khata_id", "pos", F.inline(F.array_compact(F.array(*rows))))


def decide(reported: DataFrame, requests: DataFrame) -> DataFrame:
    """Decision on each request (khata_id, user, role, force_approve): approved without critical findings, or by force of
    a senior reviewer, which is an override to be written to the ledger; else pending (C6)."""
    rows = reported.join(requests, "khata_id")
    force = F.coalesce("force_approve", F.lit(False)) & (F.col("role") == "TEHSILDAR")
    approved = (F.col("critical") == 0) | force
    return rows.withColumns({"decision": F.when(approved, "MANUALLY_APPROVED").otherwise("PENDING"), "override": approved & (F.col("critical") > 0)})


def reject(khata: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rejected holdings, and a ledger row for each with the status before."""
    rows = khata.join(requests, "khata_id")
    log = rows.select("khata_id", F.lit("approval_status").alias("field_name"), F.col("approval_status").alias("raw_value"), F.lit("REJECTED").alias("corrected_value"), F.col("user").alias("modified_by_user_id"), "role", "reason")
    return rows.select("khata_id", F.lit("REJECTED").alias("approval_status"), "user"), log


def sync_documents(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents with the status that the decision on their holding gives them."""
    said = decisions.groupBy("document_id").agg(F.bool_and(F.col("decision") == "MANUALLY_APPROVED").alias("approved"))
    rows = documents.join(said, "document_id", "left")
    return rows.withColumns({
        "status": F.when(F.col("approved"), "COMMITTED").when(~F.col("approved"), "NEEDS_REVIEW").otherwise(F.col("status")),
        "progress_pct": F.when(F.col("approved"), 100).when(~F.col("approved"), 90).otherwise(F.col("progress_pct")),
    }).drop("approved")


def record_diff(old: DataFrame, new: DataFrame, tolerance: str = "0.0001") -> DataFrame:
    """Parcels that were removed, added or differ by more than the tolerance."""
    a = old.select("khata_id", "pos", F.col("khasra_number").alias("old_khasra"), F.col("plot_area_sqm").alias("old_area"))
    b = new.select("khata_id", "pos", F.col("khasra_number").alias("new_khasra"), F.col("plot_area_sqm").alias("new_area"))
    rows = a.withColumn("was", F.lit(True)).join(b.withColumn("is", F.lit(True)), ["khata_id", "pos"], "full_outer")
    far = F.abs(F.coalesce("new_area", F.lit(0).cast("decimal(12,4)")) - F.coalesce("old_area", F.lit(0).cast("decimal(12,4)"))) > F.lit(tolerance).cast("decimal(10,4)")
    kind = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(far | ~F.col("old_khasra").eqNullSafe(F.col("new_khasra")), "changed")
    return rows.withColumn("change", kind).where("change is not null").drop("was", "is")


def owner_diff(old: DataFrame, new: DataFrame, tolerance: str = "0.001") -> DataFrame:
    """Owners that were removed, added or have another name or a share that differs by more than the tolerance."""
    a = old.select("khata_id", "pos", F.col("owner_name_vernacular").alias("old_name"), F.col("share_percentage").alias("old_share"))
    b = new.select("khata_id", "pos", F.col("owner_name_vernacular").alias("new_name"), F.col("share_percentage").alias("new_share"))
    rows = a.withColumn("was", F.lit(True)).join(b.withColumn("is", F.lit(True)), ["khata_id", "pos"], "full_outer")
    far = F.abs(F.coalesce("new_share", F.lit(0).cast("decimal(5,2)")) - F.coalesce("old_share", F.lit(0).cast("decimal(5,2)"))) > F.lit(tolerance).cast("decimal(10,4)")
    kind = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(far | ~F.col("old_name").eqNullSafe(F.col("new_name")), "changed")
    return rows.withColumn("change", kind).where("change is not null").drop("was", "is")


def decision_report(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """khata_id, audit_rows, committed: what a request did."""
    rows = log.groupBy("khata_id").agg(F.count(F.lit(1)).alias("audit_rows"))
    return decisions.select("khata_id", (F.col("decision") == "MANUALLY_APPROVED").alias("committed")).join(rows, "khata_id", "left").fillna(0, ["audit_rows"])


def split_evenly(owners: DataFrame) -> DataFrame:
    """Equal shares: 100 / n cut to 2 decimals, the first owner takes the rest."""
    return _shares(owners, F.floor(F.lit(10000) / F.col("n")) / 100)


def implied_shares(owners: DataFrame) -> DataFrame:
    """Where no owner of a holding has a share: 100 / n rounded half to even, the rest to the first (E8). One pass over the
    owners, whose rows may be dear to make."""
    every = Window.partitionBy("khata_id")
    rows = owners.withColumns({"printed": F.count("share_percentage").over(every), "said": F.col("share_percentage")})
    made = _shares(rows, F.bround(F.lit(100).cast("decimal(5,2)") / F.col("n"), 2))
    none = F.col("printed") == 0
    fraction = F.when(none, F.concat(F.lit("1/"), F.col("n").cast("string"), F.lit(" (implied)"))).otherwise(F.col("share_fraction") if "share_fraction" in owners.columns else F.lit(None))
    return made.withColumns({"share_percentage": F.when(none, F.col("share_percentage")).otherwise(F.col("said")), "share_fraction": fraction}).drop("printed", "said", "n")


def _shares(owners: DataFrame, equal: Column) -> DataFrame:
    every = Window.partitionBy("khata_id")
    rows = owners.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("equal", equal.cast("decimal(5,2)"))
    first = F.row_number().over(every.orderBy("pos")) == 1
    return rows.withColumn("share_percentage", F.when(first, F.lit(100).cast("decimal(5,2)") - F.col("equal") * (F.col("n") - 1)).otherwise(F.col("equal")).cast("decimal(5,2)")).drop("equal")
