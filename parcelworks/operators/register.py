"""Register reads: joins, filters, queue pages, summaries, checks of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROVED = ("AUTO_APPROVED", "MANUALLY_APPROVED")


def by_review_state(khata: DataFrame, state: str) -> DataFrame:
    return khata.where(F.col("approval_status") == "PENDING") if state == "pending" else khata.where(F.col("approval_status").isin(*APPROVED))


def by_village(khata: DataFrame, code: str | None) -> DataFrame:
    return khata if code is None else khata.where(F.col("village_code") == code)


def approved_only(khata: DataFrame, on: bool = True) -> DataFrame:
    return khata.where(F.col("approval_status").isin(*APPROVED)) if on else khata


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def join_village(khata: DataFrame, villages: DataFrame, how: str = "left") -> DataFrame:
    """Without a hint, here and for reviewers: Spark broadcasts the dimension if its size in bytes allows that."""
    return khata.join(villages, "village_code", how)


def owners_listed(owners: DataFrame) -> DataFrame:
    """khata_id, owners (array of struct in order), owner_names and owner_shares joined by " | " (A5, A6)."""
    fields = [c for c in ("pos", "owner_name_vernacular", "owner_name_en", "relation_type", "relative_name", "share_percentage") if c in owners.columns]
    listed = owners.groupBy("khata_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("owners"))
    names = F.array_join(F.transform("owners", lambda o: F.coalesce(o["owner_name_vernacular"], F.lit(""))), " | ")
    shares = F.array_join(F.transform("owners", lambda o: F.coalesce(o["share_percentage"].cast("decimal(7,2)").cast("string"), F.lit(""))), " | ")
    return listed.withColumns({"owner_names": names, "owner_shares": shares})


def join_owners(khata: DataFrame, owners: DataFrame) -> DataFrame:
    return khata.join(owners_listed(owners), "khata_id", "left")


def join_documents(documents: DataFrame, khata: DataFrame) -> DataFrame:
    """Each document with the sorted ids of its holdings."""
    of = khata.groupBy("document_id").agg(F.array_sort(F.collect_list("khata_id")).alias("khata_ids"))
    return documents.join(of, "document_id", "left")


def join_reviewer(khata: DataFrame, users: DataFrame) -> DataFrame:
    return khata.join(users.select(F.col("login_id").alias("reviewed_by"), "display_name"), "reviewed_by", "left")


def queue_order(sort: str, status: str) -> list[Column]:
    if status == "signed":
        return [F.coalesce("reviewed_at", "updated_at").desc_nulls_last(), F.col("khata_id")]
    return [{"confidence": F.col("final_score").asc(), "oldest": F.col("created_at").asc(), "newest": F.col("created_at").desc()}[sort], F.col("khata_id")]


def review_queue(khata: DataFrame, sort: str = "confidence", page: int = 1, size: int = 20, status: str = "pending", village: str | None = None) -> DataFrame:
    """A page of the queue: pages from 1, 1 to 100 rows."""
    rows = by_village(by_review_state(khata, status), village)
    size = min(max(size, 1), 100)
    return rows.orderBy(*queue_order(sort, status)).offset((max(page, 1) - 1) * size).limit(size)


def worst(khata: DataFrame, k: int = 20) -> DataFrame:
    return by_review_state(khata, "pending").orderBy("final_score", "khata_id").limit(k)


def recent(documents: DataFrame, n: int = 20) -> DataFrame:
    return documents.orderBy(F.col("created_at").desc(), "document_id").limit(min(n, 100))


def queue_items(reported: DataFrame, villages: DataFrame) -> DataFrame:
    """Pending holdings as the queue shows them: critical count, first critical or else first message, parcels, village.

    ``reported`` has finding_list (array of struct in rule order) and parcels."""
    severe = F.filter("finding_list", lambda f: f["severity"] == "CRITICAL")
    rows = by_review_state(reported, "pending").withColumns({"critical_count": F.coalesce(F.size(severe), F.lit(0)), "headline": F.coalesce(F.get(severe, F.lit(0))["message"], F.get("finding_list", F.lit(0))["message"])})
    return join_village(rows, villages).select("khata_id", "khata_number", "village_code", "village_name", "final_score", "critical_count", "headline", "parcels")


def summary(khata: DataFrame, parcels: DataFrame) -> DataFrame:
    """One row: totals, approved, pending, parcels, approved hectares, commit rate, mean confidence (A3)."""
    approved = F.col("approval_status").isin(*APPROVED)
    totals = khata.agg(
        F.count(F.lit(1)).alias("khatas"), F.count_if(approved).alias("approved"), F.count_if(F.col("approval_status") == "PENDING").alias("pending"),
        F.bround(F.coalesce(F.sum(F.when(approved, F.col("total_area_sqm"))), F.lit(0).cast("decimal(22,4)")) / F.lit(10000).cast("decimal(5,0)"), 4).cast("decimal(22,4)").alias("approved_hectares"),
        F.coalesce(F.round(F.try_divide(F.count_if(approved), F.count(F.lit(1))), 4), F.lit(0.0)).alias("auto_commit_rate"), F.round(F.avg("final_score"), 4).alias("mean_confidence"),
    )
    return totals.crossJoin(parcels.agg(F.count(F.lit(1)).alias("parcels")))  # one row each


def duplicate_identities(owners: DataFrame) -> DataFrame:
    """identity_digest, khatas: digests that stand in more than one holding."""
    return owners.where("identity_digest is not null").groupBy("identity_digest").agg(F.count_distinct("khata_id").alias("khatas")).where("khatas > 1")


def duplicate_keys(khata: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat; rows with a null in the key are no duplicates."""
    return khata.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def orphan_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose key is not in ``parent``; a null key is none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def latest_status(events: DataFrame, key: str = "document_id") -> DataFrame:
    """The latest status of each document."""
    order = F.struct("ts", "event_id")
    return events.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max("ts").alias("since"))


def ingest_stats(khata: DataFrame, parcels: DataFrame, owners: DataFrame, findings: DataFrame) -> DataFrame:
    """khata_id, parcels, owners, critical."""
    n = lambda d, name: d.groupBy("khata_id").agg(F.count(F.lit(1)).alias(name))
    rows = khata.select("khata_id").join(n(parcels, "parcels"), "khata_id", "left").join(n(owners, "owners"), "khata_id", "left").join(n(findings.where("severity = 'CRITICAL'"), "critical"), "khata_id", "left")
    return rows.fillna(0)


def record_detail(khata: DataFrame, parcels: DataFrame, owners: DataFrame, audit: DataFrame, findings: DataFrame, last: int = 100) -> DataFrame:
    """Header with its parcels, owners, findings in rule order and latest ledger rows as arrays."""
    from parcelworks.operators.ledger import tail
    from parcelworks.operators.rules import with_findings

    p = parcels.groupBy("khata_id").agg(F.array_sort(F.collect_list(F.struct("pos", "khasra_number", "plot_area_sqm"))).alias("parcel_list"))
    a = tail(audit, last).groupBy("khata_id").agg(F.array_sort(F.collect_list(F.struct("nth", "field_name", "corrected_value"))).alias("audit_list"))
    return with_findings(khata, findings).join(p, "khata_id", "left").join(owners_listed(owners), "khata_id", "left").join(a, "khata_id", "left")
