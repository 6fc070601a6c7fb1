"""URL filters: fixed host and path rules, and a tree of path templates judged by labelled purity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.common import drop, save

#: More different segments than this in one place are one variable; siblings whose shares of good pages differ by this many
#: standard errors at most are one branch.
BRANCHES, SIMILAR = 16, 2.0
#: Labelled pages that the prior counts as, and the purity below which a template is rejected.
PRIOR, PURE = 4.0, 0.5

#: Rule (host and path prefix), verdict.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// to /, ?, # or the end, A-Z lowered; path: from there to ?, # or the end. Both are empty
    for a null url and one without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and all subdomains, where the path
    starts with the rule's path."""
    rule = verdict = F.lit(None).cast("string")
    for name, said in sorted(rules, key=lambda r: len(r[0])):  # longer ones later, so that they win
        at, _, rest = name.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    """Segments of a path, numbers and long hexadecimal runs generalised; an empty path has none."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9a-fA-F]{8,}(?=$|\.)|^[0-9a-f-]{32,}", "*"), r"\d+", "*"))


def agglomerate(siblings: dict[str, tuple[int, int]]) -> dict[str, str]:
    """The branch that each of one place's segments goes to: ``siblings`` has the labelled and the good pages of each.

    Of all pairs of branches the most alike are merged, time and again, while their shares of good pages differ by at most
    ``SIMILAR`` standard errors (of the pair's common share, one good and one bad page added). Segments without labels
    stay alone. A branch of all segments is called *, one of several a|b.
    """
    branches = {(s,): x for s, x in sorted(siblings.items())}
    while True:
        best, pair = SIMILAR, None
        labelled = [b for b in branches if branches[b][0]]
        for i, x in enumerate(labelled):
            for y in labelled[i + 1 :]:
                (l1, g1), (l2, g2) = branches[x], branches[y]
                common = (g1 + g2 + 1) / (l1 + l2 + 2)
                apart = abs(g1 / l1 - g2 / l2) / math.sqrt(common * (1 - common) * (1 / l1 + 1 / l2))
                if apart <= best and (pair is None or apart < best):
                    best, pair = apart, (x, y)
        if pair is None:
            return {s: (s if len(b) == 1 else "*" if len(b) == len(siblings) else "|".join(b)) for b in branches for s in b}
        x, y = pair
        l1, g1 = branches.pop(x)
        l2, g2 = branches.pop(y)
        branches[tuple(sorted(x + y))] = (l1 + l2, g1 + g2)


def _branches(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (host, place), siblings in rows.groupby(["host", "place"], sort=False):
        found = agglomerate({s: (int(l), int(g)) for s, l, g in zip(siblings.segment, siblings.labelled, siblings.good, strict=True)})
        out += [(host, place, s, b) for s, b in found.items() if s != b]
    return pd.DataFrame(out, columns=["host", "place", "segment", "branch"])


def templates(pages: DataFrame) -> DataFrame:
    """The tree's leaves: (host, shape, n, labelled, good, template).

    ``pages`` is (host, path, label 0, 1 or null). Paths are first counted by host and shape. From the root down, a place of
    a template with more than ``BRANCHES`` different segments becomes a wildcard: the segments of a place are counted by two
    groupings, never gathered, so a host may have as many shapes as pages. Then, from the leaves up, templates that differ
    in one place only, ``BRANCHES`` at most, are agglomerated. There is a round for each level at which paths of one host
    and length differ, and no other.
    """
    label = F.col("label")
    shapes = pages.select("host", _shape(F.col("path")).alias("shape"), "label").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count_if(label.isin(0, 1)).alias("labelled"), F.count_if(label == 1).alias("good"))
    tree = save(shapes.withColumn("template", F.col("shape")), "tree")
    segments = tree.select("host", F.size("shape").alias("length"), F.posexplode("shape").alias("level", "segment"))
    differ = segments.groupBy("host", "length", "level").agg((F.min("segment") < F.max("segment")).alias("differ")).where("differ")
    levels = sorted(r.level for r in differ.select("level").distinct().collect())
    put = lambda array, d, new: F.transform(array, lambda s, i: F.when(i == d, new).otherwise(s))
    place = ["host", "length", "prefix"]
    for d in levels:
        at = tree.withColumns({"length": F.size("template"), "prefix": F.slice("template", 1, d), "segment": F.get("template", F.lit(d))})
        many = at.where("segment is not null").select(*place, "segment").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("branches")).where(F.col("branches") > BRANCHES)
        wild = at.join(many, place, "left").withColumn("template", F.when(F.col("branches").isNotNull(), put("template", d, F.lit("*"))).otherwise(F.col("template")))
        before, tree = tree, save(wild.select("host", "shape", "n", "labelled", "good", "template"), "tree")
        drop(before)
    leaves = save(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good")).withColumn("now", F.col("template")), "leaves")
    text = lambda d: F.to_json(F.transform("now", lambda s, i: F.when(i != d, s)))  # noqa: E731  the template with the place left open
    for d in reversed(levels):
        at = leaves.where(F.get("now", F.lit(d)).isNotNull()).select("host", text(d).alias("place"), F.get("now", F.lit(d)).alias("segment"), "labelled", "good")
        own = at.groupBy("host", "place", "segment").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        several = own.groupBy("host", "place").agg(F.count_if(F.col("labelled") > 0).alias("k")).where("k > 1").drop("k")
        merged = own.join(several, ["host", "place"]).groupBy(F.pmod(F.xxhash64("host", "place"), F.lit(8192))).applyInPandas(_branches, "host string, place string, segment string, branch string")
        keyed = leaves.withColumns({"place": text(d), "segment": F.get("now", F.lit(d))}).join(merged, ["host", "place", "segment"], "left")
        before, leaves = leaves, save(keyed.select("host", "template", "labelled", "good", F.when(F.col("branch").isNotNull(), put("now", d, F.col("branch"))).otherwise(F.col("now")).alias("now")), "leaves")
        drop(before)
    return tree.join(leaves.select("host", "template", "now"), ["host", "template"]).select("host", "shape", "n", "labelled", "good", F.col("now").alias("template"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), template, purity of every page.

    The longest rule that fits decides; else the page's template, blocked where (good + PRIOR * share of good pages in
    all) / (labelled + PRIOR) is below ``PURE``. ``labels`` is (page_id, label 0 or 1); of several labels of a page the
    least counts. A page without label counts for none; without any labels nothing is rejected. Null urls have an empty
    host and path and are judged like others; repeated rows are judged each.
    """
    host, path = host_and_path(F.col(url_col))
    known = labels.where("label in (0, 1)").groupBy("page_id").agg(F.min("label").alias("label"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labelled = rows.join(known, "page_id", "left")
    tree = templates(labelled.select("host", "path", "label"))
    good, of = tree.agg(F.sum("good"), F.sum("labelled")).first()
    share = good / of if of else 1.0
    leaf = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    leaf = leaf.select("host", "template", ((F.col("good") + PRIOR * share) / (F.col("labelled") + PRIOR)).alias("purity"))
    of_shape = tree.select("host", "shape", "template").join(leaf, ["host", "template"])
    found = rows.withColumn("shape", _shape(F.col("path"))).join(of_shape, ["host", "shape"], "left")
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("purity") < PURE, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.array_join("template", "/").alias("template"), "purity")
