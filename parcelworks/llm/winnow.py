"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a k-gram and k-grams of a window. Any run of K + WINDOW - 1 units that two texts share leaves a common hash.
K, WINDOW = 5, 12
#: Scripts written without spaces (Thai, Lao, kana, ideographs): each code point is a unit of its own.
WIDE = r"\u0E00-\u0EFF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF"
#: Low bits that hold the position when hashes are compared; no array is longer.
PLACE = 28


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value made once: a one-element array that a higher-order function opens."""
    return F.element_at(F.transform(F.array(value), lambda x: of(x)), 1)


def _from(array: Column, start: int) -> Column:
    return F.slice(array, start + 1, 1 << 30)


def _units(text: Column) -> Column:
    lowered = F.lower(text)
    words = F.filter(F.split(lowered, r"[\x09-\x0D\x20]+"), lambda w: w != "")
    return F.when(F.rlike(lowered, F.lit(f"[{WIDE}]")), F.regexp_extract_all(lowered, F.lit(rf"[{WIDE}]|[^\x09-\x0D\x20{WIDE}]+"), F.lit(0))).otherwise(words)


def _rolled(h: Column, k: int) -> Column:
    """Cyclic-polynomial rolling hash of the ``k`` hashes from each position on (null where there are fewer).

    A longer run's hash is the rotated one of its beginning, exclusive or that of its end: so runs of k are made of runs
    of k / 2 that neighbours share, in log(k) passes. A state carried from position to position takes ten times as long
    in Spark's aggregate.
    """

    def joined(a: Column, b: Column, n: int) -> Column:
        return F.zip_with(a, b, lambda x, y: F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)).bitwiseXOR(y))

    if k == 1:
        return h
    if k % 2:
        return joined(_rolled(h, k - 1), _from(h, k - 1), 1)
    return _let(_rolled(h, k // 2), lambda r: joined(r, _from(r, k // 2), k // 2))


def _grams(text: Column, k: int) -> Column:
    """Hash of the ``k`` units from each position on; of all units when there are fewer; none of no units."""

    def rolled(h: Column) -> Column:
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) < k, short).otherwise(F.transform(F.slice(_rolled(h, k), 1, F.size(h) - (k - 1)), lambda x: F.xxhash64(x)))

    return _let(F.transform(_units(text), lambda w: F.xxhash64(w)), rolled)


def _least(packed: Column, n: int) -> Column:
    """The least of the ``n`` values from each position on, or of those that there are, in log(n) passes."""
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))
    if n == 1:
        return packed
    if n % 2:
        return both(_least(packed, n - 1), _from(packed, n - 1))
    return _let(_least(packed, n // 2), lambda r: both(r, _from(r, n // 2)))


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<struct<pos int, hash bigint>>: the winnowed k-gram hashes of a text, by position (from 0, in units).

    Units are words between white space, or code points of scripts without it. Of every ``window`` consecutive k-grams
    that with the least hash (by its upper 36 bits) is kept, of equal ones the rightmost, once for a position. A text with
    fewer k-grams than the window keeps the least of all; one with no units, or null, keeps none.
    """
    low = F.lit((1 << PLACE) - 1).cast("long")

    def chosen(h: Column) -> Column:
        packed = F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, PLACE), PLACE).bitwiseOR(low - i))
        picks = F.array_distinct(F.slice(_let(packed, lambda p: _least(p, window)), 1, F.greatest(F.size(h) - (window - 1), F.lit(1))))
        marks = F.transform(picks, lambda p: _let(low - p.bitwiseAND(low), lambda at: F.struct(at.cast("int").alias("pos"), F.element_at(h, at.cast("int") + 1).alias("hash"))))
        return F.when(F.size(h) > 0, marks).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return _let(_grams(F.coalesce(text, F.lit("")), k), chosen)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; 1 for two empty ones."""
    x, y = F.array_distinct(a["hash"]), F.array_distinct(b["hash"])
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def printed(marks: Column) -> Column:
    """pos:hash (hexadecimal), joined by spaces."""
    return F.array_join(F.transform(marks, lambda m: F.concat(m["pos"].cast("string"), F.lit(":"), F.lower(F.hex(m["hash"])))), " ")


#: Slices of ids at most; beyond, slices get longer (their rows are sorted on disk where memory ends).
SLICES = 100_000


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", rows_per_slice: int = 2000) -> DataFrame:
    """(doc_id, columns..., next_columns...): each row with those of the next one by descending id; after the last, the first.

    A null id comes after all others; rows that repeat an id follow each other by their columns. One row is its own next;
    an empty table stays empty. Ids are cut into slices at ids that exist, so each slice needs one more row than its own:
    the one that it ends at, which is dealt to both. Only the cutting ids reach the driver, and a row finds its slice in
    two steps, by coarse and by fine cuts.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("key"), *columns)
    count = docs.count()
    if not count:
        return base.select("doc_id", *columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    slices = max(1, min(SLICES, count // rows_per_slice))
    marks = [i / slices for i in range(1, slices)] or [1.0]
    found = base.agg(F.percentile_approx("key", marks, 10 * slices).alias("cuts"), F.max("key").alias("top")).first()
    cuts = sorted(set(found.cuts) - {found.top})
    longs = lambda values: F.array(*[F.lit(c).cast("long") for c in values]) if values else F.array().cast("array<bigint>")
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda array: F.size(F.filter(array, lambda c: c < F.col("key")))
    coarse = below(longs(cuts[step - 1 :: step]))
    rows = base.withColumn("coarse", coarse).withColumn("fine", F.slice(longs(cuts), F.col("coarse") * step + 1, step))
    rows = rows.withColumn("slice", F.col("coarse") * step + below(F.col("fine")))  # ids in (cut, next cut]
    guest = lambda on, place: F.when(on, F.array(F.struct(place.alias("slice"), F.lit(True).alias("guest")))).otherwise(F.array().cast("array<struct<slice:int,guest:boolean>>"))
    places = F.concat(
        F.array(F.struct(F.col("slice"), F.lit(False).alias("guest"))),
        guest(F.array_contains("fine", F.col("key")), F.col("slice") + 1),
        guest(F.col("key") == found.top, F.lit(0)),
    )
    dealt = rows.select("doc_id", "key", *columns, F.explode(places).alias("p")).select("doc_id", "key", *columns, "p.slice", "p.guest")
    order = Window.partitionBy("slice").orderBy("guest", F.col("key").desc(), *columns)
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not guest").select("doc_id", *columns, *[f"next_{c}" for c in columns])


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    Edited: the last floor(n_chars / 2) code points give way to as many (or all) first ones of the next document.
    Returns doc_id, n_chars, edited_sha256, marks, edited_marks (array<struct<pos,hash>>), near_edited, near_next.
    """
    made = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(made.withColumn("marks", fingerprint(F.col("text"), k, window)), ["text", "marks"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"), "marks", "next_marks")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "marks", fingerprint(F.col("edited"), k, window).alias("edited_marks"), "next_marks")
    return rows.select("doc_id", "n_chars", "edited_sha256", "marks", "edited_marks", likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))
