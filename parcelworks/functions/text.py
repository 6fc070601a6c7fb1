"""Column functions on register text: digits, blanks, labels, shares, relations, classes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelworks.functions.unicode import canonical

# Devanagari digits and the zero-width characters that are dropped.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
ZERO_WIDTH = "​‌‍"
UNREAD = "UNREAD"

# Relation words and what they are recorded as, longest first so that a daughter is not read as a son.
RELATIONS = {"पुत्री": "D/o", "पत्नी": "W/o", "पुत्र": "S/o", "आत्मज": "S/o", "वल्द": "S/o", "s/o": "S/o", "d/o": "D/o", "w/o": "W/o", "c/o": "C/o"}

# Land class keywords, each before those it contains.
LAND_CLASSES = {"असिंचित": "Unirrigated", "सिंचित": "Irrigated", "बंजर": "Barren", "आबादी": "Habitation", "चरागाह": "Pasture", "बागायत": "Orchard", "जिरायत": "Dry crop", "unirrigated": "Unirrigated", "irrigated": "Irrigated", "barren": "Barren"}

# Patterns of printed numbers, in the order in which they are tried. Group 1 is the number.
LABEL = r"(?:स\S*|क्रमांक|क्र\.?|नं\.?|no\.?)"
KHATA_PATTERNS = (
    r"(?:खाता|खता|खाते)(?U)\s*" + LABEL + r"?\s*[:\-]?\s*([0-9]+[अ-ह0-9/\-]*)",
    r"(?i)khata\s*(?:no\.?|number)?\s*[:\-]?\s*([0-9][0-9/\-]*)",
    r"(?:खाते|गट)(?U)\s*क्रमांक\s*[:\-]?\s*([0-9/\-]+)",
)
KHASRA_PATTERNS = (
    r"(?:खसरा|सर्वे|गट)(?U)\s*" + LABEL + r"?\s*[:\-]?\s*([0-9][0-9/\-अ-ह]*)",
    r"(?i)(?:khasra|survey|gat)\s*(?:no\.?|number)?\s*[:\-]?\s*([0-9][0-9/\-]*)",
)
BARE_KHASRA = r"^(?U)\s*([0-9]{1,5}(?:/[0-9अ-ह]+)?)\b"
TOTAL_LABEL = r"(?i)(योग|कुल|एकूण|total)"
OWNER_HEADING = r"(?i)खातेदार|भूमिस्वामी|भूधारक|owner"
SHARE = r"(\d+)\s*/\s*(\d+)|(\d+(?:\.\d+)?)\s*%"

SHARE_TYPE = "decimal(9,2)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalise_digits(c) -> Column:
    """Composed text (of the Indic scripts; for others see nfc), its digits as ASCII, zero-width characters dropped."""
    return F.translate(canonical(_col(c)), DEVANAGARI_DIGITS + ZERO_WIDTH, "0123456789")


def nfc(c) -> Column:
    """Unicode NFC, for input that may be decomposed; Spark has no built-in for it, so this is an Arrow function."""
    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return compose(_col(c))


def strip(c) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(_col(c), r"^(?U)\s+|(?U)\s+$", "")


def is_unread(c) -> Column:
    """Whether a khata number is null, blank or marked as unread."""
    return F.upper(strip(F.coalesce(_col(c), F.lit("")))).isin("", UNREAD)


def first_match(c, patterns) -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    found = [F.regexp_extract(_col(c), p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def khata_number(c) -> Column:
    return first_match(normalise_digits(c), KHATA_PATTERNS)


def khasra_number(c) -> tuple[Column, Column]:
    """The survey number of a line, labelled or bare at its start, and whether it is labelled."""
    text = normalise_digits(c)
    labelled = first_match(text, KHASRA_PATTERNS)
    return F.coalesce(labelled, first_match(text, (BARE_KHASRA,))), labelled.isNotNull()


def is_total_line(c) -> Column:
    return normalise_digits(c).rlike(TOTAL_LABEL)


def share(c) -> tuple[Column, Column]:
    """Share in percent and the fraction as printed: n/d rounded half to even, p% as it is; null for none or n/0."""
    text = normalise_digits(c)
    n, d, p = (F.regexp_extract(text, SHARE, i) for i in (1, 2, 3))
    ratio = F.bround(F.try_divide(n.try_cast("decimal(12,0)") * 100, d.try_cast("decimal(12,0)")), 2)
    percent = F.when(p != "", p.try_cast("decimal(9,2)")).when(d != "", ratio.cast(SHARE_TYPE)).cast(SHARE_TYPE)
    printed = F.when(p != "", F.concat(p, F.lit("%"))).when((d != "") & ratio.isNotNull(), F.concat(n, F.lit("/"), d))
    return percent, printed


def relation(c) -> tuple[Column, Column, Column]:
    """Owner, relation and relative of a line such as "A son of B"; nulls where no relation word stands between two names."""
    words = "|".join(RELATIONS)
    pattern = rf"(?i)^(.+?)(?U)\s*({words})\s*(.+)$"
    text = strip(c)
    word = F.lower(F.regexp_extract(text, pattern, 2))
    code = F.element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), F.when(word != "", word))
    trim = lambda x: F.regexp_replace(x, r"^[ ,।:\-]+|[ ,।:\-]+$", "")
    relative = F.element_at(F.split(F.regexp_extract(text, pattern, 3), r"(?U)\s{2,}|(?U)\d"), 1)
    return F.when(word != "", trim(F.regexp_extract(text, pattern, 1))), code, F.when(word != "", trim(relative))


def land_class(c) -> Column:
    out = F.lit(None).cast("string")
    for word, name in reversed(LAND_CLASSES.items()):
        out = F.when(F.lower(_col(c)).contains(word), name).otherwise(out)
    return out


def confidence_band(c) -> Column:
    """high from 0.85 on, medium from 0.5 on or unknown, else low."""
    c = _col(c)
    return F.when(c.isNull(), "medium").when(c >= 0.85, "high").when(c >= 0.5, "medium").otherwise("low")


# Fixed value: the characters that a survey number may have.
ALLOWED_KHASRA = "0123456789/-अआइईउऊकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह "


def unexpected_characters(c, allowed: str = ALLOWED_KHASRA) -> Column:
    """The distinct characters of the text that are not among ``allowed``, sorted and joined; empty if none."""
    rest = F.translate(_col(c), allowed, "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda x: x != ""))), "")
