"""Canonical composition against Python's own, on random strings of the Indic blocks."""

import random
import unicodedata

from pyspark.sql import functions as F

from parcelworks.functions import text, unicode


def test_composition_equals_nfc(spark):
    rng = random.Random(11)
    first, last = unicode.INDIC
    known = [chr(n) for n in range(first, last + 1) if unicodedata.name(chr(n), "")]
    marks = [c for c in known if unicodedata.combining(c)] + ["া", "ৗ", "ା", "ୖ", "ୗ", "ா", "ௗ", "ౖ", "ೂ", "ೕ", "ೖ", "ാ", "ൗ", "්", "ා", "ෟ"]
    apart = [c for c in known if unicodedata.normalize("NFD", c) != c]
    seconds = sorted({c for a in apart for c in unicodedata.normalize("NFD", a)})
    made = ["", None, "abc 12", "क़", "क़", "ো", "ொ", "ೀ", "ೋ", "ෝ", "़", "़क", "්ා", "क़्", "a\nक़\nb", "हिन्दी", "x" * 50 + "ऩ" + "y" * 50]
    for pool in (known, marks + apart + seconds, marks + apart + seconds + known[:60]):
        made += ["".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(made)), "n int, t string").repartition(4)
    found = {r.n: r.c for r in rows.select("n", unicode.canonical(F.col("t")).alias("c")).collect()}
    wrong = [(made[n].encode("unicode_escape"), found[n].encode("unicode_escape")) for n in range(len(made)) if made[n] is not None and found[n] != unicodedata.normalize("NFC", made[n])]
    assert not wrong, wrong[:5]
    assert found[1] is None
    plan = rows.select(unicode.canonical(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digits_of_composed_text(spark):
    rows = spark.createDataFrame([("१२ ொ​ क़",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.normalise_digits("t")).collect()] == ["12 ொ क़".replace("क़", "क़"), None]
