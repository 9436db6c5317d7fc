import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import stats, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "ratio"), [("tide", "diet", 0.25), ("diet", "tide", 0.5), ("", "", 1.0), ("abc", "", 0.0)])
def test_char_ratio_is_not_symmetric(spark, a, b, ratio):
    assert value(spark, text.char_ratio(F.lit(a), F.lit(b))) == ratio


def test_desc_sim(spark):
    rows = [("Ovi Tea delivery 81", "CARD OVI TEA", 2 / 3), ("a b", "b a", 1.0), ("", "x", 0.0), ("STRASSE", "straße", 1.0), (None, "x", None)]
    df = spark.createDataFrame(rows, "a string, b string, want double").withColumn("got", text.desc_sim(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.got == (None if r.want is None else pytest.approx(r.want))


def test_qgrams_and_jaccard(spark):
    g = lambda s, q=3: sorted(value(spark, text.qgrams(F.lit(s), q)))
    assert g("") == [] and g(" ab ") == ["ab"] and g("AbAb a") == sorted({"aba", "bab", "ab ", "b a"})
    assert value(spark, text.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0


def test_transposition(spark):
    t = lambda a, b: value(spark, text.is_transposition(F.lit(a), F.lit(b)))
    assert t("734.20", "374.20") and t("1.50", "15.0") and not t("123", "231") and not t("12", "123")


def test_splits_equal_hashlib(spark):
    ids = [f"M{i}" for i in range(300)]
    got = {r.i: r.s for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", stats.assign_split(F.col("i")).alias("s")).collect()}
    assert got == {i: "dev" if int(hashlib.sha1(i.encode()).hexdigest(), 16) % 10_000 < 7000 else "val" for i in ids}


def test_wilson_and_min_n(spark):
    assert value(spark, stats.wilson_lower_bound(F.lit(0), F.lit(0))) == 0.0
    p, n, z = 0.9, 100, 1.645
    want = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    assert value(spark, stats.wilson_lower_bound(F.lit(90), F.lit(100))) == pytest.approx(want, abs=1e-12)
    assert stats.min_n_for_bound(spark, most=5000).first().min_n == 1351


def test_targets_and_outcomes(spark):
    assert value(spark, stats.parse_target(F.lit(" [b,a,,b] "))) == ["a", "b"]
    assert value(spark, stats.parse_target(F.lit(None).cast("string"))) == []
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    c = lambda p, t: value(spark, stats.classify(arr(*p), arr(*t)))
    assert [c("", ""), c("a", "a"), c("a", "ab"), c("ab", "a"), c("ab", "bc"), c("a", "b")] == ["NO_PREDICTION", "EXACT", "STRICT_SUBSET", "STRICT_SUPERSET", "OVERLAP", "DISJOINT"]


def test_minor_units_round_half_to_even(spark):
    got = [value(spark, stats.to_minor(F.lit(x))) for x in ("", "1.005", "1.015", "12", "0.1")]
    assert got == [0, 100, 102, 1200, 10]


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_floor_percentiles(spark, n):
    values = [(i * 7) % 5 for i in range(n)]
    got = stats.floor_percentiles(spark.createDataFrame([(v,) for v in values], "v int"), "v", {"a": 0.5, "b": 0.95, "c": 1.0}).first()
    s = sorted(values)
    assert tuple(got) == tuple(s[min(n - 1, int(q * n))] for q in (0.5, 0.95, 1.0))
