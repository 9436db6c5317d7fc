"""Bounds, classes, splits and percentiles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Z_95, Z_99 = 1.645, 2.326  # one-sided normal quantiles
TARGET_LB = 0.998


def wilson_lower_bound(k: Column, n: Column, z: float = Z_95) -> Column:
    """One-sided Wilson lower bound on k/n; 0 for n = 0."""
    n1 = F.when(n > 0, n.cast("double"))
    p = k / n1
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n1 + F.lit(z * z) / (F.lit(4.0) * n1 * n1))
    return F.coalesce((p + F.lit(z * z) / (F.lit(2.0) * n1) - margin) / (F.lit(1.0) + F.lit(z * z) / n1), F.lit(0.0))


def min_n_for_bound(spark: SparkSession, target: float = TARGET_LB, z: float = Z_95, most: int = 1 << 20) -> DataFrame:
    """The fewest trials without an error whose lower bound reaches ``target``."""
    n = spark.range(1, most + 1).withColumnRenamed("id", "n")
    return n.where(wilson_lower_bound(F.col("n"), F.col("n"), z) >= target).agg(F.min("n").alias("min_n"))


def cardinality_class(n_a: Column, n_b: Column) -> Column:
    """The shape of a group with n_a ledger and n_b statement records."""
    return (
        F.when(n_b == 0, "A-only")
        .when(n_a == 0, "unmatched")
        .when((n_a == 1) & (n_b == 1), "1:1")
        .when(n_a == 1, "1:N")
        .when(n_b == 1, "N:1")
        .otherwise("N:M")
    )


def assign_split(match_id: Column, dev_frac: float = 0.7) -> Column:
    """'dev' or 'val' by the SHA-1 of the id modulo 10000, folded four hex digits at a time."""
    h = F.sha1(match_id.cast("binary"))
    part = lambda i: F.conv(F.substring(h, i, 4), 16, 10).cast("bigint")
    # written out: a lambda would not be compiled
    rest = F.lit(0).cast("bigint")
    for i in range(1, 38, 4):
        rest = (rest * 65536 + part(i)) % 10000
    return F.when(rest < F.lit(dev_frac * 10_000), "dev").otherwise("val")


def to_minor(amount: Column) -> Column:
    """Minor units of a decimal text, half to even; an empty or null text is 0."""
    return F.coalesce(F.bround(F.nullif(amount, F.lit("")).cast("decimal(36,10)") * 100, 0).cast("bigint"), F.lit(0).cast("bigint"))


def reconstruct_allocation(currency: Column, value_date: Column, account: Column, attributes: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(c, F.lit("")) for c in (currency, value_date, account, attributes)])


def parse_target(raw: Column) -> Column:
    """Sorted distinct allocations of '', 'x' or '[x,y]'."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    parts = F.split(F.regexp_replace(t, r"^\[(.*)\]$", "$1"), ",")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def stratum(target: Column) -> Column:
    return F.when(F.size(target) == 0, "true-unmatched").when(F.size(target) == 1, "single-A").otherwise("multi-A")


def classify(predicted: Column, target: Column) -> Column:
    """Outcome of a predicted set; an empty prediction is NO_PREDICTION even for an empty target."""
    extra, lost = F.size(F.array_except(predicted, target)), F.size(F.array_except(target, predicted))
    return (
        F.when(F.size(predicted) == 0, "NO_PREDICTION")
        .when((extra == 0) & (lost == 0), "EXACT")
        .when(extra == 0, "STRICT_SUBSET")
        .when(lost == 0, "STRICT_SUPERSET")
        .when(F.size(F.array_intersect(predicted, target)) > 0, "OVERLAP")
        .otherwise("DISJOINT")
    )


def floor_percentiles(values: DataFrame, column: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """The values at index min(n-1, floor(share * n)) of the ascending order, one row for each ``by``.

    Equal values are counted first, so what is ranked is the distinct values, not the rows: of
    group sizes over n rows there are at most sqrt(2n).
    """
    from pyspark.sql import Window

    counts = values.groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    of = Window.partitionBy(*by)
    ranked = counts.select(*by, "v", F.sum("c").over(of.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(of).alias("n"))
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("upto") > at(q), F.col("v"))).alias(name) for name, q in shares.items()])
