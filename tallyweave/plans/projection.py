"""A deterministic reconciliation problem made from ``orders`` and ``customer``.

Every order becomes a ledger entry in one of six scenarios: clean, batched, lagged, split, mistyped
or missing. Only integer arithmetic and plain string functions are used, so that SQL engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.config import AMOUNT


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.selectExpr(
        "o_orderkey AS k",
        "cast(round(o_totalprice * 100) AS bigint) * CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE -1 END AS cents",
        "concat(c_nationkey, '-', c_mktsegment) AS scope",
        "concat(c_mktsegment, ' ', c_name) AS name",
        "to_date(o_orderdate) AS date",
        "((o_orderkey div 100) * 37 + 19 * o_orderkey + 13) % 100 AS s",
    ).selectExpr("*", "CASE WHEN s < 64 THEN 'clean' WHEN s < 70 THEN 'batch' WHEN s < 80 THEN 'lag' WHEN s < 88 THEN 'split' WHEN s < 92 THEN 'typo' ELSE 'missing' END AS scenario")


def _amounts(rows: DataFrame) -> DataFrame:
    size = F.abs("cents")
    text = F.concat(F.when(F.col("cents") < 0, "-").otherwise(""), (size / 100).cast("decimal(38,2)").cast("string"))
    return rows.withColumn("amount", (F.col("cents").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(AMOUNT)).withColumn("amount_text", text)


def _id(letter: str, suffix: str = "") -> str:
    return f"concat('{letter}', lpad(cast(k as string), 9, '0'), '{suffix}')"


_X, _Y = "(10037 + (31 * k) % 900000) * sign", "(20011 + (17 * k) % 700000) * sign"
_TWO, _THREE = "scenario = 'split' AND k % 5 <> 0", "scenario = 'split' AND k % 5 = 0"


def _exploded(rows: DataFrame, cases: list[tuple[str, ...]], names: tuple[str, ...]) -> DataFrame:
    """One row for each case whose first expression, a condition, holds."""
    made = ", ".join(f"CASE WHEN {when} THEN named_struct({', '.join(f'{n!r}, {v}' for n, v in zip(names, values, strict=True))}) END" for when, *values in cases)
    return rows.selectExpr("scope", f"explode(filter(array({made}), x -> x IS NOT NULL)) AS x").select("scope", "x.*")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).selectExpr("*", "CASE WHEN cents < 0 THEN -1L ELSE 1L END AS sign", "abs(cents) AS size")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, date, description, amount, reference, amount_text, ord, scope, cents."""
    named = "concat(name, ' invoice ', 100 + {n} % 900)"
    cases = [
        ("true", _id("E"), "date", named.format(n="k"), "CASE WHEN k % 10 = 0 THEN concat('INV-', k) END", "k * 10", "cents"),
        ("scenario = 'batch'", _id("X"), "date_add(date, cast(k % 2 as int))", named.format(n="(7 * k)"), "cast(null as string)", "k * 10 + 1", _X),
        ("scenario = 'batch' AND k % 5 = 0", _id("Y"), "date", named.format(n="(11 * k)"), "cast(null as string)", "k * 10 + 2", _Y),
    ]
    return _amounts(_exploded(_signed(spark, sf_dir), cases, ("entry_id", "date", "description", "reference", "ord", "cents")))


def _line_text() -> str:
    return "CASE WHEN k % 7 = 0 THEN upper(substring(concat('WIRE ', name), 1, 22)) WHEN k % 5 = 0 THEN name ELSE concat('CARD ', name) END"


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, date, description, amount, reference, amount_text, ord, scope, cents."""
    none, text = "cast(null as string)", _line_text()
    batch = "element_at(array('COMBINED TRANSFER', 'GROUPED SETTLEMENT RUN', 'PAYROLL FILE'), cast(k % 3 as int) + 1)"
    swapped = "CASE WHEN (size div 10) % 10 = size % 10 THEN size + 100 ELSE (size div 100) * 100 + (size % 10) * 10 + (size div 10) % 10 END * sign"
    cases = [
        ("scenario = 'clean'", _id("S", "a"), "date", text, "CASE WHEN k % 20 = 0 THEN concat('INV-', k) END", "k * 10", "cents"),
        ("scenario = 'batch'", _id("S", "a"), "date_add(date, cast(k % 2 as int))", batch, none, "k * 10", f"cents + {_X} + CASE WHEN k % 5 = 0 THEN {_Y} ELSE 0 END"),
        ("scenario = 'lag'", _id("S", "a"), "date_add(date, cast(1 + k % 3 as int))", text, none, "k * 10", "cents"),
        (_TWO, _id("S", "a"), "date", text, none, "k * 10", "(2 * size div 5) * sign"),
        (_TWO, _id("S", "b"), "date", text, none, "k * 10 + 1", "(size - 2 * size div 5) * sign"),
        (_THREE, _id("S", "a"), "date", text, none, "k * 10", "(size div 5) * sign"),
        (_THREE, _id("S", "b"), "date", text, none, "k * 10 + 1", "(2 * size div 5) * sign"),
        (_THREE, _id("S", "c"), "date", text, none, "k * 10 + 2", "(size - size div 5 - 2 * size div 5) * sign"),
        ("scenario = 'typo'", _id("S", "a"), "date", text, none, "k * 10", swapped),
        ("scenario = 'clean' AND k % 97 = 0", _id("D"), "date", text, none, "k * 10 + 3", "cents"),
        ("k % 50 = 1", _id("F"), "date", "'MONTHLY ACCOUNT FEE'", none, "k * 10 + 4", "-(5000 + k % 45000)"),
    ]
    return _amounts(_exploded(_signed(spark, sf_dir), cases, ("line_id", "date", "description", "reference", "ord", "cents")))


def true_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, scope, entry_ids, line_ids of the true matches."""
    e, x, y = _id("E"), _id("X"), _id("Y")
    a, b, c = _id("S", "a"), _id("S", "b"), _id("S", "c")
    entries = f"CASE WHEN scenario = 'batch' AND k % 5 = 0 THEN array({e}, {x}, {y}) WHEN scenario = 'batch' THEN array({e}, {x}) ELSE array({e}) END"
    lines = f"CASE WHEN {_TWO} THEN array({a}, {b}) WHEN {_THREE} THEN array({a}, {b}, {c}) ELSE array({a}) END"
    return base(spark, sf_dir).where("scenario IN ('clean', 'batch', 'lag', 'split')").selectExpr("k", "scope", f"{entries} AS entry_ids", f"{lines} AS line_ids")


def true_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, record_id, category, related_id."""
    none = "cast(null as string)"
    cases = [
        ("scenario = 'typo'", "'ledger'", _id("E"), "'amount_mismatch_suspect'", _id("S", "a")),
        ("scenario = 'typo'", "'statement'", _id("S", "a"), "'amount_mismatch_suspect'", _id("E")),
        ("scenario = 'missing'", "'ledger'", _id("E"), "'missing_in_statement'", none),
        ("k % 50 = 1", "'statement'", _id("F"), "'missing_in_ledger'", none),
        ("scenario = 'clean' AND k % 97 = 0", "'statement'", _id("D"), "'duplicate_suspect'", _id("S", "a")),
    ]
    return _exploded(base(spark, sf_dir), cases, ("side", "record_id", "category", "related_id")).drop("scope")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides as benchmark records, with true groups and targets."""

    def side(df: DataFrame, letter: str, id_column: str, negative: str, positive: str) -> DataFrame:
        return df.select(
            F.lit(letter).alias("side"),
            F.col(id_column).alias("rec_id"),
            F.abs("cents").alias("minor"),
            F.date_format("date", "yyyy-MM-dd").alias("value_date"),
            F.when(F.col("cents") < 0, negative).otherwise(positive).alias("direction"),
            F.coalesce("reference", F.lit("")).alias("reference"),
            F.col("description").alias("attributes"),
            F.lit("USD").alias("currency"),
            F.col("scope").alias("account"),
            "ord",
        )

    pairs = true_pairs(spark, sf_dir)
    of = lambda c: pairs.select(F.concat(F.lit("M"), F.col("k")).alias("match_id"), F.explode(c).alias("rec_id"))
    lone: Column = F.concat(F.lit("U"), F.col("rec_id"))
    a = side(ledger(spark, sf_dir), "A", "entry_id", "CR", "DR").join(of("entry_ids"), "rec_id", "left")
    a = a.withColumn("match_id", F.coalesce("match_id", lone)).withColumn("allocation", F.concat_ws("_", "currency", "value_date", "account", "attributes"))
    b = side(statement(spark, sf_dir), "B", "line_id", "DR", "CR").join(of("line_ids"), "rec_id", "left")
    goals = a.groupBy("match_id").agg(F.array_sort(F.collect_set("allocation")).alias("t"))
    b = b.withColumn("match_id", F.coalesce("match_id", lone)).join(goals, "match_id", "left")
    target = F.when(F.col("t").isNull(), "").when(F.size("t") == 1, F.get("t", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("t", ","), F.lit("]")))
    both = a.withColumn("target", F.lit("")), b.withColumn("allocation", F.lit("")).withColumn("target", target).drop("t")
    return both[0].unionByName(both[1])
