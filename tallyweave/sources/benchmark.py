"""Two-sided benchmark files: records of both sides, truth, and submissions of other matchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.config import AMOUNT
from tallyweave.functions.stats import parse_target, to_minor

_FIELDS = {
    "rec_id": "id",
    "value_date": "valueDate",
    "direction": "debitOrCredit",
    "reference": "transactionReferences",
    "attributes": "transactionAttributes",
    "currency": "currencyCode",
    "account": "account",
}


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text of any length, with '' for absent values."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', maxCharsPerColumn=-1).csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def _side(rows: DataFrame, side: str, group: Column) -> DataFrame:
    get = lambda c: F.coalesce(F.col(f"{side}_{c}"), F.lit(""))
    return rows.where(get("id") != "").select(
        F.lit(side).alias("side"),
        group.alias("match_id"),
        *[get(c).alias(name) for name, c in _FIELDS.items()],
        to_minor(get("amount")).alias("minor"),
        (get("allocation") if side == "A" else F.lit("")).alias("allocation"),
        (F.coalesce("targetAllocation", F.lit("")) if side == "B" and "targetAllocation" in rows.columns else F.lit("")).alias("target"),
    )


def records(rows: DataFrame) -> DataFrame:
    """Records of both sides; a row with both ids gives two. Files without matchId have null groups."""
    group = F.col("matchId") if "matchId" in rows.columns else F.lit(None).cast("string")
    return _side(rows, "A", group).unionByName(_side(rows, "B", group))


def load_records(spark: SparkSession, path: str) -> DataFrame:
    return records(read_text_csv(spark, path))


def load_solution(spark: SparkSession, path: str) -> DataFrame:
    """b_id, target (sorted distinct allocations)."""
    return read_text_csv(spark, path).select(F.col("B_id").alias("b_id"), parse_target(F.col("targetAllocation")).alias("target"))


def submission(rows: DataFrame) -> DataFrame:
    """b_id, predicted: a JSON array or value, else a bracketed list, else the single allocation."""
    raw = F.trim(F.coalesce("targetAllocation", F.lit("")))
    single = F.trim(F.coalesce("A_allocation", F.lit(""))) if "A_allocation" in rows.columns else F.lit("")
    listed = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    text = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")
    is_json_list = raw.rlike(r'^\[\s*(("([^"\\]|\\.)*"|-?\d+(\.\d+)?|true|false|null)\s*(,\s*("([^"\\]|\\.)*"|-?\d+(\.\d+)?|true|false|null)\s*)*)?\]$')
    is_json_value = raw.rlike(r'^("([^"\\]|\\.)*"|-?\d+(\.\d+)?)$')
    sets = F.when(raw == "", F.when(single == "", F.array().cast("array<string>")).otherwise(F.array(single))).when(is_json_list, listed).when(is_json_value, text).otherwise(parse_target(raw))
    return rows.select(F.col("B_id").alias("b_id"), F.array_sort(F.array_distinct(sets)).alias("predicted"))


def load_submission(spark: SparkSession, path: str) -> DataFrame:
    return submission(read_text_csv(spark, path))


def as_ledger(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records as ledger entries and statement lines for the tiered matcher.

    Money goes out on a debit of the statement and a credit of the ledger, so that true partners,
    of opposite directions, have equal signed amounts.
    """
    cents = (F.col("minor").cast(AMOUNT) / 100).cast(AMOUNT)
    out = F.when(F.col("side") == "A", F.col("direction") == "CR").otherwise(F.col("direction") == "DR")
    value = F.when(out, -cents).otherwise(cents)
    rows = recs.select("side", "rec_id", F.to_date("value_date").alias("date"), F.col("attributes").alias("description"), value.alias("amount"), F.nullif(F.col("reference"), F.lit("")).alias("reference"), F.regexp_replace(value.cast("decimal(38,2)").cast("string"), "^$", "").alias("amount_text"), F.xxhash64("rec_id").alias("ord"))
    return rows.where("side = 'A'").drop("side").withColumnRenamed("rec_id", "entry_id"), rows.where("side = 'B'").drop("side").withColumnRenamed("rec_id", "line_id")
