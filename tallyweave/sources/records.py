"""Ledger and statement files: typed rows, and findings for rows that are not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.config import AMOUNT, LEDGER, STATEMENT

REQUIRED = ("date", "description", "amount")
#: Upload guard: files above this size are refused.
MOST_BYTES = 1_000_000


class MissingColumn(ValueError):
    """The header lacks a column; the message names it."""


class BadRow(ValueError):
    """A row could not be read; ``row`` counts records from 2, as row 1 is the header."""

    def __init__(self, row: int, message: str):
        super().__init__(f"row {row}: {message}")
        self.row = row


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    bad_rows: DataFrame  # row, message

    def strict(self) -> DataFrame:
        """The rows, or BadRow for the first bad one."""
        first = self.bad_rows.orderBy("row").first()
        if first:
            raise BadRow(first["row"], first["message"])
        return self.rows


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd or yyyyMMdd, else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")).when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))


def amount(text: Column) -> Column:
    """A decimal without loss: null if it is no number or has more than ten decimals."""
    t = F.trim(text)
    value = t.try_cast(AMOUNT)
    return F.when(t.rlike(r"^[+-]?(\d+(\.\d{0,10}0*)?|\.\d{1,10}0*)([eE][+-]?\d+)?$"), value)


def plain_amount(text: Column) -> Column:
    """The amount as written, without a plus sign, surplus leading zeros or a bare final point."""
    t = F.regexp_replace(F.trim(text), r"^\+", "")
    t = F.regexp_replace(t, r"^(-?)0+(?=\d)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"^(-?)\.", "${1}0."), r"\.$", "")


def _typed(raw: DataFrame, id_column: str, ordered: Column) -> Loaded:
    has_reference = "reference" in raw.columns
    base = raw.select(
        F.col(id_column),
        iso_date(F.col("date")).alias("date"),
        F.col("description"),
        amount(F.col("amount")).alias("amount"),
        (F.nullif(F.col("reference"), F.lit("")) if has_reference else F.lit(None).cast("string")).alias("reference"),
        plain_amount(F.col("amount")).alias("amount_text"),
        ordered.alias("ord"),
        F.col("date").alias("_date"),
        F.col("amount").alias("_amount"),
    )
    problem = (
        F.when(F.col(id_column).isNull(), F.lit(f"missing {id_column}"))
        .when(F.col("date").isNull(), F.concat(F.lit("not a date: "), F.coalesce("_date", F.lit(""))))
        .when(F.col("description").isNull(), F.lit("missing description"))
        .when(F.col("amount").isNull(), F.concat(F.lit("not an amount: "), F.coalesce("_amount", F.lit(""))))
    )
    base = base.withColumn("_problem", problem)
    columns = [id_column, "date", "description", "amount", "reference", "amount_text", "ord"]
    return Loaded(base.where("_problem is null").select(*columns), base.where("_problem is not null").select((F.col("ord") + 2).alias("row"), F.col("_problem").alias("message")))


def check_size(spark: SparkSession, path: str, most: int = MOST_BYTES) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    if size > most:
        raise ValueError(f"{path} has {size} bytes; at most {most} are accepted")


def load_csv(spark: SparkSession, path: str, id_column: str, most_bytes: int | None = None) -> Loaded:
    """A CSV with a header; short rows and values that do not parse become bad rows.

    ``ord`` is the place of the record in the file. It is the row number of a file read as one
    piece; of a file in several pieces it still rises in file order.
    """
    if most_bytes is not None:
        check_size(spark, path, most_bytes)
    options = {"header": True, "multiLine": True, "escape": '"', "maxCharsPerColumn": -1, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\0", "emptyValue": ""}
    raw = spark.read.options(**options).csv(path)
    missing = [c for c in (id_column, *REQUIRED) if c not in raw.columns]
    if missing:
        raise MissingColumn(f"missing column {missing[0]}")
    return _typed(raw, id_column, F.monotonically_increasing_id())


def load_ledger_csv(spark: SparkSession, path: str, **options) -> Loaded:
    return load_csv(spark, path, LEDGER[0].name, **options)


def load_statement_csv(spark: SparkSession, path: str, **options) -> Loaded:
    return load_csv(spark, path, STATEMENT[0].name, **options)


TRANSACTIONS = "array<struct<txn_date:string,description:string,debit:string,credit:string,running_balance:string>>"


def signed_amount(credit: Column, debit: Column) -> Column:
    """credit - debit; an empty or null side is 0."""
    zero = F.lit(0).cast(AMOUNT)
    side = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast(AMOUNT), zero)
    return (side(credit) - side(debit)).cast(AMOUNT)


def lines_from_documents(documents: DataFrame, transactions: str = "doc.transactions") -> DataFrame:
    """Statement lines of extracted bank statements: T0000, T0001, ... in the order of transactions."""
    rows = documents.select(F.posexplode(F.col(transactions)).alias("ord", "t"))
    value = signed_amount(F.col("t.credit"), F.col("t.debit"))
    cents = F.greatest(*[F.coalesce(F.length(F.regexp_extract(F.coalesce(F.col(f"t.{c}"), F.lit("")), r"\.(\d+)$", 1)), F.lit(0)) for c in ("credit", "debit")])
    text = F.when(cents == 0, F.regexp_replace(value.cast("string"), r"\.0*$", "")).otherwise(F.expr("substring(cast(v as string), 1, length(cast(v as string)) - 10 + c)"))
    return rows.withColumn("v", value).withColumn("c", cents).select(F.format_string("T%04d", "ord").alias("line_id"), iso_date(F.col("t.txn_date")).alias("date"), F.col("t.description").alias("description"), F.col("v").alias("amount"), F.lit(None).cast("string").alias("reference"), text.alias("amount_text"), F.col("ord").cast("long").alias("ord"))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    schema = f"source string, route string, doc struct<bank_name:string,account_number:string,currency:string,period_start:string,period_end:string,opening_balance:string,closing_balance:string,transactions:{TRANSACTIONS}>"
    return lines_from_documents(spark.read.schema(schema).json(path, multiLine=True))
