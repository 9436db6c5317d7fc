"""Schemas and settings of the reconciliation engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

AMOUNT = T.DecimalType(38, 10)


def record_schema(id_column: str) -> T.StructType:
    """Ledger entries (``entry_id``) and statement lines (``line_id``); amounts are signed, + is money in.

    ``amount_text`` keeps the amount as written, ``ord`` the order of the input.
    """
    return T.StructType(
        [
            T.StructField(id_column, T.StringType(), False),
            T.StructField("date", T.DateType(), False),
            T.StructField("description", T.StringType(), False),
            T.StructField("amount", AMOUNT, False),
            T.StructField("reference", T.StringType()),
            T.StructField("amount_text", T.StringType(), False),
            T.StructField("ord", T.LongType(), False),
        ]
    )


LEDGER, STATEMENT = record_schema("entry_id"), record_schema("line_id")
MATCH = T.StructType(
    [
        T.StructField("entry_ids", T.ArrayType(T.StringType())),
        T.StructField("line_ids", T.ArrayType(T.StringType())),
        T.StructField("tier", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
BREAK_COLUMNS = ("side", "record_id", "category", "suggestion", "related_id")

# The four break categories, the six outcomes and the one disposition.
CATEGORIES = ("missing_in_ledger", "missing_in_statement", "amount_mismatch_suspect", "duplicate_suspect")
OUTCOMES = ("EXACT", "STRICT_SUBSET", "STRICT_SUPERSET", "OVERLAP", "DISJOINT", "NO_PREDICTION")
DISPOSITION = "SUGGESTED_FOR_REVIEW"


@dataclass(frozen=True)
class MatchConfig:
    """The matcher's four knobs, the window's cap, and the columns that confine matches.

    Records match only within equal ``scope`` columns, none by default. ``char_ratio=False`` drops
    the character ratio from the similarity, which then needs no Python. ``window_cap=None``
    searches whole windows for splits and batches.
    """

    date_window_days: int = 3
    desc_threshold: float = 0.55
    max_split: int = 3
    near_miss_pct: str = "0.01"
    window_cap: int | None = 12
    scope: tuple[str, ...] = ()
    char_ratio: bool = True
