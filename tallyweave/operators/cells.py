"""Amount cells: records of equal currency, account, value date and amount, and what they predict.

A frame of records has side ('A' ledger, 'B' statement), rec_id, minor (unsigned minor units),
value_date (text), direction ('DR' or 'CR'), reference, attributes, currency, account, allocation
(A only) and target (B only). Edges between equal records connect whole cells, so connected
components are plain groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.config import DISPOSITION, OUTCOMES
from tallyweave.functions.stats import cardinality_class, classify, parse_target, stratum, wilson_lower_bound

CELL = ["currency", "account", "value_date", "minor"]
DATE = CELL[:3]
#: The scope within which a record may match: the same columns as a cell's.
SCOPE = CELL


def is_a() -> Column:
    return F.col("side") == "A"


def is_b() -> Column:
    return F.col("side") == "B"


def component_id() -> Column:
    return F.concat_ws("|", *CELL)


def cells(records: DataFrame) -> DataFrame:
    """One row a cell: n_a, n_b, imbalance, balanced, and the predicted allocations of its B records.

    Predicted are the allocations of A records whose direction none of the B records has.
    """
    of = lambda d: F.array_sort(F.collect_set(F.when(is_a() & (F.col("direction") == d), F.col("allocation"))))
    grouped = records.groupBy(*CELL).agg(
        F.count_if(is_a()).alias("n_a"),
        F.count_if(is_b()).alias("n_b"),
        F.map_from_entries(F.array(*[F.struct(F.lit(d), of(d)) for d in ("DR", "CR")])).alias("_by_direction"),
        F.array_sort(F.collect_set(F.when(is_a() & ~F.col("direction").isin("DR", "CR"), F.struct("direction", "allocation")))).alias("_odd"),
        F.collect_set(F.when(is_b(), F.col("direction"))).alias("_b_directions"),
    )
    usual = F.flatten(F.transform(F.filter(F.map_keys("_by_direction"), lambda d: ~F.array_contains("_b_directions", d)), lambda d: F.col("_by_direction")[d]))
    odd = F.transform(F.filter("_odd", lambda x: ~F.array_contains("_b_directions", x.getField("direction"))), lambda x: x.getField("allocation"))
    predicted = F.array_sort(F.array_distinct(F.concat(usual, odd)))
    imbalance = (F.col("n_a") - F.col("n_b")) * F.col("minor")
    return grouped.select(*CELL, "n_a", "n_b", predicted.alias("predicted"), imbalance.alias("imbalance"), ((imbalance == 0) & (F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("balanced"))


def predictions(records: DataFrame) -> DataFrame:
    """b_id, predicted for every B record."""
    per_cell = cells(records).select(*CELL, "predicted")
    return records.where(is_b()).select(F.col("rec_id").alias("b_id"), *CELL).join(per_cell, CELL).select("b_id", "predicted")


def truth(records: DataFrame, group: str = "match_id") -> DataFrame:
    """b_id, target, cardinality, amount_class of every B record, from its true group."""
    groups = records.groupBy(group).agg(F.count_if(is_a()).alias("n_a"), F.count_if(is_b()).alias("n_b"), (F.min("minor") == F.max("minor")).alias("one"))
    b = records.where(is_b()).select(F.col("rec_id").alias("b_id"), parse_target(F.col("target")).alias("target"), group).join(groups, group)
    return b.select("b_id", "target", cardinality_class(F.col("n_a"), F.col("n_b")).alias("cardinality"), F.when(F.col("one"), "single-amount").otherwise("multi-amount").alias("amount_class"))


def outcomes(records: DataFrame, truths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Every B record with its prediction, truth and outcome; ``known`` are the records' cells, if at hand."""
    of_cells = cells(records) if known is None else known
    joined = records.where(is_b()).select(F.col("rec_id").alias("b_id"), *CELL).join(of_cells, CELL).join(truths, "b_id", "left")
    target = F.coalesce("target", F.array().cast("array<string>"))
    return joined.withColumn("target", target).withColumn("outcome", classify(F.col("predicted"), F.col("target")))


def outcome_counts(scored: DataFrame) -> DataFrame:
    """Counts of each outcome for ALL, each cardinality, and cardinality / amount class."""
    sets = scored.groupingSets([[], ["cardinality"], ["cardinality", "amount_class"]], "cardinality", "amount_class").agg(
        F.grouping_id().alias("_level"), *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES]
    )
    label = F.when(F.col("_level") == 3, "ALL").when(F.col("_level") == 1, F.col("cardinality")).otherwise(F.concat_ws(" / ", "cardinality", "amount_class"))
    return sets.select(label.alias("stratum"), *[o.lower() for o in OUTCOMES])


def rates(counts: DataFrame) -> DataFrame:
    """total, predicted, exact, recall, precision and Wilson lower bound of each stratum."""
    total = sum((F.col(o.lower()) for o in OUTCOMES[1:]), F.col(OUTCOMES[0].lower()))
    rows = counts.select("stratum", total.alias("total"), (total - F.col("no_prediction")).alias("predicted"), "exact")
    return rows.withColumns(
        {
            "recall": F.when(F.col("total") > 0, F.col("exact") / F.when(F.col("total") > 0, F.col("total"))).otherwise(0.0),
            "precision": F.when(F.col("predicted") > 0, F.col("exact") / F.when(F.col("predicted") > 0, F.col("predicted"))).otherwise(0.0),
            "wilson_lb": wilson_lower_bound(F.col("exact"), F.col("predicted")),
        }
    )


def collision_reason() -> Column:
    """Why a cell's B records are not all exact, from the counts of their outcomes."""
    total = sum((F.col(f"outcome_{o.lower()}") for o in OUTCOMES[1:]), F.col("outcome_exact"))
    named = {"strict_subset": "FRAGMENTED_MULTI_AMOUNT_GROUP", "strict_superset": "MERGED_FOREIGN_RECORDS", "overlap": "PARTIAL_CELL_COLLISION", "disjoint": "WRONG_CELL"}
    reasons = F.concat_ws("+", *[F.when(F.col(f"outcome_{k}") > 0, v) for k, v in named.items()])
    return F.when(F.col("outcome_exact") == total, "NONE_ALL_EXACT").when(reasons == "", "MIXED").otherwise(reasons)


def evidence(records: DataFrame, scored: DataFrame) -> DataFrame:
    """One row for each cell that predicts something for a B record: shape, ids, outcomes, reason."""
    ids = records.groupBy(*CELL).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(is_a(), F.col("rec_id")))), " ").alias("a_ids"),
        F.array_join(F.array_sort(F.collect_list(F.when(is_b(), F.col("rec_id")))), " ").alias("b_ids"),
    )
    per_cell = scored.where(F.size("predicted") > 0).groupBy(*CELL).agg(
        F.first("n_a").alias("n_a"),
        F.first("n_b").alias("n_b"),
        F.first(F.size("predicted")).alias("n_predicted_allocations"),
        F.array_join(F.array_sort(F.collect_set("cardinality")), " ").alias("true_cardinalities"),
        F.array_join(F.array_sort(F.collect_set("amount_class")), " ").alias("true_amount_classes"),
        F.count("*").alias("n_b_total"),
        *[F.count_if(F.col("outcome") == o).alias(f"outcome_{o.lower()}") for o in OUTCOMES],
    )
    members = F.concat(F.lit("{"), F.col("minor"), F.lit("}x"), F.col("n_a") + F.col("n_b"))
    return per_cell.join(ids, CELL).select(
        component_id().alias("component_id"),
        *CELL,
        "n_a",
        "n_b",
        F.concat_ws(":", "n_a", "n_b").alias("shape"),
        members.alias("amount_multiset"),
        F.lit(1).alias("distinct_amounts"),
        "n_predicted_allocations",
        "a_ids",
        "b_ids",
        F.lit(DISPOSITION).alias("disposition"),
        "true_cardinalities",
        "true_amount_classes",
        collision_reason().alias("collision_reason"),
        F.col("outcome_exact").alias("n_b_exact"),
        "n_b_total",
        *[f"outcome_{o.lower()}" for o in OUTCOMES],
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Cells or their evidence by date and amount, then by currency and account: the order of output."""
    return rows.orderBy("value_date", "minor", "currency", "account")


def exact_set_score(predicted: DataFrame, truths: DataFrame) -> DataFrame:
    """n, exact, emitted, emitted_exact for ALL and each size of the true set.

    ``predicted`` (b_id, predicted) may lack records; two empty sets are exact here.
    """
    rows = truths.join(predicted, "b_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    exact = F.array_sort(F.array_distinct("predicted")) == F.array_sort(F.array_distinct("target"))
    rows = rows.select(stratum(F.col("target")).alias("stratum"), exact.alias("hit"), (F.size("predicted") > 0).alias("out"))
    sets = rows.groupingSets([[], ["stratum"]], "stratum").agg(F.grouping_id().alias("_level"), F.count("*").alias("n"), F.count_if("hit").alias("exact"), F.count_if("out").alias("emitted"), F.count_if(F.col("out") & F.col("hit")).alias("emitted_exact"))
    out = sets.select(F.when(F.col("_level") == 1, "ALL").otherwise(F.col("stratum")).alias("stratum"), "n", "exact", "emitted", "emitted_exact").where("n > 0")
    return out.withColumns({"match_rate": F.col("exact") / F.col("n"), "precision": F.when(F.col("emitted") > 0, F.col("emitted_exact") / F.when(F.col("emitted") > 0, F.col("emitted"))).otherwise(0.0), "wilson_lb": wilson_lower_bound(F.col("emitted_exact"), F.col("emitted"))})
