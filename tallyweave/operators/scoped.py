"""Candidates by hard scope and opposite direction: unique and mutual-unique rules, text ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.stats import TARGET_LB, wilson_lower_bound
from tallyweave.functions.text import feature_registry
from tallyweave.operators.cells import SCOPE, is_a, is_b

STRATA = ("1:1", "1:N", "N:1", "N:M", "unmatched")


def _sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = records.where(is_a()).select(*SCOPE, F.col("rec_id").alias("a_id"), F.col("direction").alias("a_direction"), "allocation", F.col("attributes").alias("a_text"))
    b = records.where(is_b()).select(*SCOPE, F.col("rec_id").alias("b_id"), F.col("direction").alias("b_direction"), "target", F.col("attributes").alias("b_text"))
    return a, b


def eligible(records: DataFrame) -> DataFrame:
    """Pairs of a B and an A record in one scope with opposite directions."""
    a, b = _sides(records)
    return b.join(a, SCOPE).where("a_direction <> b_direction")


def candidate_counts(records: DataFrame) -> DataFrame:
    """b_id, n (eligible A records), sole_a, removed (A records in scope with B's direction), class.

    Counts come from one grouping of the scope by direction, not from the pairs.
    """
    per = records.groupBy(*SCOPE, "direction").agg(F.count_if(is_a()).alias("n_a"), F.count_if(is_b()).alias("n_b"), F.min(F.when(is_a(), F.struct("rec_id", "allocation"))).alias("one_a"))
    whole = per.groupBy(*SCOPE).agg(F.collect_list(F.struct("direction", "n_a", "n_b", "one_a")).alias("per"))
    b = _sides(records)[1].join(whole, SCOPE)
    other = F.filter("per", lambda x: x.getField("direction") != F.col("b_direction"))
    own = F.filter("per", lambda x: x.getField("direction") == F.col("b_direction"))
    count = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x.getField(f))
    b = b.withColumn("n", count(other, "n_a")).withColumn("removed", count(own, "n_a"))
    sole = F.get(F.filter(other, lambda x: x.getField("n_a") > 0), F.lit(0))
    b = b.withColumn("sole", F.when(F.col("n") == 1, sole))
    # the sole A's own candidates: B records of the scope whose direction differs from it
    reciprocal = count(F.filter("per", lambda x: x.getField("direction") != F.col("sole.direction")), "n_b")
    kind = F.when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("impossible")
    return b.select("b_id", "target", "n", "removed", kind.alias("class"), F.col("sole.one_a.rec_id").alias("sole_a"), F.col("sole.one_a.allocation").alias("allocation"), F.coalesce((F.col("n") == 1) & (reciprocal == 1), F.lit(False)).alias("mutual"))


def rule_tallies(records: DataFrame, cardinality: DataFrame) -> DataFrame:
    """rule, stratum, predicted, correct, matchable, total, precision, wilson_lb, verdict.

    ``cardinality`` (b_id, cardinality) gives the true class; missing ones are unmatched. A
    prediction is correct if the allocation is the raw target.
    """
    c = candidate_counts(records).join(cardinality, "b_id", "left").withColumn("cardinality", F.coalesce("cardinality", F.lit("unmatched")))
    has = F.coalesce(F.col("target"), F.lit("")) != ""
    right = has & (F.col("allocation") == F.col("target"))
    rows = c.select("cardinality", has.alias("has"), F.explode(F.array(F.struct(F.lit("unique").alias("rule"), (F.col("n") == 1).alias("said"), right.alias("right")), F.struct(F.lit("mutual").alias("rule"), F.col("mutual").alias("said"), right.alias("right")))).alias("r")).select("cardinality", "has", "r.*")
    sets = rows.groupingSets([["rule"], ["rule", "cardinality"]], "rule", "cardinality").agg(
        F.grouping_id().alias("_level"), F.count_if("said").alias("predicted"), F.count_if(F.col("said") & F.col("right")).alias("correct"), F.count_if("has").alias("matchable"), F.count("*").alias("total"), F.count_if(F.col("said") & ~F.col("has")).alias("false_on_unmatched")
    )
    out = sets.select("rule", F.when(F.col("_level") == 1, "ALL").otherwise(F.col("cardinality")).alias("stratum"), "predicted", "correct", "matchable", "total", "false_on_unmatched")
    lb = wilson_lower_bound(F.col("correct"), F.col("predicted"))
    verdict = F.when(F.col("predicted") == 0, "n/a").when(lb >= TARGET_LB, "PASS").otherwise("fail")
    return out.withColumns({"precision": F.when(F.col("predicted") > 0, F.col("correct") / F.when(F.col("predicted") > 0, F.col("predicted"))), "wilson_lb": lb, "verdict": verdict})


def ambiguous(records: DataFrame, cardinality: DataFrame | None = None, stratum: str | None = None) -> DataFrame:
    """Candidate pairs of B records with text, several candidates, and their true A among them."""
    pairs = eligible(records).where("target <> ''")
    if stratum is not None:
        pairs = pairs.join(cardinality.where(F.col("cardinality") == stratum).select("b_id"), "b_id", "left_semi")
    cases = pairs.groupBy("b_id").agg(F.count("*").alias("n_candidates"), F.bool_or(F.col("allocation") == F.col("target")).alias("hit")).where("n_candidates > 1 and hit").select("b_id", "n_candidates")
    return pairs.join(cases, "b_id").where(F.trim("b_text") != "")


def with_features(pairs: DataFrame, features: dict | None = None) -> DataFrame:
    """Candidate pairs with every text feature: the evidence kept for each candidate."""
    chosen = features or feature_registry()
    return pairs.withColumns({name: f(F.col("b_text"), F.col("a_text")) for name, f in chosen.items()})


def argmax(scored: DataFrame, feature: str, order: Column | None = None) -> DataFrame:
    """b_id and the allocation with the highest feature; of equal ones the first in ``order`` (a_id)."""
    first = F.col("a_id") if order is None else order
    w = Window.partitionBy("b_id").orderBy(F.desc(feature), first)
    # at most one row a B record is left, and the limit applies before the shuffle
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("b_id", "a_id", "allocation", (F.col("allocation") == F.col("target")).alias("correct"))


def disambiguation(scored: DataFrame, features: list[str]) -> DataFrame:
    """feature, hits, cases, accuracy, wilson_lb."""
    parts = [argmax(scored, f).agg(F.count_if("correct").alias("hits"), F.count("*").alias("cases")).withColumn("feature", F.lit(f)) for f in features]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("feature", "hits", "cases", F.when(F.col("cases") > 0, F.col("hits") / F.when(F.col("cases") > 0, F.col("cases"))).otherwise(0.0).alias("accuracy"), wilson_lower_bound(F.col("hits"), F.col("cases")).alias("wilson_lb"))
