"""Profiles: fields, blocking keys, cardinalities, directions, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.stats import floor_percentiles, reconstruct_allocation
from tallyweave.functions.text import normalised
from tallyweave.operators.cells import is_a, is_b

FIELDS = ("minor", "value_date", "reference", "attributes", "currency", "account", "direction")


def block_keys() -> dict[str, list[Column]]:
    return {
        "amount": [F.col("minor")],
        "amount_date": [F.col("minor"), F.col("value_date")],
        "amount_date_reference": [F.col("minor"), F.col("value_date"), F.col("reference")],
        "attributes_prefix": [F.substring(normalised(F.col("attributes")), 1, 8)],
    }


def field_profile(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """side, field, non_null_rate, distinct, modal_share; '', 0 and null count as absent.

    All fields are unpivoted into one grouping, so one shuffle of partial counts serves them all.
    """
    long = records.select("side", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), (F.col(f).isNotNull() & ~F.col(f).cast("string").isin("", "0")).alias("there")) for f in fields])).alias("x")).select("side", "x.*")
    per = long.groupBy("side", "field", "value").agg(F.count("*").alias("c"), F.count_if("there").alias("t"))
    total = per.groupBy("side", "field").agg(F.sum("c").alias("n"), F.sum("t").alias("t"), F.count("*").alias("distinct_values"), F.max("c").alias("m"))
    return total.select("side", "field", (F.col("t") / F.col("n")).alias("non_null_rate"), "distinct_values", (F.col("m") / F.col("n")).alias("modal_share"))


def one_to_one(records: DataFrame, group: str = "match_id") -> DataFrame:
    """True pairs: groups with one record on either side, as structs a and b."""
    columns = [c for c in records.columns if c != group]
    g = records.groupBy(group).agg(F.count_if(is_a()).alias("n_a"), F.count_if(is_b()).alias("n_b"), F.max(F.when(is_a(), F.struct(*columns))).alias("a"), F.max(F.when(is_b(), F.struct(*columns))).alias("b"))
    return g.where("n_a = 1 and n_b = 1").select(group, "a", "b")


def blocking(records: DataFrame, keys: dict[str, list[Column]] | None = None, group: str = "match_id") -> DataFrame:
    """key, recall, p50, p95, p99, largest: does the true A share B's key, and how many A records do?

    Block sizes are grouped counts, so no block is expanded into pairs. All keys are unpivoted into
    one grouping, so one pass and one join serve them all. A key with a null part has no block.
    """
    keys = keys or block_keys()
    made = F.array(*[F.struct(F.lit(n).alias("key"), F.array(*[c.cast("string") for c in cols]).alias("k")) for n, cols in keys.items()])
    keyed = records.select(group, "side", made.alias("_keys"))
    sizes = keyed.where(is_a()).select(F.explode("_keys").alias("x")).select("x.*").groupBy("key", "k").agg(F.count("*").alias("size"))
    both = F.zip_with("b._keys", "a._keys", lambda b, a: F.struct(b["key"].alias("key"), b["k"].alias("k"), b["k"].eqNullSafe(a["k"]).alias("hit")))
    pairs = one_to_one(keyed, group).select(F.explode(both).alias("x")).select("x.*")
    whole = F.when(~F.exists("k", lambda x: x.isNull()), F.col("k"))
    rows = pairs.withColumn("k", whole).join(sizes, ["key", "k"], "left").select("key", "hit", F.coalesce("size", F.lit(0)).alias("size"))
    recall = rows.groupBy("key").agg((F.count_if("hit") / F.count("*")).alias("recall"))
    spread = floor_percentiles(rows, "size", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "largest": 1.0}, by=("key",))
    names = records.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in keys])).alias("key"))
    return names.join(recall, "key", "left").join(spread, "key", "left").select("key", "recall", "p50", "p95", "p99", "largest")


def cardinality_histogram(records: DataFrame, group: str = "match_id", top: int = 10) -> DataFrame:
    """The most frequent (n_a, n_b) of groups; ties by smaller n_a, then n_b."""
    g = records.groupBy(group).agg(F.count_if(is_a()).alias("n_a"), F.count_if(is_b()).alias("n_b"))
    return g.groupBy("n_a", "n_b").agg(F.count("*").alias("groups")).orderBy(F.desc("groups"), "n_a", "n_b").limit(top)


def direction_crosstab(records: DataFrame, group: str = "match_id") -> DataFrame:
    """Directions of true pairs, with how often amounts, dates and both are equal."""
    amount, date = F.col("a.minor") == F.col("b.minor"), F.col("a.value_date") == F.col("b.value_date")
    return one_to_one(records, group).groupBy(F.col("b.direction").alias("b_direction"), F.col("a.direction").alias("a_direction")).agg(F.count("*").alias("pairs"), F.count_if(amount).alias("amount_equal"), F.count_if(date).alias("date_equal"), F.count_if(amount & date).alias("both_equal"))


def invariants(records: DataFrame, group: str = "match_id") -> DataFrame:
    """One row: currencies, accounts, rebuilt (A allocations that follow from fields), linked, targets.

    linked counts B records with a raw target among the rebuilt allocations of their group.
    """
    rebuilt = reconstruct_allocation(F.col("currency"), F.col("value_date"), F.col("account"), F.col("attributes"))
    scopes = records.agg(F.count_distinct("currency").alias("currencies"), F.count_distinct("account").alias("accounts"), F.count_if(is_a() & (rebuilt == F.col("allocation"))).alias("rebuilt"), F.count_if(is_a()).alias("n_a"))
    wanted = records.where(is_b() & (F.col("target") != "")).select(group, F.col("target").alias("t"))
    have = records.where(is_a()).select(group, rebuilt.alias("t")).distinct().withColumn("ok", F.lit(1))
    links = wanted.join(have, [group, "t"], "left").agg(F.count("ok").alias("linked"), F.count("*").alias("targets"))
    return scopes.join(links, F.lit(True))


def class_shares(counts: DataFrame) -> DataFrame:
    """class, records, share of candidate classes."""
    per = counts.groupBy("class").agg(F.count("*").alias("records"))
    return per.join(F.broadcast(counts.agg(F.count("*").alias("n"))), F.lit(True)).select("class", "records", (F.col("records") / F.col("n")).alias("share"))
