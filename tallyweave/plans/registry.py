"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.config import MatchConfig
from tallyweave.functions import stats, text
from tallyweave.operators import candidates, cells, frontier, identify, metrics, profiling, ranking, report, resolve, scoped
from tallyweave.plans import projection
from tallyweave.plans.cut import cut, packed
from tallyweave.sources import datagen, records
from tallyweave.streaming import incremental

#: Containment alone, so that SQL can check the result; scoped by nation and segment.
NATIVE = MatchConfig(scope=("scope",), char_ratio=False)
FULL = MatchConfig(scope=("scope",))
#: As NATIVE, with whole windows in place of the first twelve parts of each.
WHOLE = MatchConfig(scope=("scope",), char_ratio=False, window_cap=None)

#: Gated metrics to hold against: those of a generated held-out evaluation.
BASELINE = {"pair_f1": 0.978635262, "auto_match_rate": 0.958734772, "break_f1": 0.833677491}

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, id arrays joined, as the SQL side shows them."""
    show = {"double": lambda c: F.round(c, digits).alias(c), "array": lambda c: F.array_join(c, ",").alias(c)}
    return df.select(*[show.get(f.dataType.typeName(), F.col)(f.name) for f in df.schema])


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return projection.ledger(spark, sf_dir), projection.statement(spark, sf_dir)


def _matches(spark: SparkSession, sf_dir: str, config: MatchConfig = NATIVE) -> DataFrame:
    return report.match(*_sides(spark, sf_dir), config)


def _report(spark: SparkSession, sf_dir: str, config: MatchConfig = NATIVE) -> report.Report:
    return report.reconcile(*_sides(spark, sf_dir), config)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides as records, stored once: most queries read them several times."""
    return cut(projection.records(spark, sf_dir))


def recon_ledger(spark, sf_dir):
    return projection.ledger(spark, sf_dir).select("scope", "entry_id", "date", "description", "cents", "reference")


def recon_statement(spark, sf_dir):
    return projection.statement(spark, sf_dir).select("scope", "line_id", "date", "description", "cents", "reference")


def recon_truth(spark, sf_dir):
    return _rounded(projection.true_pairs(spark, sf_dir).drop("k"))


def tier12_exact_and_lagged(spark, sf_dir):
    return _rounded(candidates.exact_and_lagged(*_sides(spark, sf_dir), NATIVE))


def tier3_splits(spark, sf_dir):
    return _rounded(candidates.splits(*_sides(spark, sf_dir), NATIVE))


def tier4_batches(spark, sf_dir):
    return _rounded(candidates.batches(*_sides(spark, sf_dir), NATIVE))


def tier34_uncapped(spark, sf_dir):
    sides = _sides(spark, sf_dir)
    return _rounded(candidates.splits(*sides, WHOLE).unionByName(candidates.batches(*sides, WHOLE)))


def match_greedy(spark, sf_dir):
    return _rounded(_matches(spark, sf_dir))


def match_greedy_rounds(spark, sf_dir):
    """The same assignment by parallel rounds alone, however few candidates are left."""
    return _rounded(resolve.resolve(candidates.all_tiers(*_sides(spark, sf_dir), NATIVE), finish=0))


def match_desc_sim(spark, sf_dir):
    return _rounded(_matches(spark, sf_dir, FULL))


def breaks_all(spark, sf_dir):
    return _report(spark, sf_dir).breaks


def break_counts(spark, sf_dir):
    return _report(spark, sf_dir).breaks.groupBy("category", "side").agg(F.count("*").alias("n"))


def recon_summary(spark, sf_dir):
    return _rounded(_report(spark, sf_dir).summary)


def rendered_report(spark, sf_dir):
    return report.render_matches(_matches(spark, sf_dir))


def pair_prf(spark, sf_dir):
    return _rounded(metrics.pair_prf(_matches(spark, sf_dir), projection.true_pairs(spark, sf_dir)))


def break_prf(spark, sf_dir):
    return _rounded(metrics.break_prf(_report(spark, sf_dir).breaks, projection.true_breaks(spark, sf_dir)))


def auto_match_rate(spark, sf_dir):
    return _rounded(metrics.auto_match_rate(_matches(spark, sf_dir), projection.true_pairs(spark, sf_dir)))


def tier_accuracy(spark, sf_dir):
    return _rounded(metrics.tier_accuracy(_matches(spark, sf_dir), projection.true_pairs(spark, sf_dir)))


def regression_gate(spark, sf_dir):
    matches, truth = _matches(spark, sf_dir), projection.true_pairs(spark, sf_dir)
    p = metrics.pair_prf(matches, truth).select(F.col("f1").alias("pair_f1"))
    a = metrics.auto_match_rate(matches, truth).select(F.col("rate").alias("auto_match_rate"))
    b = metrics.break_prf(_report(spark, sf_dir).breaks, projection.true_breaks(spark, sf_dir)).where("category = 'ALL'").select(F.col("f1").alias("break_f1"))
    new = p.join(a, F.lit(True)).join(b, F.lit(True))
    best = spark.range(1).select(*[F.lit(v).alias(c) for c, v in BASELINE.items()])
    return _rounded(metrics.regressions(new, best))


def wilson_bounds(spark, sf_dir):
    per = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    return _rounded(per.select("n", "k", stats.wilson_lower_bound(F.col("k"), F.col("n")).alias("lb")))


def min_n_bound(spark, sf_dir):
    return stats.min_n_for_bound(spark)


def group_split(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", stats.assign_split(F.concat(F.lit("M"), F.col("o_orderkey"))).alias("split"))


def token_containment(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    a, b = part.toDF("a_key", "p_brand", "a_name"), part.toDF("b_key", "p_brand", "b_name")
    # neighbours by key within a brand: blocks of fifty keys, own and next
    block = lambda c: F.floor(F.col(c) / 50)
    pairs = a.withColumn("blk", F.explode(F.array(block("a_key"), block("a_key") + 1))).join(b.withColumn("blk", block("b_key")), ["p_brand", "blk"])
    pairs = pairs.where("a_key < b_key and b_key - a_key <= 50")
    return _rounded(pairs.select("a_key", "b_key", text.containment(F.col("a_name"), F.col("b_name")).alias("sim")))


def _names(spark, sf_dir):
    """Customers with the grams of their names, to be compared within nation and segment; a null name has none."""
    name = F.coalesce("c_name", F.lit(""))
    return _table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", text.qgrams(name, 2).alias("qgram2"), text.qgrams(name, 3).alias("qgram3"))


def qgram_jaccard(spark, sf_dir):
    return ranking.all_pairs(_names(spark, sf_dir), ["c_nationkey", "c_mktsegment"], "c_custkey", ["qgram2", "qgram3"])


def argmax_by_text(spark, sf_dir):
    return ranking.most_similar(_names(spark, sf_dir), ["c_nationkey", "c_mktsegment"], "c_custkey", "qgram3")


def char_ratio_names(spark, sf_dir):
    """Every customer's name against the next one's in the same nation, in both orders."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.concat("c_mktsegment", F.lit(" "), "c_name").alias("other"))
    both = c.join(nxt, "c_custkey").withColumn("own", F.concat("c_mktsegment", F.lit(" "), "c_name"))
    return _rounded(both.select("c_custkey", text.char_ratio(F.col("own"), F.col("other")).alias("ratio"), text.char_ratio(F.col("other"), F.col("own")).alias("reverse"), text.desc_sim(F.col("own"), F.col("other")).alias("sim")))


def scope_candidates(spark, sf_dir):
    return scoped.candidate_counts(_records(spark, sf_dir)).select("b_id", "n", "removed", "class", "sole_a", "mutual")


def scope_rules(spark, sf_dir):
    r = _records(spark, sf_dir)
    return _rounded(scoped.rule_tallies(r, cells.truth(r).select("b_id", "cardinality")))


def text_disambiguation(spark, sf_dir):
    """Ranking by text where blocks are coarse: amounts and dates are rounded away."""
    r = _records(spark, sf_dir).withColumn("minor", F.col("minor") * 0).withColumn("value_date", F.substring("value_date", 1, 7))
    pairs = scoped.ambiguous(r)
    return _rounded(scoped.disambiguation(scoped.with_features(pairs), ["qgram2_jaccard", "qgram3_jaccard", "char_ratio", "desc_sim"]))


def cells_all(spark, sf_dir):
    return _rounded(cells.cells(_records(spark, sf_dir)))


def _scored(spark, sf_dir):
    r = _records(spark, sf_dir)
    t = cells.truth(r)
    return r, t, cells.outcomes(r, t)


def cell_outcomes(spark, sf_dir):
    return cells.outcome_counts(_scored(spark, sf_dir)[2])


def cell_rates(spark, sf_dir):
    return _rounded(cells.rates(cells.outcome_counts(_scored(spark, sf_dir)[2])))


def cell_collisions(spark, sf_dir):
    r, _, scored = _scored(spark, sf_dir)
    return cells.evidence(r, scored).groupBy("collision_reason").agg(F.count("*").alias("components"), F.sum("n_b_total").alias("records"))


def cell_evidence(spark, sf_dir):
    r, _, scored = _scored(spark, sf_dir)
    return cells.in_order(cells.evidence(r, scored))


def exact_set_score(spark, sf_dir):
    r = _records(spark, sf_dir)
    return _rounded(cells.exact_set_score(cells.predictions(r), cells.truth(r).select("b_id", "target")))


def tiered_set_score(spark, sf_dir):
    """The tiered matcher's predictions, scored as exact sets of allocations."""
    r = _records(spark, sf_dir)
    a = r.where("side = 'A'").select(F.col("rec_id").alias("entry_id"), "allocation")
    lines = _matches(spark, sf_dir).select(F.explode("line_ids").alias("b_id"), "entry_ids").select("b_id", F.explode("entry_ids").alias("entry_id"))
    predicted = lines.join(a, "entry_id").groupBy("b_id").agg(F.array_sort(F.collect_set("allocation")).alias("predicted"))
    return _rounded(cells.exact_set_score(predicted, cells.truth(r).select("b_id", "target")))


def field_profile(spark, sf_dir):
    return _rounded(profiling.field_profile(_records(spark, sf_dir)))


def blocking_recall(spark, sf_dir):
    return _rounded(profiling.blocking(_records(spark, sf_dir)))


def cardinality_histogram(spark, sf_dir):
    return profiling.cardinality_histogram(_records(spark, sf_dir))


def direction_crosstab(spark, sf_dir):
    return profiling.direction_crosstab(_records(spark, sf_dir))


def invariants(spark, sf_dir):
    return profiling.invariants(_records(spark, sf_dir))


def witness_levels(spark, sf_dir):
    return identify.witnesses(_records(spark, sf_dir)).select(*cells.CELL, "witness", "witness_minor")


def identifiability(spark, sf_dir):
    r = _records(spark, sf_dir)
    return _rounded(identify.tier_stats(identify.identifiability(r, cells.truth(r))))


def amount_window_frequency(spark, sf_dir):
    return frontier.window_frequency(_records(spark, sf_dir))


def sibling_tokens(spark, sf_dir):
    return frontier.sibling_tokens(projection.records(spark, sf_dir))


def frontier_features(spark, sf_dir):
    r = packed(projection.records(spark, sf_dir))
    return _rounded(frontier.feature_rows(r, cells.truth(r)))


def _frontier(spark, sf_dir):
    r, t, scored = _scored(spark, sf_dir)
    rows = scored.where(F.size("predicted") > 0).select("b_id", (F.col("outcome") == "EXACT").cast("int").alias("label"), ((F.col("n_a") + F.col("n_b")) * 1000 + F.col("minor") % 997).alias("score"))
    return frontier.coverage_frontier(rows, r.where("side = 'B'").count())


def coverage_frontier(spark, sf_dir):
    return _rounded(_frontier(spark, sf_dir))


def frontier_best(spark, sf_dir):
    return _rounded(frontier.best_at_target(_frontier(spark, sf_dir), 0.9))


def frontier_at_coverage(spark, sf_dir):
    return _rounded(frontier.at_coverage(_frontier(spark, sf_dir)))


def frontier_first_error(spark, sf_dir):
    return _rounded(frontier.first_error(_frontier(spark, sf_dir)))


def frontier_buckets(spark, sf_dir):
    return _rounded(frontier.buckets(_frontier(spark, sf_dir)).select("bucket", "n", "exact", "lb"))


def learned_frontier(spark, sf_dir):
    """A ranker fitted on the dev groups, its frontier read on the others."""
    # both splits at once, each a part of its own; the split is costly, so it is stored
    r = packed(projection.records(spark, sf_dir).withColumn("split", stats.assign_split(F.col("match_id"))))
    rows = packed(frontier.feature_rows(r, within=("split",)))
    scored = frontier.fit_ranker(rows.where("split = 'dev'"))(rows.where("split = 'val'"))
    return _rounded(frontier.coverage_frontier(scored, r.where("split = 'val' and side = 'B'").count()))


def adapter_signed_amount(spark, sf_dir):
    """Events as extracted transactions: the amount on the credit or the debit side, k as the place."""
    e = _table(spark, sf_dir, "events").withColumn("v", F.round("value", 2).cast("decimal(18,2)").cast("string"))
    credit = F.col("event_type").isin("purchase", "view")
    signed = records.signed_amount(F.when(credit, F.col("v")), F.when(~credit, F.col("v")).otherwise(""))
    return e.select("event_id", (signed * 100).cast("long").alias("cents"), F.format_string("T%04d", F.get_json_object("props", "$.k").cast("long")).alias("line_id"))


def transpositions(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    a, b = F.col("c").cast("string"), (F.col("c") + F.col("o_orderkey") % 2).cast("string")
    other = F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), F.substring(b, 3, 20))
    return o.select("o_orderkey", text.is_transposition(a, other).alias("swapped"))


def target_lists(spark, sf_dir):
    c = F.col("c_custkey") % 3
    raw = F.when(c == 0, "").when(c == 1, F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise(F.concat(F.lit("["), "c_name", F.lit(","), "c_mktsegment", F.lit(",,"), "c_name", F.lit("]")))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array_join(stats.parse_target(raw), "|").alias("target"))


def held_out_metrics(spark, sf_dir):
    """Fifty generated data sets, matched and scored together."""
    return _rounded(metrics.macro_mean(datagen.evaluate(spark, list(range(100, 150)))))


def streamed_matches(spark, sf_dir):
    """The statement as a stream of batches against the ledger, whole windows searched: matches after the last batch."""
    return _rounded(incremental.replay(projection.ledger(spark, sf_dir), projection.statement(spark, sf_dir), WHOLE))


_QUERIES: tuple[Query, ...] = (
    recon_ledger, recon_statement, recon_truth, tier12_exact_and_lagged, tier3_splits, tier4_batches, tier34_uncapped,
    match_greedy, match_greedy_rounds, match_desc_sim, breaks_all, break_counts, recon_summary, rendered_report,
    pair_prf, break_prf, tier_accuracy, auto_match_rate, regression_gate, wilson_bounds, min_n_bound, group_split,
    token_containment, qgram_jaccard, argmax_by_text, char_ratio_names, scope_candidates, scope_rules, text_disambiguation,
    cells_all, cell_outcomes, cell_rates, cell_collisions, cell_evidence, exact_set_score, tiered_set_score,
    field_profile, blocking_recall, cardinality_histogram, direction_crosstab, invariants,
    witness_levels, identifiability, amount_window_frequency, sibling_tokens, frontier_features,
    coverage_frontier, frontier_best, frontier_at_coverage, frontier_first_error, frontier_buckets, learned_frontier,
    adapter_signed_amount, transpositions, target_lists, held_out_metrics, streamed_matches,
)
_NAMES = {"breaks_all": "breaks", "cells_all": "cells"}


def queries() -> dict[str, Query]:
    return {_NAMES.get(f.__name__, f.__name__): f for f in _QUERIES}


