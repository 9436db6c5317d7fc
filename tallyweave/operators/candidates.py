"""Match candidates of the four tiers, as equi-joins on scope, amount, sign and day buckets."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.config import AMOUNT, MatchConfig
from tallyweave.functions.subsets import search
from tallyweave.functions.text import desc_sim, mean_sim

#: Days whose windows are searched together when they are not cut.
SPAN = 28
_MODULUS = 10**16
_COLUMNS = ("entry_ids", "line_ids", "tier", "confidence")


def day(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def near_dates(left: DataFrame, right: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Inner join on ``keys`` and dates at most ``days`` apart (``l_date``, ``r_date``).

    A range condition alone would plan a nested loop. Days are cut into buckets as wide as the
    window; a left row goes to its own and both neighbouring buckets, a right row to its own.
    """
    width = max(1, days)
    bucket = lambda c: F.floor(day(F.col(c)) / F.lit(width)).cast("int")
    spread = left.withColumn("_bucket", F.explode(F.array(*[bucket("l_date") + i for i in (-1, 0, 1)])))
    return spread.join(right.withColumn("_bucket", bucket("r_date")), [*keys, "_bucket"]).where(F.abs(F.datediff("l_date", "r_date")) <= days).drop("_bucket")


def exact_and_lagged(ledger: DataFrame, lines: DataFrame, config: MatchConfig) -> DataFrame:
    """Tiers 1 and 2 from one join: equal amounts, dates within the window."""
    scope = list(config.scope)
    left = lines.select(*scope, "amount", "line_id", F.col("date").alias("l_date"), F.col("description").alias("r_text"), F.col("reference").alias("r_ref"))
    right = ledger.select(*scope, "amount", "entry_id", F.col("date").alias("r_date"), F.col("description").alias("l_text"), F.col("reference").alias("l_ref"))
    # lines are spread over buckets, entries are not: a batch of a stream has far fewer lines than the ledger entries
    pairs = near_dates(left, right, [*scope, "amount"], config.date_window_days)
    gap = F.abs(F.datediff("l_date", "r_date"))
    sure = (F.col("gap") == 0) & F.col("l_ref").isNotNull() & (F.col("l_ref") == F.col("r_ref"))
    # the similarity is one column computed after the join; references that settle a pair spare it
    pairs = pairs.withColumn("gap", gap).withColumn("sure", F.coalesce(sure, F.lit(False)))
    pairs = pairs.withColumn("sim", desc_sim(F.when(~F.col("sure"), F.col("l_text")), F.col("r_text"), config.char_ratio))
    lagged = F.lit(0.6) + F.lit(0.3) * F.col("sim") * (F.lit(1.0) - F.col("gap") / F.lit(config.date_window_days + 1))
    tier = F.when(F.col("gap") == 0, 1).otherwise(2)
    confidence = F.when(F.col("sure"), 1.0).when(F.col("gap") == 0, 0.95).otherwise(lagged)
    kept = pairs.where(F.col("sure") | (F.col("sim") >= config.desc_threshold))
    return kept.select(F.array("entry_id").alias("entry_ids"), F.array("line_id").alias("line_ids"), tier.alias("tier"), confidence.alias("confidence"))


def _windows(parts: DataFrame, part_id: str, scope: list[str], config: MatchConfig) -> DataFrame:
    """For each scope, sign and day with parts near it: the first parts by id, as an array.

    Only the first ``cap`` of a day can be among the first of a window that holds the day, so each
    day is cut to the cap, beginning before the shuffle, and is one array when days are spread over windows.
    """
    cut = parts.select(*scope, (F.col("amount") < 0).alias("negative"), F.col("date").alias("at"), F.struct(F.col(part_id).alias("id"), "amount", F.col("description").alias("text")).alias("part"))
    cap, w, keys, on_day = config.window_cap, config.date_window_days, [*scope, "negative", "date"], [*scope, "negative", "at"]
    spread = lambda df: df.withColumn("date", F.explode(F.transform(F.sequence(F.lit(-w), F.lit(w)), lambda i: F.date_add(F.col("at"), i)))).drop("at")
    if cap is None:
        return spread(cut).groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    place = F.row_number().over(Window.partitionBy(*on_day).orderBy("part.id", "part.amount", "part.text"))
    days = cut.withColumn("_n", place).where(F.col("_n") <= cap).groupBy(*on_day).agg(F.collect_list("part").alias("parts"))
    # a window is put together from at most 2w + 1 arrays of at most cap parts
    return spread(days).groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("parts"))), 1, cap).alias("parts"))


def _combinations(size: int, k: int) -> Column:
    """All index tuples of ``k`` out of ``size`` places: a constant."""
    return F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(size), k)])


def _adds_up(k: int):
    """Whether the parts at the indexes of a tuple exist and add up to the total."""

    def test(c: Column) -> Column:
        amounts = [F.get("parts", F.element_at(c, j + 1)).getField("amount") for j in range(k)]
        return F.when(F.element_at(c, k) < F.size("parts"), reduce(lambda x, y: x + y, amounts) == F.col("total"))

    return test


def _residue(amount: Column) -> Column:
    """The amount's last sixteen digits, six before and ten after the point, as a long: equal for equal amounts."""
    return F.pmod((amount.cast(AMOUNT) % F.lit(1_000_000).cast("decimal(7,0)") * F.lit(10**10).cast("decimal(11,0)")).cast("long"), F.lit(_MODULUS))


def _residues(sizes: list[int], cap: int) -> Column:
    """The residues of the sums of all sets of a window's parts, from theirs in ``_r``; null for sets it does not have."""
    sums = lambda k: F.transform(_combinations(cap, k), lambda c: F.pmod(reduce(lambda x, y: x + y, [F.get("_r", F.element_at(c, j + 1)) for j in range(k)]), F.lit(_MODULUS)))
    return F.concat(*map(sums, sizes))


def _sums(whole: DataFrame, whole_id: str, parts: DataFrame, part_id: str, config: MatchConfig, windows: DataFrame | None = None) -> DataFrame:
    """Sets of 2..max_split parts near a whole, of its sign, that add up to it exactly; ``windows`` may hold the parts'."""
    scope = list(config.scope)
    keys = [*scope, "negative", "date"]
    target = whole.select(*scope, (F.col("amount") < 0).alias("negative"), "date", F.col(whole_id).alias("whole_id"), F.col("amount").alias("total"), F.col("description").alias("whole_text"))
    joined = lambda: target.join(_windows(parts, part_id, scope, config), keys)
    sizes = range(2, config.max_split + 1)
    if not sizes:
        return joined().select("whole_id", "whole_text", F.col("parts").alias("chosen")).where("false")
    if config.window_cap is not None:
        return _capped(target, _windows(parts, part_id, scope, config) if windows is None else windows, keys, config)
    hits = [_searched(target, parts, part_id, scope, config), *(_grown(joined(), k) for k in sizes if k > 3)]
    return reduce(DataFrame.unionByName, hits)


def _capped(target: DataFrame, windows: DataFrame, keys: list[str], config: MatchConfig) -> DataFrame:
    """Sets of the parts of cut windows. Sums are made once a window, as longs; a whole tries its sets only if one may fit."""
    cap = config.window_cap
    sizes = [k for k in range(2, config.max_split + 1) if k <= cap]
    if not sizes:
        return target.join(windows, keys).select("whole_id", "whole_text", F.col("parts").alias("chosen")).where("false")
    summed = windows.withColumn("_r", F.transform("parts", lambda p: _residue(p.getField("amount")))).withColumn("_sums", _residues(sizes, cap)).drop("_r")
    both = target.withColumn("_residue", _residue(F.col("total"))).join(summed, keys).where(F.array_contains("_sums", F.col("_residue")))
    # all sizes in one pass; only sets that add up leave the row
    fits = [F.filter(_combinations(cap, k), _adds_up(k)) for k in sizes]
    found = both.select("whole_id", "whole_text", "parts", F.explode(F.concat(*fits)).alias("c"))
    return found.select("whole_id", "whole_text", F.transform("c", lambda i: F.get("parts", i)).alias("chosen"))


def _searched(target: DataFrame, parts: DataFrame, part_id: str, scope: list[str], config: MatchConfig) -> DataFrame:
    """Pairs and triples of whole windows. A group holds the wholes of SPAN days and all parts near them, each once."""
    w, most = config.date_window_days, config.max_split
    kind, span = "decimal(38,10)", lambda c: F.floor(c / F.lit(SPAN)).cast("int")
    at = day(F.col("date"))
    left = target.select(*scope, "negative", span(at).alias("_span"), F.lit(True).alias("whole"), at.alias("day"), F.col("whole_id").cast("string").alias("id"), F.col("total").cast(kind).alias("amount"), F.col("whole_text").alias("text"))
    right = parts.select(*scope, (F.col("amount") < 0).alias("negative"), F.explode(F.sequence(span(at - w), span(at + w))).alias("_span"), F.lit(False).alias("whole"), at.alias("day"), F.col(part_id).cast("string").alias("id"), F.col("amount").cast(kind), F.col("description").alias("text"))
    rows = left.unionByName(right).dropna(subset=[*scope, "negative", "_span", "id"])
    return rows.groupBy(*scope, "negative", "_span").applyInArrow(lambda table: search(table, w, most), f"whole_id string, whole_text string, chosen array<struct<id: string, amount: {kind}, text: string>>")


def _grown(both: DataFrame, k: int) -> DataFrame:
    """Sets of ``k`` parts of whole windows: grown in id order, the last part by its exact missing amount."""
    grown = both.select("whole_id", "whole_text", "total", "parts", F.explode(F.transform("parts", lambda p: F.array(p))).alias("chosen"))
    after = lambda p: p.getField("id") > F.element_at(F.col("chosen"), -1).getField("id")
    for _ in range(k - 2):
        later = F.filter("parts", after)
        grown = grown.select("whole_id", "whole_text", "total", "parts", F.explode(F.transform(later, lambda p: F.concat(F.col("chosen"), F.array(p)))).alias("chosen"))
    spent = F.aggregate(F.transform("chosen", lambda p: p.getField("amount")), F.lit(0).cast("decimal(38,10)"), lambda x, y: (x + y).cast("decimal(38,10)"))
    last = F.filter("parts", lambda p: after(p) & (p.getField("amount") == F.col("total") - spent))
    return grown.select("whole_id", "whole_text", F.explode(F.transform(last, lambda p: F.concat(F.col("chosen"), F.array(p)))).alias("chosen"))


def _scored(hits: DataFrame, entries_are_parts: bool, tier: int, config: MatchConfig) -> DataFrame:
    ids = F.array_sort(F.transform("chosen", lambda p: p.getField("id")))
    texts = F.transform("chosen", lambda p: p.getField("text"))
    whole = F.transform("chosen", lambda _: F.col("whole_text"))
    # the similarity's arguments are always (entry, line)
    mean = mean_sim(texts, whole, config.char_ratio) if entries_are_parts else mean_sim(whole, texts, config.char_ratio)
    scored = hits.withColumn("mean", mean)
    confidence = F.lit(0.55) + F.lit(0.15) * F.col("mean") - F.lit(0.05) * (F.size("chosen") - 2)
    one = F.array("whole_id")
    return scored.select((ids if entries_are_parts else one).alias("entry_ids"), (one if entries_are_parts else ids).alias("line_ids"), F.lit(tier).alias("tier"), confidence.alias("confidence"))


def splits(ledger: DataFrame, lines: DataFrame, config: MatchConfig) -> DataFrame:
    """Tier 3: two or more lines that add up to one entry."""
    return _scored(_sums(ledger, "entry_id", lines, "line_id", config), False, 3, config)


def entry_windows(ledger: DataFrame, config: MatchConfig) -> DataFrame:
    """The cut windows of the entries, to be kept where lines come in batches."""
    return _windows(ledger, "entry_id", list(config.scope), config)


def batches(ledger: DataFrame, lines: DataFrame, config: MatchConfig, windows: DataFrame | None = None) -> DataFrame:
    """Tier 4: two or more entries that add up to one line; ``windows`` may hold ``entry_windows`` of the ledger."""
    return _scored(_sums(lines, "line_id", ledger, "entry_id", config, windows), True, 4, config)


def all_tiers(ledger: DataFrame, lines: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """entry_ids, line_ids, tier, confidence of every candidate."""
    parts = (exact_and_lagged, splits, batches)
    return reduce(DataFrame.unionByName, [f(ledger, lines, config).select(*_COLUMNS) for f in parts])
