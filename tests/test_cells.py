"""Cells, scopes, profiles, witnesses, features and frontier on small hand-made records."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import overlaps
from tallyweave.operators import cells, frontier, identify, profiling, scoped

SCHEMA = "side string, rec_id string, match_id string, minor long, value_date string, direction string, reference string, attributes string, currency string, account string, allocation string, target string, ord long"


def rec(side, i, group, minor, day="2026-01-05", direction=None, text="", ref="", target="", at=0):
    direction = direction or ("CR" if side == "A" else "DR")
    allocation = f"USD_{day}_acc_{text}{i}" if side == "A" else ""
    return (side, i, group, minor, day, direction, ref, text, "USD", "acc", allocation, target, at)


def frame(spark, rows):
    return spark.createDataFrame([(*r[:-1], at) for at, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def records(spark):
    al = lambda i, text="": f"USD_2026-01-05_acc_{text}{i}"
    return frame(
        spark,
        [
            rec("A", "a1", "m1", 100, text="x"), rec("B", "b1", "m1", 100, target=al("a1", "x")),
            rec("A", "a2", "m2", 200), rec("A", "a3", "m2", 200), rec("B", "b2", "m2", 200, target=f"[{al('a2')},{al('a3')}]"),
            rec("A", "a4", "m3", 300), rec("A", "a5", "m3", 301), rec("B", "b3", "m3", 300, target=f"[{al('a4')},{al('a5')}]"),
            rec("A", "a6", "m4", 400), rec("A", "a7", "m5", 400), rec("B", "b4", "m4", 400, target=al("a6")),
            rec("B", "b5", "m6", 500), rec("A", "a8", "m7", 600, direction="DR"), rec("B", "b6", "m8", 600),
            rec("A", "a9", "m9", 700), rec("B", "b7", "m10", 700), rec("B", "b8", "m11", 700, direction="CR"),
        ],
    )


def test_outcomes(records):
    truth = cells.truth(records)
    got = {r.b_id: r.outcome for r in cells.outcomes(records, truth).collect()}
    assert got == {"b1": "EXACT", "b2": "EXACT", "b3": "STRICT_SUBSET", "b4": "STRICT_SUPERSET", "b5": "NO_PREDICTION", "b6": "NO_PREDICTION", "b7": "NO_PREDICTION", "b8": "NO_PREDICTION"}
    kinds = {r.b_id: (r.cardinality, r.amount_class) for r in truth.collect()}
    assert kinds["b2"] == ("N:1", "single-amount") and kinds["b3"] == ("N:1", "multi-amount") and kinds["b5"] == ("unmatched", "single-amount")


def test_strata_and_evidence(records):
    scored = cells.outcomes(records, cells.truth(records))
    rows = {r.stratum: r for r in cells.rates(cells.outcome_counts(scored)).collect()}
    assert (rows["ALL"].total, rows["ALL"].predicted, rows["ALL"].exact) == (8, 4, 2)
    assert rows["N:1 / multi-amount"].exact == 0 and rows["N:1"].total == 2
    why = {r.component_id: r.collision_reason for r in cells.evidence(records, scored).collect()}
    assert why["USD|acc|2026-01-05|300"] == "FRAGMENTED_MULTI_AMOUNT_GROUP" and why["USD|acc|2026-01-05|400"] == "MERGED_FOREIGN_RECORDS" and why["USD|acc|2026-01-05|100"] == "NONE_ALL_EXACT"
    score = {r.stratum: r for r in cells.exact_set_score(cells.predictions(records), cells.truth(records).select("b_id", "target")).collect()}
    assert score["true-unmatched"].match_rate == 1.0 and score["ALL"].exact == 6


def test_mixed_directions_exclude_both(records):
    got = {r.minor: r.predicted for r in cells.cells(records).collect()}
    assert got[700] == [] and got[600] == [] and len(got[200]) == 2


def test_rules(records):
    got = {r.b_id: (r["class"], r.n, r.removed, r.mutual) for r in scoped.candidate_counts(records).collect()}
    assert got["b1"] == ("unique", 1, 0, True) and got["b2"][:2] == ("ambiguous", 2) and got["b6"] == ("impossible", 0, 1, False)
    assert got["b7"] == ("unique", 1, 0, True) and got["b8"] == ("impossible", 0, 1, False)
    rules = {(r.rule, r.stratum): r for r in scoped.rule_tallies(records, cells.truth(records).select("b_id", "cardinality")).collect()}
    assert rules["unique", "ALL"].predicted == 3 and rules["unique", "ALL"].correct == 1 and rules["unique", "ALL"].false_on_unmatched == 1


def test_ranking_takes_the_first_of_equals(spark):
    rows = [rec("A", "a1", "m", 100, text="alpha beta"), rec("A", "a2", "m", 100, text="alpha beta"), rec("B", "b1", "m", 100, text="alpha", target="USD_2026-01-05_acc_alpha betaa1")]
    pairs = scoped.with_features(scoped.ambiguous(frame(spark, rows)))
    got = scoped.argmax(pairs, "qgram3_jaccard").collect()
    assert [(r.a_id, r.correct) for r in got] == [("a1", True)]
    assert scoped.disambiguation(pairs, ["desc_sim"]).first().accuracy == 1.0


def test_profiles(records):
    p = {(r.side, r.field): r for r in profiling.field_profile(records).collect()}
    assert p["A", "reference"].non_null_rate == 0.0 and p["B", "minor"].distinct_values == 7 and p["A", "currency"].modal_share == 1.0
    b = {r.key: r for r in profiling.blocking(records).collect()}
    assert b["amount"].recall == 1.0 and b["amount"].largest == 2
    assert profiling.cardinality_histogram(records).first().asDict() == {"n_a": 0, "n_b": 1, "groups": 4}
    assert profiling.invariants(records).first().targets == 4


def test_witnesses(spark):
    rows = [
        rec("A", "a1", "m", 100, text="pay x"), rec("B", "b1", "m", 100), rec("A", "a2", "m", 200, text="pay y"), rec("B", "b2", "m", 200),
        rec("A", "c1", "m", 10, day="2026-01-06"), rec("B", "c2", "m", 10, day="2026-01-06"), rec("A", "c3", "m", 50, day="2026-01-06"), rec("B", "c4", "m", 25, day="2026-01-06"), rec("B", "c5", "m", 25, day="2026-01-06"),
        rec("A", "d1", "m", 10, day="2026-01-07"), rec("B", "d2", "m", 10, day="2026-01-07"),
        rec("A", "e1", "m", 1, day="2026-01-08", text="one"), rec("B", "e2", "m", 1, day="2026-01-08"), rec("A", "e3", "m", 2, day="2026-01-08", text="two"), rec("B", "e4", "m", 2, day="2026-01-08"),
    ]
    got = {(r.value_date[-2:], r.minor): (r.witness, r.witness_minor) for r in identify.witnesses(frame(spark, rows)).collect()}
    assert got["05", 100] == (identify.L2, 200) and got["07", 10] == (identify.NONE, None) and got["08", 1] == (identify.L1, 2)
    assert got["06", 10] == (identify.L1, 25) and got["06", 50][0] == identify.L1 and got["06", 25][0] == identify.L1


def test_window_counts_cells_not_records(spark):
    rows = [rec("A", f"a{i}", "m", 100, day=d) for i, d in enumerate(["2026-01-01", "2026-01-01", "2026-01-04", "2026-01-08", "someday"])]
    got = {r.value_date: r.amount_window_freq for r in frontier.window_frequency(frame(spark, rows)).collect()}
    assert got == {"2026-01-01": 2, "2026-01-04": 2, "2026-01-08": 1, "someday": 0}


def test_features(records):
    rows = {r.b_id: r for r in frontier.feature_rows(records, cells.truth(records)).collect()}
    assert set(rows) == {"b1", "b2", "b3", "b4"} and len(frontier.FEATURES) == 31
    r = rows["b1"]
    assert (r.label, r.n_a, r.date_cells, r.date_records, r.witness_count, r.round_unit, r.b_dir_dr, r.a_sib_any_diffamt) == (1, 1, 8, 17, 2, 1, 1, 15)  # balanced cells of the date: 100, 300, 600


@pytest.mark.parametrize("labels", [[1, 1, 0, 1, 1, 0, 1], [0, 1, 1, 1], [1, 1, 1], [0, 0, 1]])
def test_frontier(spark, labels):
    df = spark.createDataFrame([(f"b{i}", y, 1.0 - (i // 2) / 10) for i, y in enumerate(labels)], "b_id string, label int, score double")
    front = frontier.coverage_frontier(df, 10).orderBy("n")
    got = front.collect()
    assert [r.n for r in got] == list(range(1, len(labels) + 1)) and [r.exact for r in got] == [sum(labels[: i + 1]) for i in range(len(labels))]
    # the ranks are compared one by one: a mistake at rank 1 goes unnoticed unless asked for
    before, want = 0, None
    for r in got:
        if r.exact == before and r.n > 1:
            want = r.n
            break
        before = r.exact
    first = frontier.first_error(front).first()
    assert (first.n if first else None) == want
    strict = frontier.first_error(front, from_rank=1).first()
    assert (strict.n if strict else None) == (labels.index(0) + 1 if 0 in labels else None)
    assert frontier.best_at_target(front, 0.0).first().n == len(labels)
    assert frontier.at_coverage(front, 0.2).first().n == 2
    assert [r.bucket for r in frontier.buckets(front, 10).orderBy("bucket").collect()] == list(range(1, len(labels) + 1))


def test_ranker_orders_the_separable(spark):
    rows = spark.createDataFrame([(f"b{i}", i % 2, float(i % 2), float(i % 5)) for i in range(60)], "b_id string, label int, n_a double, n_b double")
    scored = frontier.fit_ranker(rows, ["n_a", "n_b"], trees=3, depth=2)(rows)
    top = scored.orderBy(F.desc("score")).limit(30).agg(F.avg("label")).first()[0]
    assert top == 1.0


def test_sibling_tokens_alike_for_any_bound(spark):
    words = ["pos", "ach", "x", "y", "z", ""]
    rows = [rec("AB"[i % 2], f"r{i}", "m", 100 * (i % 5), day=f"2026-01-0{5 + i % 3 // 2}", text=f"pos {words[i % 6]} {words[i * 7 % 5]} {i % 11}" if i % 9 else words[i % 6]) for i in range(80)]
    records = frame(spark, rows)
    bags = [(r.side, r.value_date, r.minor, set(f"{r.attributes or ''} {r.reference or ''}".casefold().split())) for r in records.collect()]
    want = {}
    for side, day, minor in {b[:3] for b in bags}:
        own = set().union(*[b[3] for b in bags if b[:3] == (side, day, minor)])
        n = sum(1 for b in bags if b[:2] == (side, day) and b[2] != minor and own & b[3])
        if n:
            want[side, day, minor] = n
    for frequent in (0, 1, 4, 10, 1000):
        assert {(r.side, r.value_date, r.minor): r.n for r in frontier.sibling_tokens(records, frequent).collect()} == want


def test_members_meet_kinds_and_not_pairs(spark):
    # forty members of a group share a word: they are one kind; weights count, words of one member alone do not
    rows = [("g", m, str(i), m % 2, ["pay", f"own{m}"] if m < 40 else [f"own{m}"]) for m in range(42) for i in range(2)] + [("h", 1, "a", 1, ["pay"]), ("h", 1, "b", 1, ["pay"])]
    items = spark.createDataFrame(rows, "group string, member long, item string, weight long, tokens array<string>")
    want = {("g", m): 40 - 2 * (m % 2) for m in range(40)}
    for frequent in (0, 1, 100):
        assert {(r.group, r.member): r.n for r in identify.met_weight(items, ["group"], frequent).collect()} == want


def test_outcomes_take_known_cells(spark, records):
    truth, seen = cells.truth(records), frontier.annotated(records)
    known = seen.select(*cells.CELL, "n_a", "n_b", "predicted", "balanced")
    show = lambda df: sorted((r.b_id, r.n_a, r.n_b, r.predicted, r.outcome) for r in df.collect())
    assert show(cells.outcomes(records, truth, known)) == show(cells.outcomes(records, truth))


def test_packed_keeps_rows_and_types(spark, records):
    from tallyweave.plans.cut import packed

    seen = frontier.annotated(records)
    got = packed(seen)
    assert got.dtypes == seen.dtypes and sorted(map(str, got.collect())) == sorted(map(str, seen.collect()))
    assert not {*records.inputFiles()} & {*got.inputFiles()} and all("packed-" in f for f in got.inputFiles())


def test_members_meet_items_alike_counted_by_bits_or_by_kinds(spark):
    # a group of over sixty-four items, weights above one, an item in two rows, items without tokens, a missing item name
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [("gh"[i % 3 == 0], i % 2, rng.randrange(40), f"i{i % 290}" if i % 50 else None, rng.randrange(6), rng.sample(words, rng.randrange(4))) for i in range(300)]
    rows += [("alone", 0, 1, "x", 3, ["w1"]), (None, 0, 1, "x", 3, ["w1"]), (None, 0, 2, "x", 3, ["w1"])]
    items = spark.createDataFrame(rows, "g string, h int, member long, item string, weight long, tokens array<string>")
    bags, weights = {}, {}
    for g, h, member, item, weight, tokens in rows:
        bags.setdefault((g, h, member, item), set()).update(tokens)
        weights[g, h, member, item] = max(weight, weights.get((g, h, member, item), 0))
    own = {}
    for key, tokens in bags.items():
        own.setdefault(key[:3], set()).update(tokens)
    want = {m: sum(weights[k] for k, b in bags.items() if k[:2] == m[:2] and k[2] != m[2] and b & own[m]) for m in own if m[0]}
    for held in (0, 40, 1 << 14):
        got = {(r.g, r.h, r.member): r.n for r in identify.met_weight(items, ["g", "h"], 3, held).collect()}
        assert got == {m: n for m, n in want.items() if n} and len(got) > 100


def test_groups_are_counted_whole_across_batches(monkeypatch):
    rows = [{"_hash": g, "g": g, "member": i, "item": str(i), "weight": 1, "tokens": ["a"]} for g in (5, 9, 2) for i in range(7)]
    table = pa.Table.from_pylist(rows)
    for gathered in (1, 4, 10, 100):
        monkeypatch.setattr(overlaps, "ROWS", gathered)
        got = [(r["g"], r["member"], r["n"]) for b in overlaps.counted(iter(table.to_batches(max_chunksize=3)), ["g"]) for r in b.to_pylist()]
        assert sorted(got) == sorted((r["g"], r["member"], 6) for r in rows)
    assert list(overlaps.counted(iter([]), ["g"])) == []


def test_parts_of_records_have_their_own_features(spark, records):
    # rows of both parts by one call are those of two
    both = records.withColumn("part", F.when(F.col("rec_id").isin("a1", "b1", "a2", "b2"), "x").otherwise("y"))
    show = lambda df: sorted(map(str, df.drop("part").collect()))
    got = frontier.feature_rows(both, within=("part",))
    for part in ("x", "y"):
        one = records.join(both.where(F.col("part") == part).select("rec_id"), "rec_id", "left_semi")
        assert show(got.where(F.col("part") == part).select("b_id", "label", *frontier.FEATURES)) == show(frontier.feature_rows(one, cells.truth(one)))
