"""Loaders, adapters, sinks, generator, metrics and stream."""

import hashlib
import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.config import LEDGER, STATEMENT, MatchConfig
from tallyweave.operators import metrics, report
from tallyweave.plans import registry
from tallyweave.sources import benchmark, datagen, records, sinks
from tallyweave.streaming import incremental

HEAD = "entry_id,date,description,amount,reference\n"


def save(path, text):
    path.write_text(text)
    return str(path)


def test_csv_types_and_nulls(spark, tmp_path):
    got = records.load_ledger_csv(spark, save(tmp_path / "l.csv", HEAD + 'E1, 2026-03-05 ," Ovi, Tea ", -734.20 ,\nE2,20260306,b,+7,INV\n'))
    a, b = got.strict().orderBy("ord").collect()
    assert (a.entry_id, a.date, a.description, a.amount, a.reference, a.amount_text, a.ord) == ("E1", date(2026, 3, 5), " Ovi, Tea ", Decimal("-734.2"), None, "-734.20", 0)
    assert (b.date, b.reference, b.amount_text, b.ord) == (date(2026, 3, 6), "INV", "7", 1)


@pytest.mark.parametrize(("body", "row"), [("E1,notadate,x,1,\n", 2), ("E1,2026-01-01,x,1,\nE2,2026-01-01,x,NaN,\n", 3), ("E1,2026-01-01\n", 2), ("E1,2026-3,x,1,\n", 2), ("E1,2026-01-01,x,1.00000000001,\n", 2)])
def test_bad_rows_are_findings(spark, tmp_path, body, row):
    got = records.load_ledger_csv(spark, save(tmp_path / "l.csv", HEAD + body))
    assert [r.row for r in got.bad_rows.collect()] == [row]
    with pytest.raises(records.BadRow) as e:
        got.strict()
    assert e.value.row == row


def test_missing_column_is_named(spark, tmp_path):
    with pytest.raises(records.MissingColumn, match="date"):
        records.load_statement_csv(spark, save(tmp_path / "s.csv", "line_id,description,amount\nS1,x,1\n"))
    with pytest.raises(ValueError, match="bytes"):
        records.load_ledger_csv(spark, save(tmp_path / "l.csv", HEAD), most_bytes=5)


def test_documents(spark, tmp_path):
    doc = {"source": "s", "doc": {"currency": "INR", "transactions": [{"txn_date": "2026-01-03", "description": "a", "debit": "20544.01", "credit": None}, {"txn_date": "2026-01-04", "description": "b", "debit": "", "credit": "5"}]}}
    got = records.load_documents(spark, save(tmp_path / "d.json", json.dumps(doc, indent=1))).orderBy("ord").collect()
    assert [(r.line_id, r.amount, r.amount_text, r.reference) for r in got] == [("T0000", Decimal("-20544.01"), "-20544.01", None), ("T0001", Decimal("5"), "5", None)]


def test_benchmark_files(spark, tmp_path):
    columns = ["matchId"] + [f"{s}_{c}" for s in "AB" for c in ("id", "amount", "valueDate", "debitOrCredit", "transactionReferences", "transactionAttributes", "currencyCode", "account")] + ["A_allocation", "targetAllocation"]
    a = ["m1", "a1", "1.005", "2026-01-01", "CR", "", "x", "USD", "acc", *[""] * 8, "al", ""]
    b = ["m1", *[""] * 8, "b1", "12", "2026-01-01", "DR", "r", "y", "USD", "acc", "", "[al,bl]"]
    path = save(tmp_path / "t.csv", "\n".join(",".join(f'"{x}"' for x in r) for r in (columns, a, b)))
    got = {r.rec_id: r for r in benchmark.load_records(spark, path).collect()}
    assert (got["a1"].side, got["a1"].minor, got["a1"].allocation) == ("A", 100, "al") and (got["b1"].minor, got["b1"].target, got["b1"].reference) == (1200, "[al,bl]", "r")
    entries, lines = benchmark.as_ledger(benchmark.load_records(spark, path))
    assert entries.first().amount == Decimal("-1") and lines.first().amount == Decimal("-12")


def test_submissions(spark):
    rows = [("b1", '["x","y"]', ""), ("b2", "[x,z]", ""), ("b3", "", "q"), ("b4", "", ""), ("b5", "plain", "q"), ("b6", '"s"', ""), ("b7", "[]", "q")]
    df = spark.createDataFrame(rows, "B_id string, targetAllocation string, A_allocation string")
    got = {r.b_id: r.predicted for r in benchmark.submission(df).collect()}
    assert got == {"b1": ["x", "y"], "b2": ["x", "z"], "b3": ["q"], "b4": [], "b5": ["plain"], "b6": ["s"], "b7": []}


@pytest.fixture(scope="module")
def sets(spark):
    return {k: v.cache() for k, v in datagen.generate(spark, [1, 2, 3], 60).items()}


def test_generated_truth_covers_every_record_once(sets):
    p, b = sets["pairs"], sets["breaks"]
    for name, ids, side, i in (("ledger", "entry_ids", "ledger", "entry_id"), ("statement", "line_ids", "statement", "line_id")):
        told = p.select(F.explode(ids).alias(i)).unionByName(b.where(F.col("side") == side).select(F.col("record_id").alias(i)))
        assert told.count() == told.distinct().count() == sets[name].count() == told.join(sets[name], i).count()


def test_generated_pairs_balance(sets):
    def total(ids, name, i):
        rows = sets["pairs"].select(F.concat_ws(",", "line_ids").alias("k"), F.explode(ids).alias(i)).join(sets[name], i)
        return {r.k: r.t for r in rows.groupBy("k").agg(F.sum("amount").alias("t")).collect()}

    assert total("entry_ids", "ledger", "entry_id") == total("line_ids", "statement", "line_id")


def test_generation_repeats_and_finds_its_truth(spark, sets):
    again = datagen.generate(spark, [3, 1, 2], 60)["ledger"]
    assert sorted(map(str, again.collect())) == sorted(map(str, sets["ledger"].collect()))
    per = datagen.evaluate(spark, [1, 2, 3], 60)
    mean = metrics.macro_mean(per).first()
    assert per.count() == 3 and mean.pair_precision > 0.95 and mean.pair_recall > 0.9 and mean.break_recall > 0.9
    assert datagen.parse_seeds("100-102") == [100, 101, 102] and datagen.parse_seeds("1,4") == [1, 4]


def test_written_data_reads_back(spark, sets, tmp_path):
    one = {k: v.where("seed = 1") for k, v in sets.items()}
    sinks.write_dataset(one["ledger"], one["statement"], one["pairs"], one["breaks"], str(tmp_path))
    back = records.load_ledger_csv(spark, f"{tmp_path}/ledger").strict()
    show = lambda df: sorted((r.entry_id, r.date, r.description, r.amount, r.amount_text, r.reference) for r in df.collect())
    assert show(back) == show(one["ledger"])
    r = report.reconcile(one["ledger"], one["statement"])
    sinks.write_report(r, f"{tmp_path}/report")
    assert sinks.read_report(spark, f"{tmp_path}/report").matches.count() == r.matches.count()
    sums = {x.path.rsplit("/", 1)[1]: x.sha256 for x in sinks.checksums(spark, f"{tmp_path}/truth_pairs/*.json").collect()}
    assert all(hashlib.sha256((tmp_path / "truth_pairs" / n).read_bytes()).hexdigest() == h for n, h in sums.items())
    assert sinks.markdown_table(r.summary).count("|") > 8


def metric_frames(spark, pred, gold):
    return spark.createDataFrame(pred, "entry_ids array<string>, line_ids array<string>, confidence double"), spark.createDataFrame(gold, "entry_ids array<string>, line_ids array<string>")


def test_floor_sweep(spark):
    p, g = metric_frames(spark, [(["E1"], ["S1"], 0.95), (["E9"], ["S9"], 0.8), (["E2"], ["S3", "S2"], 0.6)], [(["E1"], ["S1"]), (["E2"], ["S2", "S3"])])
    got = metrics.auto_match_rate(p, g).first()
    assert (got.rate, got.threshold, got.precision_at) == (0.5, 0.95, 1.0)
    assert metrics.auto_match_rate(p, g, floor=0.6).first().rate == 1.0
    prf = metrics.pair_prf(p, g).first()
    assert prf.precision == pytest.approx(2 / 3) and prf.recall == 1.0


@pytest.mark.parametrize(("p", "g", "want"), [(0, 0, (1.0, 1.0, 1.0)), (0, 1, (0.0, 0.0, 0.0)), (1, 0, (0.0, 0.0, 0.0))])
def test_empty_sets(spark, p, g, want):
    pred, gold = metric_frames(spark, [(["E1"], ["S1"], 0.9)] * p, [(["E1"], ["S1"])] * g)
    assert tuple(metrics.pair_prf(pred, gold).first()) == want
    assert metrics.auto_match_rate(pred, gold).first().rate == 0.0


def test_break_scores_name_all_categories(spark):
    one = spark.createDataFrame([("ledger", "E1", "missing_in_statement")], "side string, record_id string, category string")
    got = {r.category: r.f1 for r in metrics.break_prf(one, one).collect()}
    assert len(got) == 5 and set(got.values()) == {1.0}


def test_regressions(spark):
    base = spark.range(1).select(F.lit(0.9).alias("pair_f1"), F.lit(0.5).alias("auto_match_rate"), F.lit(0.8).alias("break_f1"))
    worse = base.withColumn("pair_f1", F.lit(0.88)).withColumn("break_f1", F.lit(0.795))
    assert [r.metric for r in metrics.regressions(worse, base).collect()] == ["pair_f1"]


def test_stream_equals_one_run(spark, sets):
    ledger, lines = (sets[k].where("seed < 3").withColumn("scope", F.col("seed").cast("string")).drop("seed") for k in ("ledger", "statement"))
    config = MatchConfig(scope=("scope",))
    show = lambda df: sorted((r.entry_ids, r.line_ids, r.tier, round(r.confidence, 9)) for r in df.collect())
    assert show(incremental.replay(ledger, lines, config)) == show(report.match(ledger, lines, config))


def test_stream_drops_repeated_deliveries(spark, sets):
    ledger, lines = (sets[k].where("seed = 1").withColumn("scope", F.lit("x")).drop("seed") for k in ("ledger", "statement"))
    config = MatchConfig(scope=("scope",))
    m = incremental.Matcher(ledger, config)
    m.update(lines, 0)
    first = m.matches(spark).count()
    m.update(lines, 1)
    m.update(lines, 1)
    assert m.matches(spark).count() == first == report.match(ledger, lines, config).count()
    with pytest.raises(ValueError):
        incremental.Matcher(ledger, MatchConfig())


def test_a_batch_meets_the_ledger_with_its_new_lines_alone(spark, sets, monkeypatch):
    ledger, lines = (sets[k].where("seed < 3").withColumn("scope", F.col("seed").cast("string")).drop("seed") for k in ("ledger", "statement"))
    config = MatchConfig(scope=("scope",), char_ratio=False)
    met = []
    plain = incremental.exact_and_lagged
    monkeypatch.setattr(incremental, "exact_and_lagged", lambda e, l, c: (met.append(l.count()), plain(e, l, c))[1])
    show = lambda df: sorted((r.entry_ids, r.line_ids, r.tier, round(r.confidence, 9)) for r in df.collect())
    parts = [lines.where("ord % 2 = 0"), lines.where("ord % 2 = 1 and scope = '1'"), lines.where("scope = '2'")]
    m, seen = incremental.Matcher(ledger, config), None
    for i, part in enumerate(parts):
        m.update(part, i)
        seen = part if seen is None else seen.unionByName(part).dropDuplicates()
        # asked for after the first and the last batch, so that the last answer rests on the first one
        if i != 1:
            assert show(m.matches(spark)) == show(report.match(ledger, seen, config))
    assert sum(met) == seen.count() and 0 < met[2] < parts[2].count()


def test_streamed_matches_search_whole_windows(spark, tmp_path, monkeypatch):
    # sixteen parts by id lie before the two that add up, on both sides: a window cut to twelve does not hold them
    record = lambda i, cents: ("x", i, date(2026, 3, 2), "tea", Decimal(cents) / 100, None, str(cents), 0)
    entries = [record(f"E{n:02d}", -10007 * (n + 1)) for n in range(16)] + [record("T1", -50010), record("T2", -23417), record("W", -83353)]
    lines = [record(f"S{n:02d}", -20011 * (n + 1)) for n in range(16)] + [record("U1", -50020), record("U2", -33333), record("V", -73427)]
    frame = lambda rows, kind: spark.createDataFrame(rows, T.StructType([T.StructField("scope", T.StringType()), *kind.fields]))
    monkeypatch.setattr(registry.projection, "ledger", lambda *_: frame(entries, LEDGER))
    monkeypatch.setattr(registry.projection, "statement", lambda *_: frame(lines, STATEMENT))
    got = {(r.tier, r.entry_ids, r.line_ids) for r in registry.streamed_matches(spark, str(tmp_path)).collect()}
    assert got == {(3, "W", "U1,U2"), (4, "T1,T2", "V")}
