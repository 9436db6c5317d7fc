from datetime import datetime

from pyspark.sql import functions as F

from tallyweave import cli
from tallyweave.sources import sinks
from tallyweave.streaming import incremental


def test_reconcile_files(spark, tmp_path, capsys):
    (tmp_path / "l.csv").write_text("entry_id,date,description,amount,reference\nE1,2026-03-05,Ovi Tea delivery 81,-734.20,\nE2,2026-03-05,lost,-5.00,\n")
    (tmp_path / "s.csv").write_text("line_id,date,description,amount\nS1,2026-03-05,CARD OVI TEA,-734.20\n")
    assert cli.main(["reconcile", f"{tmp_path}/l.csv", f"{tmp_path}/s.csv", f"{tmp_path}/out"], spark) == 0
    assert "1 of 2 ledger entries matched (50.0%), 1 breaks" in capsys.readouterr().out
    assert sinks.read_report(spark, f"{tmp_path}/out").breaks.first().category == "missing_in_statement"
    (tmp_path / "bad.csv").write_text("line_id,date,description,amount\nS1,soon,x,1\n")
    assert cli.main(["reconcile", f"{tmp_path}/l.csv", f"{tmp_path}/bad.csv", f"{tmp_path}/o2"], spark) == 2
    assert "row 2" in capsys.readouterr().err


def test_eval_and_gate(spark, tmp_path, capsys):
    assert cli.main(["eval", "--seeds", "1,2", "--n-entries", "20", "--out", f"{tmp_path}/new"], spark) == 0
    assert cli.main(["compare", f"{tmp_path}/new", f"{tmp_path}/new"], spark) == 0
    better = spark.read.json(f"{tmp_path}/new/aggregates").withColumn("break_f1", F.lit(2.0))
    better.write.json(f"{tmp_path}/base/aggregates")
    assert cli.main(["compare", f"{tmp_path}/new", f"{tmp_path}/base"], spark) == 1
    assert "REGRESSION: break_f1" in capsys.readouterr().out


def test_windows_of_a_stream(spark, tmp_path):
    at = lambda d, h: datetime(2026, 1, d, h)
    rows = [("x", at(1, 1), 2.0), ("x", at(1, 5), 3.0), ("y", at(2, 1), 1.0), ("x", at(9, 1), 1.0)]
    schema = "scope string, ts timestamp, amount double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = incremental.late_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts")
    query = stream.writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.scope, r.start.day): (r.n, r.total) for r in spark.table("late").collect()}
    assert got == {("x", 1): (2, 5.0), ("y", 2): (1, 1.0), ("x", 9): (1, 1.0)}
