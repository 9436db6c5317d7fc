"""Command line: reconcile two files, score generated data sets, compare with a baseline.

    python -m tallyweave.cli reconcile LEDGER.csv STATEMENT.csv OUT
    python -m tallyweave.cli eval --seeds 100-149 --n-entries 40 --out OUT
    python -m tallyweave.cli compare NEW BASELINE --tolerance 0.01
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tallyweave.operators import metrics, report
from tallyweave.plans.cut import cut
from tallyweave.sources import datagen, records, sinks


def compare(spark: SparkSession, new: str, baseline: str, tolerance: float) -> int:
    """1 if a gated metric of the results in ``new`` fell by more than the tolerance, else 0."""
    fallen = metrics.regressions(spark.read.json(f"{new}/aggregates"), spark.read.json(f"{baseline}/aggregates"), tolerance).orderBy("metric").collect()
    for r in fallen:
        print(f"REGRESSION: {r['metric']}: {r['value']:.4f} < baseline {r['baseline']:.4f} (tolerance {tolerance})")
    print("no regressions" if not fallen else f"{len(fallen)} regressions")
    return int(bool(fallen))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyweave")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("reconcile")
    for name in ("ledger", "statement", "out"):
        run.add_argument(name)
    score = commands.add_parser("eval")
    score.add_argument("--seeds", default="100-149", type=datagen.parse_seeds)
    score.add_argument("--n-entries", default=40, type=int)
    score.add_argument("--out", required=True)
    gate = commands.add_parser("compare")
    gate.add_argument("new")
    gate.add_argument("baseline")
    gate.add_argument("--tolerance", default=0.01, type=float)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyweave").getOrCreate()
    if args.command == "compare":
        return compare(spark, args.new, args.baseline, args.tolerance)
    if args.command == "eval":
        per_set = cut(datagen.evaluate(spark, args.seeds, args.n_entries))
        means = metrics.macro_mean(per_set)
        sinks.write_results(per_set, means, args.out)
        print(sinks.markdown_table(means))
        return 0
    ledger, lines = records.load_ledger_csv(spark, args.ledger), records.load_statement_csv(spark, args.statement)
    try:
        result = report.reconcile(ledger.strict(), lines.strict())
    except records.BadRow as e:
        print(e, file=sys.stderr)
        return 2
    sinks.write_report(result, args.out)
    print(report.render_summary(result.summary).first()["summary"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
