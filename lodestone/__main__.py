"""Commands: profile, repair, revert and bench over CSV files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .functions.schema import load_schema
from .operators import apply, bench, detect, policy, report
from .sources import journal, tables


def _session() -> SparkSession:
    return SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _print(lines) -> None:
    for r in lines.toLocalIterator():
        print(r["line"])


def profile(args) -> int:
    """Exit 0, or 1 with an unsafe issue."""
    issues = detect.detect_all(tables.read_csv(_session(), args.path), load_schema(args.schema)).cache()
    _print(report.profile_lines(issues))
    return int(detect.has_unsafe(issues).first()["unsafe"])


def _confirmed(tried):
    """The escalated fixes that verify and that the operator, asked one by one, lets pass."""
    open_ = tried.where("status = 'escalated' and verification = 'ACCEPT'")
    yes = [(r["_row"], r["column"]) for r in open_.orderBy("_row", "column").toLocalIterator() if input(f"row {r['_row']}, {r['column']}: '{r['old_value']}' -> '{r['new_value']}' ({r['rule_id']}). Apply? [y/N] ").strip().lower() in ("y", "yes")]
    if not yes:
        return tried.limit(0)
    chosen = tried.sparkSession.createDataFrame(yes, "_row bigint, column string")
    return open_.join(chosen, ["_row", "column"], "left_semi").select(*tried.columns)


def repair(args) -> int:
    """Exit 0 if any fix passes, else 1; with --apply the accepted fixes are written under the journal."""
    if args.dry_run == args.apply:
        print("choose --dry-run or --apply", file=sys.stderr)
        return 2
    spark, schema = _session(), load_schema(args.schema)
    context = policy.Context(args.allow_pii, args.confirm_pii, args.confirm_escalations)
    table = tables.read_csv(spark, args.path)
    tried = apply.attempts(table, detect.detect_all(table, schema), schema, context).cache()
    fixes = tried.where("status = 'accepted'")
    if args.interactive:
        fixes = fixes.unionAll(_confirmed(tried))
    _print(report.diff_lines(fixes))
    _print(report.attempt_lines(tried))
    if policy.evaluate_batch(fixes)[0] == "DENY" or not fixes.take(1):
        return 1
    if args.apply:
        wanted = [journal.CellFix(r["_row"], r["column"], r["old_value"], r["new_value"], r["detector_id"]) for r in fixes.orderBy("_row", "column").toLocalIterator()]
        print(journal.apply(spark, args.path, wanted).txn_id)
    return 0


def revert(args) -> int:
    print(journal.revert(args.txn, args.root).txn_id)
    return 0


def run_bench(args) -> int:
    spark = _session()
    pairs = {}
    for x in args.pair:
        name, dirty, clean = x.split(":")
        d, _, truth = tables.read_pair(spark, dirty, clean)
        pairs[name] = (d, truth)
    records = bench.run(spark, pairs, args.methods.split(","), args.seeds, args.allow_more)
    print(bench.markdown(records))
    if args.out:
        with open(args.out, "w") as f:
            json.dump([r.asDict() for r in records.collect()], f, indent=1)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lodestone")
    sub = top.add_subparsers(required=True)
    p = sub.add_parser("profile")
    p.set_defaults(run=profile)
    r = sub.add_parser("repair")
    r.set_defaults(run=repair)
    for flag in ("--dry-run", "--apply", "--allow-pii", "--confirm-pii", "--confirm-escalations", "--interactive"):
        r.add_argument(flag, action="store_true")
    for x in (p, r):
        x.add_argument("path")
        x.add_argument("--schema")
    v = sub.add_parser("revert")
    v.set_defaults(run=revert)
    v.add_argument("txn")
    v.add_argument("--root", default=".")
    b = sub.add_parser("bench")
    b.set_defaults(run=run_bench)
    b.add_argument("pair", nargs="+", help="name:dirty.csv:clean.csv")
    b.add_argument("--methods", default="random,heuristic")
    b.add_argument("--seeds", type=int, default=3)
    b.add_argument("--out")
    b.add_argument("--allow-more", action="store_true")
    args = top.parse_args(argv)
    try:
        return args.run(args)
    except (journal.JournalError, policy.PolicyError, ValueError, OSError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
