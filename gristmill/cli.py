"""Command lines: python -m gristmill.cli ingest ... and validate ...; 0 is success, 1 a failure, 2 wrong usage."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .operators.embed import Settings
from .operators.validate import report, summary, validate
from .plans.ingest import run_pipeline
from .sources.points import read_points


def session() -> SparkSession:
    return SparkSession.builder.appName("gristmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(args: argparse.Namespace) -> int:
    try:
        # a run that embeds fails at once without a key
        embedder = None if args.dry_run or args.skip_embeddings else Settings.read().embedder()
        total, processed, paths = run_pipeline(session(), args.input, args.output_dir, args.limit, args.dry_run, args.skip_embeddings, not args.no_history, args.batch_size, embedder, args.mode, args.native, args.lines, args.rejects, args.most_broken, args.vector_store)
    except Exception:
        logging.getLogger(__name__).exception("the run failed")
        return 1
    print(f"raw documents: {total}\nprocessed: {processed}")
    for name, path in paths.items():
        print(f"{name}: {path}")
    return 0


def check(args: argparse.Namespace) -> int:
    try:
        found = validate(read_points(session(), args.path), args.expected_dim).persist()
        totals = summary(found).first()
    except Exception as e:
        print(f"FAILED TO LOAD FILE: {e}")
        return 1
    if totals.errors:
        print("VALIDATION FAILED:\n")
        for row in report(found, "errors").orderBy("idx", "place").toLocalIterator():
            print(row.message)
        print(f"\nTotal errors: {totals.errors}")
        if totals.warnings:
            print(f"Total warnings: {totals.warnings}")
        return 1
    print(f"VALIDATION PASSED\nTotal points: {totals.points}")
    if totals.warnings:
        print("\nWarnings (non-fatal):")
        for row in report(found, "warnings").orderBy("idx", "place").toLocalIterator():
            print(row.message)
        print(f"\nTotal warnings: {totals.warnings}")
    return 0


def configure_logging(log_file: str | None) -> None:
    logging.getLogger().handlers.clear()
    console = logging.StreamHandler()
    console.setLevel(logging.INFO)
    handlers: list[logging.Handler] = [console]
    if log_file:
        detailed = logging.FileHandler(log_file, encoding="utf-8")
        detailed.setLevel(logging.DEBUG)
        handlers.append(detailed)
    logging.basicConfig(level=logging.DEBUG, handlers=handlers, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gristmill")
    parser.add_argument("--log-file")
    sub = parser.add_subparsers(required=True)
    own = sub.add_parser("ingest")
    own.add_argument("--input", required=True)
    own.add_argument("--output-dir", default="output")
    own.add_argument("--limit", type=int)
    own.add_argument("--dry-run", action="store_true")
    own.add_argument("--skip-embeddings", action="store_true")
    own.add_argument("--no-history", action="store_true")
    own.add_argument("--batch-size", type=int, default=100)
    own.add_argument("--mode", choices=("permissive", "strict"), default="permissive", help="take odd shapes as absent, or fail")
    own.add_argument("--lines", action="store_true", help="the input is JSON lines, read in parallel")
    own.add_argument("--native", action="store_true", help="write folders of JSON lines in parallel")
    own.add_argument("--rejects", action="store_true", help="write the rejected rows with their reasons")
    own.add_argument("--most-broken", type=float, default=0.0, help="share of lines that may be no JSON in permissive mode")
    own.add_argument("--vector-store", help="folder that keeps vectors, so that none is asked for twice")
    own.set_defaults(run=ingest)
    own = sub.add_parser("validate")
    own.add_argument("--path", required=True)
    own.add_argument("--expected-dim", type=int)
    own.set_defaults(run=check)
    args = parser.parse_args(argv)
    configure_logging(args.log_file)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
