"""Command line: ``spark-submit`` or ``python -m tidewatch <job> ...``."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from tidewatch.params import EventParams
from tidewatch.plans import jobs
from tidewatch.session import configure


def _stamp(text: str) -> datetime:
    return datetime.strptime(text, "%Y%m%d-%H%M%S")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewatch")
    job = parser.add_subparsers(dest="job", required=True)

    detect = job.add_parser("detect", help="count files to peak signals")
    detect.add_argument("source")
    detect.add_argument("target")
    detect.add_argument("keywords", nargs="*", help="keep only lines with one of these")
    detect.add_argument("--densify", action="store_true", help="fill absent hours with 0 views")
    detect.add_argument("--as-text", action="store_true", help="write text records")
    detect.add_argument("--peaking-only", action="store_true", help="leave out topics without a peak")

    extract = job.add_parser("extract", help="peak signals to spike JSON")
    extract.add_argument("source")
    extract.add_argument("target")
    extract.add_argument("threshold", type=float)
    extract.add_argument("--dates", help="file of event dates")
    extract.add_argument("--from-text", action="store_true", help="the signals are text records")
    extract.add_argument("--single-file", action="store_true", help="write one file, by one task")

    score = job.add_parser("score", help="count files to similarity scores")
    score.add_argument("source")
    score.add_argument("library", help="stored reference series")
    score.add_argument("target")

    tables = job.add_parser("report", help="spike JSON and a calendar to the report tables")
    tables.add_argument("spikes")
    tables.add_argument("calendar")
    tables.add_argument("target")
    tables.add_argument("--poll", action="append", default=[], metavar="NAME=FILE", help="a poll document, repeatable")

    matrix = job.add_parser("matrix", help="top pages by hour")
    matrix.add_argument("folder")
    matrix.add_argument("first", type=_stamp)
    matrix.add_argument("last", type=_stamp)
    matrix.add_argument("target")

    listing = job.add_parser("manifest", help="hourly files of whole months")
    listing.add_argument("year", type=int)
    listing.add_argument("first_month", type=int)
    listing.add_argument("last_month", type=int)
    listing.add_argument("target")

    args = parser.parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"tidewatch {args.job}").getOrCreate())
    if args.job == "detect":
        jobs.detect_trends(
            spark,
            args.source,
            args.target,
            keywords=args.keywords or None,
            densify=args.densify,
            as_text=args.as_text,
            peaking_only=args.peaking_only,
        )
    elif args.job == "extract":
        params = EventParams(views_threshold=args.threshold)
        jobs.extract_spikes(
            spark, args.source, args.target, params, args.dates, args.from_text, args.single_file
        )
    elif args.job == "score":
        jobs.score_trends(spark, args.source, args.library, args.target)
    elif args.job == "report":
        polls = dict(p.split("=", 1) for p in args.poll)
        jobs.event_report(spark, args.spikes, args.calendar, args.target, polls or None)
    elif args.job == "matrix":
        jobs.page_matrix(spark, args.folder, args.first, args.last, args.target)
    else:
        jobs.download_list(spark, args.year, args.first_month, args.last_month, args.target)


if __name__ == "__main__":
    main()
