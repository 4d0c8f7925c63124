"""Command line: python -m quirewise comments|extract|diff|guard FILES; exit code 1 for an input that cannot be read, 3 for a flag raised."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quirewise import api
from quirewise.operators.guard import flagged
from quirewise.sources.files import SourceError
from quirewise.sources.sinks import show


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quirewise")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("comments").add_argument("file")
    extract = sub.add_parser("extract")
    extract.add_argument("file")
    extract.add_argument("--kind", choices=("comments", "report", "issues"), default="report")
    for name in ("diff", "guard"):
        pair = sub.add_parser(name)
        pair.add_argument("original")
        pair.add_argument("revised")
        if name == "guard":
            pair.add_argument("--protect", action="append", default=[])
            pair.add_argument("--fail-on-flag", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quirewise").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if args.command == "comments":
            print(show(api.extract_comments(spark, args.file).select("id", "author", "text", "anchor_text", "resolved")))
        elif args.command == "extract":
            print(show(api.extract_issues(spark, args.file, args.kind).select("id", "category", "severity", "comment_text")))
        elif args.command == "diff":
            found = api.compare_documents(spark, [("pair", args.original, args.revised)])
            print(show(found.summary))
            print(show(found.paragraphs.filter("kind <> 'unchanged'").orderBy("place").select("kind", "original", "revised", "similarity", "added_text", "removed_text")))
        else:
            report = api.guard_revision(spark, [("pair", args.original, args.revised)], tuple(args.protect)).cache()
            print(show(report.select("status", "item", "before", "after")))
            if args.fail_on_flag and flagged(report).filter("flagged").count():
                return 3
    except (SourceError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
