"""Command line: scan a folder with a folder of rules and write reports."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.text import SEVERITIES
from lodestone.operators.findings import at_least, exit_code
from lodestone.plans import reports, spreadsheet
from lodestone.plans.scan import Scan
from lodestone.sources import files, rules


#: The rules that come along.
STARTER = Path(__file__).resolve().parents[1] / "rules"
#: Files at a target's root with patterns of what not to scan; the first that is there counts.
IGNORE_FILES = (".lodestoneignore", ".scanignore")


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("target")
    parser.add_argument("--rules", default=str(STARTER), help="a folder or a file of rules; a small set of our own by default")
    parser.add_argument("--language", help="comma-separated")
    parser.add_argument("--severity")
    parser.add_argument("--exclude", action="append", default=[])
    parser.add_argument("--skip-tests", action="store_true")
    scope = parser.add_mutually_exclusive_group()
    scope.add_argument("--staged", action="store_true", help="only what is staged in git")
    scope.add_argument("--since", help="only what changed since a git revision")
    parser.add_argument("--fail-on", choices=list(SEVERITIES), help="exit with 1 for findings of this severity or worse, else with 0")
    parser.add_argument("-o", "--output", action="append", default=[], help="by suffix: .sarif, .html, .report.json, .xlsx, .json (a folder of rows), .csv (a folder), else text")
    return parser


def _write(out: str, found: DataFrame, source: DataFrame, target: str, info: dict) -> None:
    kind = Path(out).suffix
    if kind == ".csv":
        reports.write_csv(found, out)
    elif kind == ".xlsx":
        spreadsheet.write(found, out, info["files_scanned"])
    elif kind == ".json" and not out.endswith(".report.json"):
        reports.json_rows(found).write.text(out)
    elif kind == ".json":
        reports.write_json(found, out, info)
    elif kind == ".sarif":
        reports.write_sarif(found, out, "lodestone", "0.2", target, source.select("path"))
    else:
        Path(out).write_text(reports.html(found, target) if kind == ".html" else reports.console(found))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = _arguments().parse_args(args)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    begun = time.time()
    ignored = next((p for n in IGNORE_FILES if (p := Path(given.target) / n).is_file()), None)
    excludes = given.exclude + (files.ignore_patterns(spark.read.text(str(ignored.resolve()))) if ignored else [])
    source = files.from_tree(spark, given.target, excludes)
    if given.staged or given.since:
        source = files.scannable(source, files.git_paths(spark, given.target, given.since, given.staged), files.local_root(given.target))
    table = rules.from_yaml(spark, given.rules)
    scan = Scan(languages=given.language.split(",") if given.language else None, severity_min=given.severity, skip_tests=given.skip_tests)
    found = scan.run(source, table).cache()
    if given.output:
        info = {"target": given.target, "files_scanned": source.count(), "rules_applied": table.filter("enabled").count(), "duration_seconds": round(time.time() - begun, 3)}
        for out in given.output:
            _write(out, found, source, given.target, info)
    else:
        print(reports.console(found))
    if given.fail_on:
        return int(not at_least(found, given.fail_on).isEmpty())
    return exit_code(found).first().exit_code


if __name__ == "__main__":
    sys.exit(main())
