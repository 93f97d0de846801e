"""python -m lintlake FOLDER: review a tree of source files; the exit code tells whether anything blocks."""

from __future__ import annotations

import argparse
import re
import subprocess
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lintlake.api import review_tree
from lintlake.operators.review import SEVERITIES, as_json, at_least, position, with_advice
from lintlake.sources.config import DEFAULTS, load_config


def changed(root: str, ref: str | None) -> list[str]:
    """Names of added, copied or modified files: staged ones, or those that differ from ref."""
    command = ["git", "-C", root, "diff", "--name-only", "--diff-filter=ACM", "--relative", *([ref] if ref else ["--cached"])]
    return subprocess.run(command, capture_output=True, text=True, check=True).stdout.splitlines()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lintlake", description=__doc__)
    p.add_argument("paths", nargs="*", default=["."], help="folders to review")
    p.add_argument("--staged", action="store_true", help="only files staged in git")
    p.add_argument("--diff", metavar="REF", help="only files that differ from REF")
    p.add_argument("--rules-only", action="store_true", help="only rules, no tracking of tainted data")
    p.add_argument("--min-severity", choices=SEVERITIES)
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--fail-on", choices=[*SEVERITIES, "never"], default="high", help="exit with 1 on findings as severe as this")
    p.add_argument("--disable", nargs="*", default=[], metavar="ID")
    p.add_argument("--json", metavar="FOLDER", help="write the findings there as JSON")
    p.add_argument("--quiet", "-q", action="store_true", help="findings only, no counts")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("lintlake").getOrCreate()
    found, most = None, 0
    for root in o.paths:
        config = load_config(root) or DEFAULTS
        names = changed(root, o.diff) if o.staged or o.diff else None
        _, own = review_tree(spark, root, names, disabled=(*o.disable, *config["ignore"]["rules"]), rules_only=o.rules_only)
        for pattern in config["ignore"]["paths"]:
            own = own.where(~F.col("path").rlike(_glob(pattern)))
        own = at_least(own, o.min_severity or config["review"]["severity_threshold"], o.min_confidence)
        found, most = own if found is None else found.unionByName(own), most + config["review"]["max_findings"]
    if o.json:
        as_json(with_advice(found)).select("finding").write.mode("overwrite").text(o.json)
    # A report has at most max_findings of each folder's settings, the most severe; the counts and the exit code are of all.
    for r in found.orderBy(*position(), "path").limit(most).collect():
        print(f"{r['severity']:8} {r['path']}:{r['line_start'] or '-'} {r['rule_id'] or r['source']} {r['title']}")
    counts = {r["severity"]: r["n"] for r in found.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    if not o.quiet:
        print(", ".join(f"{counts.get(s, 0)} {s}" for s in SEVERITIES))
    return int(o.fail_on != "never" and any(counts.get(s) for s in SEVERITIES[: SEVERITIES.index(o.fail_on) + 1]))


def _glob(pattern: str) -> str:
    """A path pattern (* within a folder, ** across folders, ? one character) as a regular expression at a folder's edge."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?:^|/)" + "".join(parts.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|[^*?]+", pattern.strip("/"))) + "(?:/|$)"


if __name__ == "__main__":
    sys.exit(main())
