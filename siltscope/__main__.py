"""python -m siltscope PROJECT_PATH [-v] [-f text|json] [-c]"""

from __future__ import annotations

import argparse
import os
import sys

from siltscope.plans.report import report, to_json, to_text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltscope", description="Analyze a project for algorithm and system design patterns.")
    p.add_argument("project_path")
    p.add_argument("-v", "--verbose", action="store_true", help="Show detailed file matches")
    p.add_argument("-f", "--format", choices=("text", "json"), default="text", help="Output format")
    p.add_argument("-c", "--complexity", action="store_true", help="Include time/space complexity analysis")
    p.add_argument("--order", choices=("sorted", "walk"), default="sorted", help="Order of files: sorted, or as the system lists them")
    a = p.parse_args(argv)
    if not os.path.exists(a.project_path):
        p.error(f"Path '{a.project_path}' does not exist.")
    from pyspark.sql import SparkSession

    from siltscope.plans.analyzer import analyze_path

    spark = SparkSession.builder.appName("siltscope").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    tree = report(analyze_path(spark, a.project_path, a.order), a.complexity)
    print(to_json(tree) if a.format == "json" else to_text(tree, a.verbose, sys.stdout.isatty()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
