"""The whole analysis of one or many projects, as lazily built DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.operators import complexity as cx
from siltscope.operators import match, score
from siltscope.operators.extract import parse_files
from siltscope.session import cut
from siltscope.sources.catalog import catalog
from siltscope.sources.listing import files_from, source_files


class Analysis:
    """Results for a set of files. errors: "permissive" records a bad file and goes on; "failfast" makes the complexity results
    fail on files that could not be read (other than for their encoding) or whose parse was given up."""

    def __init__(self, files: DataFrame, projects: DataFrame | None = None, patterns: DataFrame | None = None, import_scope: str = "cumulative", errors: str = "permissive"):
        self.files, self.import_scope, self.errors = files, import_scope, errors
        self.projects = files.select("project").distinct() if projects is None else projects.select("project").distinct()
        self.catalog = catalog(files.sparkSession) if patterns is None else patterns

    @cached_property
    def parsed(self) -> DataFrame:
        """One parse of each file, written once: patterns and complexity both read it."""
        return cut(parse_files(self.files), "parsed")

    @cached_property
    def matches(self) -> DataFrame:
        return match.pattern_matches(self.parsed, self.catalog, self.import_scope)

    @cached_property
    def pattern_files(self) -> DataFrame:
        return match.pattern_files(self.matches, self.catalog)

    @cached_property
    def rating(self) -> DataFrame:
        return score.rate(self.projects, score.project_sizes(self.parsed), score.pattern_weights(self.matches, self.catalog))

    @cached_property
    def functions(self) -> DataFrame:
        parsed = self.parsed
        if self.errors == "failfast":
            bad = (F.col("scan_status") == "aborted") & F.col("in_complexity_scope")
            parsed = parsed.withColumn("functions", F.when(bad, F.raise_error(F.concat(F.lit("cannot analyze "), "path"))).otherwise(F.col("functions")))
            unread = self.files.where("in_complexity_scope and read_error is not null and read_error not like 'UnicodeDecodeError%'").select("path").limit(1).collect()
            if unread:
                raise OSError(f"cannot read {unread[0].path}")
        return cx.function_complexity(parsed)

    @cached_property
    def summary(self) -> DataFrame:
        return cx.complexity_summary(self.projects, self.functions)


def analyze_path(spark: SparkSession, paths: str | list[str], order: str = "sorted", **options) -> Analysis:
    """Project folders, one project each; folders without Python files still get a rating."""
    import os

    roots = [paths] if isinstance(paths, str) else list(paths)
    projects = spark.createDataFrame([(os.path.realpath(r),) for r in roots], "project string")
    return Analysis(source_files(spark, roots, order), projects, **options)


def analyze(files: DataFrame, **options) -> Analysis:
    """Any DataFrame with project, ordinal, path and content."""
    return Analysis(files_from(files), **options)
