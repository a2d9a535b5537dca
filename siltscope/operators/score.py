"""Scores of a project from its patterns and its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions.scalars import py_round

# A score's pieces, as (weight below which it holds, score at its start, weight at its start, slope); None: the rest.
DSA_PIECES = [(2, 2.0, 0, 1.0), (5, 4.0, 2, 0.67), (10, 6.0, 5, 0.4), (None, 8.0, 10, 0.1)]
DESIGN_PIECES = [(3, 2.0, 0, 0.67), (8, 4.0, 3, 0.4), (15, 6.0, 8, 0.29), (None, 8.0, 15, 0.1)]
# The highest rating that a label covers.
LABELS = [
    (2, "Poor - Minimal value, basic code"),
    (4, "Below Average - Simple structures only"),
    (6, "Average - Some DSA/design patterns"),
    (8, "Good - Strategic DSA and design"),
    (None, "Excellent - Comprehensive architecture"),
]


def piecewise(weight: Column, pieces: list[tuple]) -> Column:
    """The score of a total weight; null (no pattern) scores 1."""
    out = F.when(weight.isNull(), 1.0)
    for below, start, origin, slope in pieces:
        value = F.lit(start) + (weight - float(origin)) * slope
        out = out.otherwise(F.least(F.lit(10.0), value)) if below is None else out.when(weight < below, value)
    return out


def dsa_score(weight: Column) -> Column:
    return piecewise(weight, DSA_PIECES)


def design_score(weight: Column) -> Column:
    return piecewise(weight, DESIGN_PIECES)


def size_bonus(files: Column, lines: Column) -> Column:
    return F.when(files == 0, 0.0).otherwise(F.least(F.lit(5.0), files / 5) + F.least(F.lit(5.0), lines / 500))


def raw_rating(dsa: Column, design: Column, bonus: Column) -> Column:
    """The rating before rounding."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), dsa * 0.4 + design * 0.5 + bonus * 0.1))


def rating_label(rating: Column) -> Column:
    out = None
    for most, label in LABELS[:-1]:
        out = F.when(rating <= most, label) if out is None else out.when(rating <= most, label)
    return out.otherwise(LABELS[-1][1])


def rating_color(rating: Column) -> Column:
    return F.when(rating < 4, "red").when(rating < 7, "yellow").otherwise("green")


def project_sizes(files: DataFrame) -> DataFrame:
    """project, files_scanned, total_lines over the files that could be read."""
    return files.where("scan_status <> 'unreadable'").groupBy("project").agg(F.count(F.lit(1)).alias("files_scanned"), F.sum("line_count").alias("total_lines"))


def pattern_weights(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """project, then for each category its weight and number of patterns. Weights are added in the order in which patterns were
    first found, so that sums of doubles come out alike whatever the partitioning; unknown patterns count, but weigh nothing."""
    found = matches.groupBy("project", "category", "pattern").agg(F.min("ordinal").alias("first"))
    known = F.broadcast(catalog.select("category", "pattern", "pattern_ord", "weight"))
    x = found.join(known, ["category", "pattern"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("first", "pattern_ord", F.coalesce("weight", F.lit(0.0)).alias("weight"))))
    summed = x.groupBy("project", "category").agg(F.aggregate(ordered, F.lit(0.0), lambda a, e: a + e["weight"]).alias("weight"), F.count(F.lit(1)).cast("int").alias("n"))
    pick = lambda c, k: F.max(F.when(F.col("category") == k, F.col(c)))
    return summed.groupBy("project").agg(pick("weight", "dsa").alias("dsa_weight"), pick("weight", "design").alias("design_weight"), pick("n", "dsa").alias("dsa_patterns_count"), pick("n", "design").alias("design_patterns_count"))


def scored(projects: DataFrame, sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """Unrounded scores of every project, with or without files."""
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    x = projects.select("project").join(sizes, "project", "left").join(weights, "project", "left")
    x = x.select("project", "dsa_weight", "design_weight", zero("dsa_patterns_count", "int"), zero("design_patterns_count", "int"), zero("files_scanned", "long"), zero("total_lines", "long"))
    x = x.withColumns({"dsa_score": dsa_score(F.col("dsa_weight")), "design_score": design_score(F.col("design_weight")), "complexity_bonus": size_bonus(F.col("files_scanned"), F.col("total_lines"))})
    return x.withColumn("raw_rating", raw_rating(F.col("dsa_score"), F.col("design_score"), F.col("complexity_bonus")))


def rate(projects: DataFrame, sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """project, rating, label, the rounded breakdown and the counts; one row for each project."""
    x = scored(projects, sizes, weights).withColumn("rating", py_round(F.col("raw_rating"), 1))
    rounded = [py_round(F.col(c), 2).alias(c) for c in ("dsa_score", "design_score", "complexity_bonus")]
    return x.select("project", "rating", rating_label(F.col("rating")).alias("label"), *rounded, "dsa_patterns_count", "design_patterns_count", "files_scanned", "total_lines")
