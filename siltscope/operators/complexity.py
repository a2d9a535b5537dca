"""Judgement on function facts: time and space class, reasons, confidence, dominant operation. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltscope.functions.scalars import py_round
from siltscope.session import cut

# What a time class holds if it is high.
HIGH = ("n²", "n³", "n^", "2^n", "k^n")


def recursion_type(calls: Column) -> Column:
    return F.when(calls == 1, "linear").when(calls == 2, "binary").when(calls > 2, "multiple")


def time_rules(f: dict[str, Column]) -> list[tuple[Column, Column, Column]]:
    """(condition, class, reason), the first that holds decides. f: recursive_calls, uses_memo, max_loop_depth, has_log_n, has_sort,
    first_op and first_cost (of the first call that costs with n), first_loop_exits."""
    calls, depth, lit = f["recursive_calls"], f["max_loop_depth"], F.lit
    kind, recursive = recursion_type(calls), calls > 0
    power = F.concat(lit("O(n^"), depth.cast("string"), lit(")"))
    return [
        (recursive & f["uses_memo"], lit("O(n)"), F.concat(lit("Recursive ("), kind, lit(") with memoization → O(n)"))),
        (calls == 1, lit("O(n)"), lit("Linear recursion without memoization → O(n)")),
        (calls == 2, lit("O(2^n)"), lit("Binary recursion without memoization → O(2^n)")),
        (recursive, lit("O(k^n)"), F.concat(lit("Multiple recursion ("), calls.cast("string"), lit(" calls) → O(k^n)"))),
        ((depth == 0) & f["has_sort"], lit("O(n log n)"), lit("No loops but uses sorting → O(n log n)")),
        ((depth == 0) & f["first_cost"].isNotNull(), f["first_cost"], F.concat(lit("Uses "), f["first_op"], lit("() → "), f["first_cost"])),
        (depth == 0, lit("O(1)"), lit("No loops or expensive operations → O(1)")),
        ((depth == 1) & f["has_log_n"], lit("O(log n)"), lit("Single loop with log n iterations → O(log n)")),
        ((depth == 1) & f["has_sort"], lit("O(n log n)"), lit("Single loop + sorting → O(n log n)")),
        ((depth == 1) & f["first_loop_exits"], lit("O(n)"), lit("Single loop with early exit → O(n) worst case")),
        (depth == 1, lit("O(n)"), lit("Single loop over input → O(n)")),
        ((depth == 2) & f["has_log_n"], lit("O(n log n)"), lit("Nested loops with log n inner → O(n log n)")),
        (depth == 2, lit("O(n²)"), lit("Nested loops (depth 2) → O(n²)")),
        (depth == 3, lit("O(n³)"), lit("Triple nested loops → O(n³)")),
        (lit(True), power, F.concat(lit("Deep nesting (depth "), depth.cast("string"), lit(") → "), power)),
    ]


def decide(rules: list[tuple], k: int) -> Column:
    out = F.when(rules[0][0], rules[0][k])
    for r in rules[1:]:
        out = out.when(r[0], r[k])
    return out


def space_class(recursive: Column, first_power: Column, has_linear: Column) -> Column:
    return F.when(recursive, "O(n)").otherwise(F.coalesce(first_power, F.when(has_linear, "O(n)"), F.lit("O(1)")))


def confidence(recursive: Column, memo: Column, depth: Column, typed: Column) -> Column:
    """From 0.8 down, in the order of the deductions, so that doubles come out alike."""
    less = lambda c, by: F.when(c, F.lit(by)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.3), F.lit(0.8) - less(recursive & ~memo, 0.2) - less(depth > 2, 0.1) - less(typed == 0, 0.1))


def dominant_operation(calls: Column, depth: Column, first_op: Column) -> Column:
    """first_op: of all calls with a known cost."""
    looped = F.concat(F.lit("nested loops (depth "), depth.cast("string"), F.lit(")"))
    return F.when(calls > 0, F.concat(F.lit("recursion ("), recursion_type(calls), F.lit(")"))).when(depth > 0, looped).otherwise(first_op)


def is_high(time_complexity: Column) -> Column:
    out = F.lit(False)
    for x in HIGH:
        out = out | time_complexity.contains(x)
    return out


def loop_depth_class(depth: Column) -> Column:
    """The class of a plain nest of loops."""
    return F.when(depth == 0, "O(1)").when(depth == 1, "O(n)").when(depth == 2, "O(n²)").when(depth == 3, "O(n³)").otherwise("O(n^k)")


def first_where(items: str, condition, field: str) -> Column:
    return F.get(F.filter(items, condition), 0)[field]


def function_complexity(parsed: DataFrame) -> DataFrame:
    """A row for each function of the files in scope: classes, confidence, reasons, and the facts a library user may want."""
    return judged(parsed.where("in_complexity_scope"), "project", "ordinal", "path")


def judged(parsed: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep`, then function_complexity's, for each function in the column functions."""
    x = parsed.select(*keep, F.explode("functions").alias("f")).select(*keep, "f.*")
    costly = lambda e: e["cost"].contains("n")
    x = x.withColumns({
        "has_log_n": F.exists("loops", lambda e: e["estimated_iterations"] == "log n"),
        "has_sort": F.exists("expensive_ops", lambda e: e["op"].isin("sort", "sorted")),
        "first_cost": first_where("expensive_ops", costly, "cost"),
        "first_op": first_where("expensive_ops", costly, "op"),
        "any_op": F.get("expensive_ops", 0)["op"],
        "first_loop_exits": F.coalesce(F.get("loops", 0)["has_early_exit"], F.lit(False)),
        "power": first_where("space_allocs", lambda e: e["size"].contains("n^"), "size"),
        # positions from 1 of the first linear allocation and of the first power; 0: none
        "linear_at": F.array_position(F.transform("space_allocs", lambda e: e["size"]), "O(n)"),
        "power_at": F.array_position(F.transform("space_allocs", lambda e: e["size"].contains("n^")), True),
    })
    c = F.col
    recursive, rules = c("recursive_calls") > 0, time_rules({k: c(k) for k in x.columns})
    creates = lambda e, size: F.concat(e["kind"], F.lit(" creates "), size, F.lit(" space"))
    linear = F.when((c("linear_at") > 0) & ((c("power_at") == 0) | (c("linear_at") < c("power_at"))), creates(F.get("space_allocs", (c("linear_at") - 1).cast("int")), F.lit("O(n)")))
    power = F.when(c("power_at") > 0, creates(F.get("space_allocs", (c("power_at") - 1).cast("int")), c("power")))
    small = F.when((c("linear_at") == 0) & (c("power_at") == 0), "Only constant space allocations → O(1)")
    space_reasons = (
        F.when(recursive & c("uses_memo"), F.array(F.lit("Recursion with memoization → O(n) for cache")))
        .when(recursive, F.array(F.lit("Recursion → O(n) call stack")))
        .when(F.size("space_allocs") == 0, F.array(F.lit("No significant allocations → O(1)")))
        .otherwise(F.array_compact(F.array(linear, power, small)))
    )
    params = F.concat(F.lit("Parameters: "), c("n_params").cast("string"), F.lit(" ("), c("n_typed").cast("string"), F.lit(" typed)"))
    reasons = F.concat(F.array_compact(F.array(params, F.when(c("uses_memo"), "Uses memoization decorator"), decide(rules, 2))), space_reasons)
    return x.select(
        *keep, "walk_idx", "name", "line",
        decide(rules, 1).alias("time_complexity"),
        space_class(recursive, c("power"), c("linear_at") > 0).alias("space_complexity"),
        confidence(recursive, c("uses_memo"), c("max_loop_depth"), c("n_typed")).alias("confidence"),
        reasons.alias("reasoning"), recursive.alias("has_recursion"), recursion_type(c("recursive_calls")).alias("recursion_type"),
        c("uses_memo").alias("uses_memoization"), "has_early_exit",
        dominant_operation(c("recursive_calls"), c("max_loop_depth"), c("any_op")).alias("dominant_operation"),
        c("loops").alias("loop_analysis"), F.map_from_entries(F.transform("variables", lambda v: F.struct(v["name"], v))).alias("variables"),
    )


def distribution(functions: DataFrame, column: str) -> DataFrame:
    """project, the class, and its number of functions."""
    return functions.groupBy("project", column).agg(F.count(F.lit(1)).alias("n_functions"))


def high_complexity(functions: DataFrame) -> DataFrame:
    return functions.where(is_high(F.col("time_complexity")))


def first_high(functions: DataFrame, n: int) -> DataFrame:
    """The first n high functions in the order of the walk."""
    return high_complexity(functions).orderBy("project", "ordinal", "walk_idx").limit(n)


def complexity_totals(functions: DataFrame) -> DataFrame:
    """project, total_functions, average_confidence, high_complexity_count and both distributions. Confidences are a few fixed hundredths: they are
    counted, so that no task holds a project's functions and sums come out alike in any order. The functions are read once: a small table of
    the counts of each project and pair of classes is written, and the rest comes from that."""
    counted = functions.groupBy("project", "time_complexity", "space_complexity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("hundredths"))
    counted = cut(counted, "classes")
    high = F.sum(F.when(is_high(F.col("time_complexity")), F.col("n")).otherwise(F.when(F.col("time_complexity").isNotNull(), 0))).alias("high_complexity_count")
    out = counted.groupBy("project").agg(F.sum("n").alias("total_functions"), F.sum("hundredths").alias("hundredths"), high)
    for column, name in (("time_complexity", "time_complexity_distribution"), ("space_complexity", "space_complexity_distribution")):
        counts = counted.groupBy("project", column).agg(F.sum("n").alias("n_functions")).groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n_functions")))).alias(name))
        out = out.join(counts, "project", "left")
    mean = py_round(F.col("hundredths") / 100 / F.col("total_functions"), 2).alias("average_confidence")
    return out.select("project", "total_functions", mean, "time_complexity_distribution", "space_complexity_distribution", "high_complexity_count")


def complexity_summary(projects: DataFrame, functions: DataFrame) -> DataFrame:
    """One row for each project; the mean adds in the order of the walk, and is null where there is no function."""
    high = F.when(is_high(F.col("time_complexity")), F.struct("ordinal", "walk_idx", "name", F.col("path").alias("file"), "line", F.col("time_complexity").alias("time"), F.col("space_complexity").alias("space"), "confidence", F.col("dominant_operation").alias("dominant_op"), F.slice("reasoning", 1, 3).alias("reasoning")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "walk_idx", "confidence")))
    whole = functions.groupBy("project").agg(F.count(F.lit(1)).alias("total_functions"), F.aggregate(ordered, F.lit(0.0), lambda a, e: a + e["confidence"]).alias("summed"), F.array_sort(F.collect_list(high)).alias("high"))
    out = projects.select("project").join(whole, "project", "left")
    for column, name in (("time_complexity", "time_complexity_distribution"), ("space_complexity", "space_complexity_distribution")):
        counts = distribution(functions, column).groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n_functions")))).alias(name))
        out = out.join(counts, "project", "left")
    shown = F.transform("high", lambda h: h.dropFields("ordinal", "walk_idx"))
    return out.select(
        "project", F.coalesce("total_functions", F.lit(0)).cast("long").alias("total_functions"), py_round(F.col("summed") / F.col("total_functions"), 2).alias("average_confidence"),
        "time_complexity_distribution", "space_complexity_distribution", F.coalesce(F.size("high"), F.lit(0)).cast("long").alias("high_complexity_count"), F.coalesce(shown, F.array()).alias("high_complexity_functions"),
    )
