"""Queries over Python sources that are made from the rows of lineitem, one file each, so that the parser runs on whole tables.

The numbers of a row say what its function is like: decorated or not, typed or not, how deep its loops are nested, whether it sorts, leaves a
loop early, and how often it calls itself. SQL that knows only those numbers says what the analysis must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.operators import complexity as cx
from siltscope.operators import match, score
from siltscope.operators.extract import parse_groups
from siltscope.session import spread
from siltscope.sources.catalog import catalog
from siltscope.sources.listing import files_from

#: The facts of each file, and its text, in SQL that both engines take.
FACTS = """
  SELECT 'p' || (l_suppkey % 10) AS project, l_orderkey * 8 + l_linenumber AS ordinal, 'f' || l_orderkey || '_' || l_linenumber AS name,
    l_partkey % 3 = 0 AS memo, l_partkey % 2 = 0 AS typed, l_suppkey % 5 AS depth, l_partkey % 5 = 0 AS sorts, l_linenumber % 4 = 0 AS leaves,
    greatest(l_orderkey % 7 - 3, 0) AS calls,
    CASE l_orderkey % 6 WHEN 0 THEN 'networkx' WHEN 1 THEN 'redis.client' WHEN 2 THEN 'heapq' WHEN 3 THEN 'django.db.models' ELSE 'os' END AS module
  FROM {lineitem}
"""
_nest = " || ".join(f"CASE WHEN depth >= {i} THEN repeat(' ', {4 * i}) || 'for x{i} in xs:' || chr(10) ELSE '' END" for i in range(1, 5))
TEXT = f"""
  SELECT *, 'import ' || module || chr(10) || CASE WHEN memo THEN '@lru_cache(maxsize=None)' || chr(10) ELSE '' END
    || 'def ' || name || '(xs' || CASE WHEN typed THEN ': list' ELSE '' END || ', n):' || chr(10) || {_nest}
    || repeat(' ', CAST(4 * (depth + 1) AS INT)) || 'y = ' || CASE WHEN sorts THEN 'sorted(xs)' ELSE 'n' END || chr(10)
    || CASE WHEN leaves AND depth > 0 THEN repeat(' ', CAST(4 * (depth + 1) AS INT)) || 'break' || chr(10) ELSE '' END
    || repeat('    ' || name || '(xs, n - 1)' || chr(10), CAST(calls AS INT)) || '    return n' || chr(10) AS content
  FROM facts
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    spread(lineitem).createOrReplaceTempView("siltscope_lineitem")
    made = spark.sql(f"WITH facts AS ({FACTS.format(lineitem='siltscope_lineitem')}) {TEXT}")
    return files_from(made.select("project", "ordinal", F.concat("name", F.lit(".py")).alias("path"), "content"))


def judged(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """members (with the columns `keep`) and what is judged of each function of a group."""
    return cx.judged(parse_groups(sources(spark, sf_dir).where("in_complexity_scope"), list(keep)), "members")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = judged(spark, sf_dir, "project", "ordinal", "path")
    loop = F.transform("loop_analysis", lambda x: F.concat_ws(" ", x["loop_type"], x["iterator_var"], x["iterable_source"], x["estimated_iterations"], x["is_input_dependent"].cast("string"), x["has_early_exit"].cast("string"), x["nested_depth"].cast("string")))
    variable = F.array_sort(F.transform(F.map_values("variables"), lambda v: F.concat_ws(" ", v["name"], v["source"], v["is_input_dependent"].cast("string"))))
    rest = ["line", "time_complexity", "space_complexity", "confidence", "reasoning", "has_recursion", "recursion_type", "uses_memoization", "has_early_exit", "dominant_operation", "loops", "variables"]
    f = f.withColumns({"reasoning": F.array_join("reasoning", "; "), "loops": F.array_join(loop, "; "), "variables": F.array_join(variable, "; ")})
    f = f.select("walk_idx", "name", *rest, F.explode("members").alias("m"))
    return f.select("m.project", "m.ordinal", "m.path", "walk_idx", F.coalesce("name", "m.name").alias("name"), *rest)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = parse_groups(sources(spark, sf_dir), ["project", "ordinal", "path"], functions=False)
    g = g.select("scan_status", "line_count", F.array_join("imports", ",").alias("imports"), F.explode("members").alias("m"))
    return g.select("m.project", "m.ordinal", "m.path", "scan_status", "line_count", "imports")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.file_matches(sources(spark, sf_dir), catalog(spark)).select("project", "ordinal", "path", "category", "pattern", "by_keyword", "by_import")


def rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark)
    sizes, first = match.first_matches(sources(spark, sf_dir), c)
    return score.rate(sizes, sizes, score.pattern_weights(first, c))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = judged(spark, sf_dir, "project").select("time_complexity", "space_complexity", "confidence", F.explode("members").alias("m"))
    out = cx.complexity_totals(f.select("m.project", "time_complexity", "space_complexity", "confidence"))
    return out.select("project", "total_functions", "average_confidence", "high_complexity_count", *[F.to_json(c).alias(c) for c in ("time_complexity_distribution", "space_complexity_distribution")])


_facts = f"facts AS ({FACTS.format(lineitem='lineitem')})"
_kind = "CASE calls WHEN 0 THEN NULL WHEN 1 THEN 'linear' WHEN 2 THEN 'binary' ELSE 'multiple' END"
_truth = lambda c: f"CASE WHEN {c} THEN 'true' ELSE 'false' END"
_loops = " || ".join(f"CASE WHEN depth >= {i} THEN '{'; ' if i > 1 else ''}for x{i} xs n true ' || {_truth('leaves')} || ' {i}' ELSE '' END" for i in range(1, 5))
_vars = "'n parameter true' || '; ' || " + " || ".join(f"CASE WHEN depth >= {i} THEN 'x{i} loop true; ' ELSE '' END" for i in range(1, 5)) + " || 'xs parameter true; y assignment true'"
FUNCTIONS_SQL = f"""SELECT project, ordinal, name || '.py' AS path, 0 AS walk_idx, name, CASE WHEN memo THEN 3 ELSE 2 END AS line,
    CASE WHEN calls > 0 THEN CASE WHEN memo OR calls = 1 THEN 'O(n)' WHEN calls = 2 THEN 'O(2^n)' ELSE 'O(k^n)' END
      WHEN depth = 0 THEN CASE WHEN sorts THEN 'O(n log n)' ELSE 'O(1)' END WHEN depth = 1 THEN CASE WHEN sorts THEN 'O(n log n)' ELSE 'O(n)' END
      WHEN depth = 2 THEN 'O(n²)' WHEN depth = 3 THEN 'O(n³)' ELSE 'O(n^4)' END AS time_complexity,
    CASE WHEN calls > 0 OR sorts THEN 'O(n)' ELSE 'O(1)' END AS space_complexity,
    greatest(0.3::DOUBLE, 0.8::DOUBLE - CASE WHEN calls > 0 AND NOT memo THEN 0.2::DOUBLE ELSE 0::DOUBLE END - CASE WHEN depth > 2 THEN 0.1::DOUBLE ELSE 0::DOUBLE END - CASE WHEN typed THEN 0::DOUBLE ELSE 0.1::DOUBLE END) AS confidence,
    'Parameters: 2 (' || CASE WHEN typed THEN 1 ELSE 0 END || ' typed)' || CASE WHEN memo THEN '; Uses memoization decorator' ELSE '' END || '; ' ||
    CASE WHEN calls > 0 THEN CASE WHEN memo THEN 'Recursive (' || {_kind} || ') with memoization → O(n)' WHEN calls = 1 THEN 'Linear recursion without memoization → O(n)' WHEN calls = 2 THEN 'Binary recursion without memoization → O(2^n)' ELSE 'Multiple recursion (' || calls || ' calls) → O(k^n)' END
      WHEN depth = 0 THEN CASE WHEN sorts THEN 'No loops but uses sorting → O(n log n)' ELSE 'No loops or expensive operations → O(1)' END
      WHEN depth = 1 THEN CASE WHEN sorts THEN 'Single loop + sorting → O(n log n)' WHEN leaves THEN 'Single loop with early exit → O(n) worst case' ELSE 'Single loop over input → O(n)' END
      WHEN depth = 2 THEN 'Nested loops (depth 2) → O(n²)' WHEN depth = 3 THEN 'Triple nested loops → O(n³)' ELSE 'Deep nesting (depth 4) → O(n^4)' END || '; ' ||
    CASE WHEN calls > 0 THEN CASE WHEN memo THEN 'Recursion with memoization → O(n) for cache' ELSE 'Recursion → O(n) call stack' END WHEN sorts THEN 'sorted creates O(n) space' ELSE 'No significant allocations → O(1)' END AS reasoning,
    calls > 0 AS has_recursion, {_kind} AS recursion_type, memo AS uses_memoization, leaves AND depth > 0 AS has_early_exit,
    CASE WHEN calls > 0 THEN 'recursion (' || {_kind} || ')' WHEN depth > 0 THEN 'nested loops (depth ' || depth || ')' WHEN sorts THEN 'sorted' END AS dominant_operation,
    {_loops} AS loops, {_vars} AS variables FROM facts"""


def oracle_sql(catalog_sql: str, scored_sql) -> dict[str, str]:
    """catalog_sql: the catalogue as a common table; scored_sql(w, s): the rating of projects from weights and sizes."""
    texts = f"{_facts}, texts AS ({TEXT})"
    found = f"""{texts}, {catalog_sql}, wanted AS (SELECT category, pattern, lower(unnest(imports)) AS i FROM catalog), words AS (SELECT category, pattern, lower(unnest(keywords)) AS k FROM catalog),
      first_hit AS (SELECT t.project, w.category, w.pattern, min(t.ordinal) AS first FROM facts t, wanted w WHERE contains(lower(t.module), w.i) GROUP BY ALL),
      hits AS (SELECT project, ordinal, name || '.py' AS path, category, pattern, true AS k, false AS i FROM texts, words WHERE contains(lower(content), words.k)
        UNION ALL SELECT t.project, t.ordinal, t.name || '.py', h.category, h.pattern, false, true FROM texts t JOIN first_hit h ON t.project = h.project AND t.ordinal >= h.first),
      matches AS (SELECT project, ordinal, path, category, pattern, bool_or(k) AS by_keyword, bool_or(i) AS by_import FROM hits GROUP BY ALL)"""
    lines = "length(content) - length(replace(content, chr(10), ''))"
    functions_ = f"{_facts}, functions AS ({FUNCTIONS_SQL})"
    spread_ = lambda c: f"(SELECT project, '{{' || string_agg('\"' || {c} || '\":' || n, ',' ORDER BY {c}) || '}}' AS d FROM (SELECT project, {c}, count(*) AS n FROM functions GROUP BY ALL) GROUP BY project)"
    return {
        "parsed_functions": f"WITH {_facts} {FUNCTIONS_SQL}",
        "parsed_files": f"WITH {texts} SELECT project, ordinal, name || '.py' AS path, 'ok' AS scan_status, ({lines})::BIGINT AS line_count, module AS imports FROM texts",
        "parsed_matches": f"WITH {found} SELECT project, ordinal, path, category, pattern, by_keyword, by_import FROM matches",
        "parsed_rating": f"WITH {found}, sizes AS (SELECT project, count(*) AS files_scanned, sum({lines})::BIGINT AS total_lines FROM texts GROUP BY project), found AS (SELECT DISTINCT project, category, pattern FROM matches), {scored_sql}",
        "parsed_summary": f"""WITH {functions_} SELECT project, count(*) AS total_functions, format('{{:.2f}}', sum(round(confidence * 100)) / 100 / count(*))::DOUBLE AS average_confidence,
          count(CASE WHEN contains(time_complexity, 'n²') OR contains(time_complexity, 'n³') OR contains(time_complexity, 'n^') OR contains(time_complexity, '2^n') OR contains(time_complexity, 'k^n') THEN 1 END) AS high_complexity_count,
          any_value(t.d) AS time_complexity_distribution, any_value(s.d) AS space_complexity_distribution FROM functions JOIN {spread_('time_complexity')} t USING (project) JOIN {spread_('space_complexity')} s USING (project) GROUP BY project""",
    }


QUERIES = {"parsed_functions": functions, "parsed_files": files, "parsed_matches": matches, "parsed_rating": rating, "parsed_summary": summary}
