"""Which files show which patterns, by keyword or by import.

The catalogue is the small side of both theta joins: its size is fixed by its author, not by the data, and it is broadcast. A file
counts as importing what it or any earlier file of its project imports; that running union is the least ordinal with a hit for
each project and pattern, so no window over files is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltscope.operators.extract import parse_groups
from siltscope.session import cut

KEY = ["category", "pattern", "pattern_ord"]


def keyword_matches(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """project, ordinal, path and the pattern's columns, once for each file and pattern. files: text_lc is the lower-case text.

    A file meets each pattern once, and the pattern's keywords are tried until one is found: no row comes twice, and nothing is shuffled.
    """
    words = F.broadcast(catalog.select(*KEY, F.transform("keywords", F.lower).alias("ks")))
    return files.select("project", "ordinal", "path", "text_lc").join(words, F.exists("ks", lambda k: F.contains("text_lc", k))).select("project", "ordinal", "path", *KEY)


def import_hits(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """project, ordinal and the pattern's columns, where the file itself imports what the pattern names."""
    names = F.broadcast(catalog.select(*KEY, F.explode("imports").alias("i")).select(*KEY, F.lower("i").alias("i")))
    found = files.select("project", "ordinal", F.explode("imports").alias("name")).select("project", "ordinal", F.lower("name").alias("name"))
    return found.join(names, F.col("name").contains(F.col("i"))).select("project", "ordinal", *KEY).distinct()


def import_matches(files: DataFrame, catalog: DataFrame, scope: str = "cumulative") -> DataFrame:
    """project, ordinal, path and the pattern's columns. scope: "cumulative", or "file" for a file's own imports only."""
    hits, all_files = import_hits(files, catalog), files.select("project", "ordinal", "path")
    if scope == "file":
        return all_files.join(hits, ["project", "ordinal"]).select("project", "ordinal", "path", *KEY)
    first = hits.groupBy("project", *KEY).agg(F.min("ordinal").alias("first_hit"))
    return all_files.join(first, "project").where("ordinal >= first_hit").select("project", "ordinal", "path", *KEY)


def pattern_matches(files: DataFrame, catalog: DataFrame, import_scope: str = "cumulative") -> DataFrame:
    """A row for each file and pattern: by_keyword, by_import. Files that could not be read, or whose parse was given up, have none."""
    read = files.where(~F.col("scan_status").isin("unreadable", "aborted"))
    marked = lambda df, k, i: df.withColumns({"by_keyword": F.lit(k), "by_import": F.lit(i)})
    both = marked(keyword_matches(read, catalog), True, False).unionByName(marked(import_matches(read, catalog, import_scope), False, True))
    return both.groupBy("project", *KEY, "ordinal", "path").agg(F.max("by_keyword").alias("by_keyword"), F.max("by_import").alias("by_import"))


def patterns_of(catalog: DataFrame) -> list[tuple[tuple, list[str], list[str]]]:
    """(the pattern's columns, lower-case keywords, lower-case imports) of each pattern, which has the lists of all its rows. The author of the
    catalogue fixes its size, so it comes to the driver."""
    out: dict[tuple, tuple[list[str], list[str]]] = {}
    for r in catalog.select(*KEY, F.transform("keywords", F.lower).alias("keywords"), F.transform("imports", F.lower).alias("imports")).collect():
        keywords, imports = out.setdefault(tuple(r[:3]), ([], []))
        keywords += [w for w in r.keywords or [] if w is not None]
        imports += [i for i in r.imports or [] if i is not None]
    return [(k, *v) for k, v in out.items()]


def matched_groups(files: DataFrame, patterns: list, keep: list[str]) -> DataFrame:
    """parse_groups, with the places in `patterns` of what files show by keyword and import."""
    return parse_groups(files, keep, functions=False, words=[w for _, w, _ in patterns], names=[i for _, _, i in patterns])


READ = "scan_status NOT IN ('unreadable', 'aborted')"
#: Places of patterns in one long.
BITS = 32


def as_bits(places: str, word: int) -> Column:
    """The word of that number, with a bit for each of the places in it."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k % BITS)
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, k: F.when(F.floor(k / BITS) == word, a.bitwiseOR(bit(k))).otherwise(a))


def file_matches(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """pattern_matches of files that are not parsed yet, with imports that reach later files. Each file is parsed once.

    A file's patterns are the bits of a few longs, so a file is one row of the only shuffle, which unites files of one project, ordinal and path.
    The groups are written: the first import of each pattern in a project comes from them before the files do.
    """
    patterns, spark = patterns_of(catalog), files.sparkSession
    groups = cut(matched_groups(files, patterns, ["project", "ordinal", "path"]).where(READ).select("by_keyword", "by_import", "members"), "groups")
    hits = groups.where(F.size("by_import") > 0).select("by_import", F.explode("members").alias("m")).select(F.col("m.project").alias("project"), F.col("m.ordinal").alias("ordinal"), F.explode("by_import").alias("k"))
    first = hits.groupBy("project", "k").agg(F.min("ordinal").alias("first")).groupBy("project").agg(F.array(*[F.min(F.when(F.col("k") == k, F.col("first"))) for k in range(len(patterns))]).alias("first"))
    words = range(max(1, -(-len(patterns) // BITS)))
    bits = [as_bits("by_keyword", w).alias(f"bits{w}") for w in words]
    x = groups.select(*bits, F.explode("members").alias("m")).groupBy(F.col("m.project").alias("project"), F.col("m.ordinal").alias("ordinal"), F.col("m.path").alias("path")).agg(*[F.bit_or(f"bits{w}").alias(f"bits{w}") for w in words])
    x = x.join(cut(first, "first"), "project", "left")
    rows = F.broadcast(spark.createDataFrame([(*key, k) for k, (key, _, _) in enumerate(patterns)], "category string, pattern string, pattern_ord int, k int"))
    word = F.lit(None).cast("long")
    for w in words:
        word = F.when(F.floor(F.col("k") / BITS) == w, F.col(f"bits{w}")).otherwise(word)
    by_keyword = F.call_function("getbit", word, F.col("k") % BITS) == 1
    by_import = F.coalesce(F.col("ordinal") >= F.get("first", F.col("k")), F.lit(False))
    out = x.join(rows, by_keyword | by_import)
    return out.select("project", *KEY, "ordinal", "path", by_keyword.alias("by_keyword"), by_import.alias("by_import"))


def first_matches(files: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """score.project_sizes, and project, category, pattern, ordinal of the first file of each pattern in a project, from one parse of the files.
    The first file that an import reaches is the one that has it."""
    patterns, spark = patterns_of(catalog), files.sparkSession
    kept = F.when(F.expr(READ), F.concat(F.array(F.lit(-1)), F.transform("by_keyword", lambda k: 2 * k), F.transform("by_import", lambda k: 2 * k + 1))).otherwise(F.array(F.lit(-1)))
    groups = matched_groups(files, patterns, ["project", "ordinal"]).where("scan_status <> 'unreadable'").select("line_count", kept.alias("kept"), F.explode("members").alias("m"))
    x = groups.select("m.project", "m.ordinal", "line_count", F.explode("kept").alias("k")).groupBy("project", "k").agg(F.count(F.lit(1)).alias("files_scanned"), F.sum("line_count").alias("total_lines"), F.min("ordinal").alias("ordinal"))
    x = cut(x, "first")
    rows = F.broadcast(spark.createDataFrame([(*key, k) for k, (key, _, _) in enumerate(patterns)], "category string, pattern string, pattern_ord int, p int"))
    found = x.where("k >= 0 AND (k % 2 = 0 OR project IS NOT NULL AND ordinal IS NOT NULL)").join(rows, F.floor(F.col("k") / 2) == F.col("p")).select("project", *KEY, "ordinal")
    return x.where("k = -1").select("project", "files_scanned", "total_lines"), found


def ranked_files(matches: DataFrame, first: int | None = None) -> DataFrame:
    """project, the pattern's columns, position (from 1, in the order of the walk), path: a pattern's files as rows, or its first few.

    Rows are ranked where they lie sorted, so no list is held in memory; with `first`, each task passes on that many of a pattern at most.
    """
    place = F.row_number().over(Window.partitionBy("project", *KEY).orderBy("ordinal", "path"))
    out = matches.select("project", *KEY, "ordinal", "path").withColumn("position", place)
    out = out if first is None else out.where(F.col("position") <= first)
    return out.select("project", *KEY, "position", "path")


def pattern_totals(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """project, category, pattern, first_ordinal, pattern_ord, n_files, description."""
    out = matches.groupBy("project", *KEY).agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n_files"))
    return out.join(F.broadcast(catalog.select("category", "pattern", "description")), ["category", "pattern"])


def pattern_files(matches: DataFrame, catalog: DataFrame, first: int | None = None) -> DataFrame:
    """pattern_totals and files, a list in the order of the walk (the first few if asked): for reports of a project, which show it whole."""
    places = F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"])
    lists = ranked_files(matches, first).groupBy("project", "category", "pattern").agg(places.alias("files"))
    return pattern_totals(matches, catalog).join(lists, ["project", "category", "pattern"])
