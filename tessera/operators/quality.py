"""Rules that find code smells, and findings merged into scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Penalty of each severity (fixed values).
PENALTIES = {"critical": 25, "high": 10, "medium": 4, "low": 1}


def finding(rule: str, severity: str, subject: Column, measure: Column) -> list[Column]:
    """The columns every finding has."""
    return [F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"), measure.cast("long").alias("measure")]


# Lines of a function, methods and lines of a class, lines of a file, imports of a file above which they smell.
LONG_FUNCTION, MANY_METHODS, LARGE_CLASS, LARGE_FILE, FAN_OUT = 80, 15, 500, 400, 10
#: A line that is nested deeper than four levels.
DEEP = r"(?m)^[ \t]{16,}\S"


def smells(chunks: DataFrame, spans: DataFrame, methods: DataFrame, cyclic: DataFrame | None = None) -> DataFrame:
    """(rule, severity, subject, measure): all smells in one union.

    chunks has file_id, line_end, imports (array of struct with source) and deep (whether a line is deeply nested), one row
    per chunk; spans has file_id, name, kind, first and last, one row per symbol; methods has file_id and qualified; cyclic
    the files on import cycles. Null names and lines never count. Imports count once per file, since every chunk of a
    file carries all of them.
    """
    length = F.col("last") - F.col("first")
    name = F.concat_ws(":", "file_id", "name")
    long_functions = spans.where(F.col("kind").isin("function", "method") & (length > LONG_FUNCTION)).select(*finding("long_function", "high", name, length))
    wide_classes = spans.where((F.col("kind") == "class") & (length > LARGE_CLASS)).select(*finding("god_class", "critical", name, length))
    owner = F.substring_index("qualified", ".", 1)
    by_class = methods.where(F.contains("qualified", F.lit("."))).groupBy("file_id", owner.alias("owner")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_METHODS)
    many_methods = by_class.select(*finding("many_methods", "critical", F.concat_ws(":", "file_id", "owner"), F.col("n")))
    files = chunks.groupBy("file_id").agg(F.max("line_end").alias("lines"), F.max(F.size(F.array_distinct("imports.source"))).alias("imports"), F.count_if("deep").alias("deep"))
    large = files.where(F.col("lines") > LARGE_FILE).select(*finding("large_file", "medium", F.col("file_id"), F.col("lines")))
    fan_out = files.where(F.col("imports") > FAN_OUT).select(*finding("fan_out", "medium", F.col("file_id"), F.col("imports")))
    nested = files.where("deep > 0").select(*finding("deep_nesting", "medium", F.col("file_id"), F.col("deep")))
    out = long_functions
    for part in (wide_classes, many_methods, large, fan_out, nested):
        out = out.unionByName(part)
    return out if cyclic is None else out.unionByName(cyclic.select(*finding("import_cycle", "critical", F.col("file"), F.lit(1))))


def merged(first: DataFrame, second: DataFrame, key: list[str], cap: int, by: str) -> DataFrame:
    """Findings of two sources, one per ``key`` with those of ``first`` winning, at most ``cap`` per value of ``by``."""
    both = first.withColumn("origin", F.lit(0)).unionByName(second.withColumn("origin", F.lit(1)))
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("origin", F.desc("measure")))).where("rn = 1").drop("rn")
    return best.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy("origin", F.desc("measure"), *key))).where(F.col("rn") <= cap).drop("rn")


def score(findings: DataFrame, by: str) -> DataFrame:
    """(by, n, score, recommendation): 100 less penalties, not below 0."""
    penalty = F.lit(0)
    for severity, points in PENALTIES.items():
        penalty = F.when(F.col("severity") == severity, points).otherwise(penalty)
    sums = findings.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.sum(penalty))).cast("long").alias("score"), F.count_if(F.col("severity") == "critical").alias("critical"))
    advice = F.when((F.col("critical") > 0) | (F.col("score") < 55), "request_changes").when(F.col("score") >= 85, "approve").otherwise("comment")
    return sums.withColumn("recommendation", advice).drop("critical")
