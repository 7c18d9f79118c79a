"""Compute logs: messages, counts, outcome, and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codes of a finished run, exit codes that count as success, the line of a project's version change.
FINISHED = (10185, 15302)
GOOD_EXIT = (0, -1)
UPDATED = r'WARNING 10021:\s+Project "([^"]+)" was updated from Version ([\d.]+) to Version ([\d.]+)'
PATTERN = r"^\s*(NOTE|WARNING|ERROR)\s+(\d+):\s*(.*)$"


def messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """type, code, message of the lines that are messages; other columns stay."""
    get = lambda i: F.regexp_extract(line, PATTERN, i)
    return lines.withColumn("type", get(1)).withColumn("code", get(2).try_cast("int")).withColumn("message", get(3)).where("type <> ''")


def outcome(msgs: DataFrame, keys: list[str], exit_code: str | None = None) -> DataFrame:
    """Counts by type and success: a finishing code, no errors, and an exit code that is good (if there is one)."""
    of = lambda t: F.count_if(F.col("type") == t)
    out = msgs.groupBy(*keys).agg(of("NOTE").alias("notes"), of("WARNING").alias("warnings"), of("ERROR").alias("errors"), F.bool_or(F.col("code").isin(*FINISHED)).alias("finished"), *([F.max(exit_code).alias("exit_code")] if exit_code else []))
    good = F.col("finished") & (F.col("errors") == 0)
    return out.withColumn("success", good & F.col("exit_code").isin(*GOOD_EXIT) if exit_code else good)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(type, code, message, change): messages only in one of two runs, resolved or new."""
    cols = ["type", "code", "message"]
    a, b = old.select(*cols).distinct(), new.select(*cols).distinct()
    return a.exceptAll(b).withColumn("change", F.lit("resolved")).union(b.exceptAll(a).withColumn("change", F.lit("new")))


def version_changes(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """keys, project, from_version, to_version of each key's first line, by pos, that reports a version change; other keys
    have no row."""
    hits = lines.where(F.col(line).rlike(UPDATED))
    first = hits.groupBy(*keys).agg(F.min_by(line, "pos").alias("_l"))
    return first.select(*keys, *[F.regexp_extract("_l", UPDATED, i).alias(c) for i, c in enumerate(("project", "from_version", "to_version"), 1)])
