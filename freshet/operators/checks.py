"""Checks on records, clocks, documents and model text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Patterns of a version upgrade in a message, case ignored, with the issue that each stands for; signs of a
# run that never ran.
UPGRADE = (
    ("DSS file.*version", "DSS file version incompatibility"),
    ("Unknown.*method", "Unknown method - may need parameter update"),
    ("deprecated", "Deprecated feature"),
    ("not.*supported", "Feature not supported in this version"),
    ("cannot.*open.*project", "Project file format incompatibility"),
    ("unable.*load", "Unable to load component - format change"),
)
FATAL = ("Exit status = 1", "Exit code 1", "Error opening project", "Error during computation")


def gaps(records: DataFrame, keys: list[str], step: str | None = None) -> DataFrame:
    """records(keys, start, end) that do not begin where the one before ended, or do not last ``step``."""
    before = F.lag("end").over(W.partitionBy(*keys).orderBy("start"))
    rows = records.withColumn("previous_end", before)
    bad = F.col("previous_end").isNotNull() & (F.col("previous_end") != F.col("start"))
    if step:
        bad = bad | (F.col("start") + F.expr(f"interval {step}") != F.col("end"))
    return rows.where(bad)


def wall_clock(df: DataFrame, keys: list[str], zone: str) -> DataFrame:
    """keys, nonexistent, ambiguous, offsets: naive local stamps that a zone skips or has twice, and how many offsets it takes."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col("ts"))
    back = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
    rows = df.withColumn("_u", utc)
    hour = F.expr("interval 1 hour")
    twice = (back(F.col("_u") + hour) == F.col("ts")) | (back(F.col("_u") - hour) == F.col("ts"))
    exists = back(F.col("_u")) == F.col("ts")
    return rows.groupBy(*keys).agg(F.count_if(~exists).alias("nonexistent"), F.count_if(exists & twice).alias("ambiguous"), F.countDistinct(F.timestamp_diff("MINUTE", "_u", "ts")).alias("offsets"))


def translate_window(df: DataFrame, keys: list[str], source_start: str, target_start: str, steps: int, minutes: int) -> DataFrame:
    """The samples of a window moved to another start; value is null where the source lacks a stamp."""
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (source_start, target_start))
    i = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")
    want = df.select(*keys).distinct().select(*keys, i).withColumn("ts", F.timestamp_add("MINUTE", F.col("i") * minutes, a))
    return want.join(df.select(*keys, "ts", "value"), [*keys, "ts"], "left").select(*keys, F.timestamp_add("MINUTE", F.col("i") * minutes, b).alias("ts"), "value")


def block_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, name, k, old, new, status) of two sets of blocks: changed, added or removed attributes; numbers compare as numbers."""
    flat = lambda d, v: d.select("kind", "name", F.explode("attrs").alias("k", v))
    both = flat(a, "old").join(flat(b, "new"), ["kind", "name", "k"], "full")
    same = F.coalesce(F.expr("try_cast(old as double) = try_cast(new as double)"), F.col("old") == F.col("new"))
    return both.withColumn("status", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~same, "changed")).where("status is not null")


def upgrade_issues(msgs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, issues: those of UPGRADE that some message matches, in its order; keys without one are left out."""
    hits = [F.max(F.col("message").rlike(f"(?i){p}")) for p, _ in UPGRADE]
    issues = F.array_compact(F.array(*[F.when(h, F.lit(what)) for h, (_, what) in zip(hits, UPGRADE)]))
    return msgs.groupBy(*keys).agg(issues.alias("issues")).where(F.size("issues") > 0)


def fatal(line: Column) -> Column:
    out = F.lit(False)
    for sign in FATAL:
        out = out | F.contains(line, F.lit(sign))
    return out


# Lines that report an error, the end of a run, and the end of a script with their codes.
ERROR_LINE = r"^ERROR\s+\d+:\s+.+$"
RUN_END = r"^End .+;\s+Exit status\s*=\s*(\d+)$"
SCRIPT_END = r'NOTE 12573:\s+End script\s+"[^"]+";\s+Exit code\s+(\d+)'


def fatal_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, errors, exit_code, fatal of each run's lines(keys, pos, line): fatal with an error line, a code other than 0 or a
    line that ``fatal`` names. The code is that of the first end of a run, else of a script, else -1, which is no failure."""
    code = lambda pattern: F.min(F.when(F.col("line").rlike(pattern), F.struct("pos", F.regexp_extract("line", pattern, 1).cast("int").alias("code"))))["code"]
    out = lines.groupBy(*keys).agg(F.count_if(F.col("line").rlike(ERROR_LINE)).alias("errors"), F.coalesce(code(RUN_END), code(SCRIPT_END), F.lit(-1)).alias("exit_code"), F.max(F.coalesce(fatal(F.col("line")), F.lit(False))).alias("_f"))
    return out.select(*keys, "errors", "exit_code", ((F.col("errors") > 0) | ~F.col("exit_code").isin(0, -1) | F.col("_f")).alias("fatal"))


def closed_keys(documents: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """missing and unknown top-level keys of a JSON object column, and repeated, whether a key occurs twice; null JSON misses all."""
    keys = F.coalesce(F.json_object_keys(column), F.expr("cast(array() as array<string>)"))
    want = F.array(*[F.lit(k) for k in wanted])
    return documents.withColumn("missing", F.array_except(want, keys)).withColumn("unknown", F.array_except(keys, want)).withColumn("repeated", F.size(keys) != F.size(F.array_distinct(keys)))


def content_digest(df: DataFrame, keys: list[str], columns: list[str], digits: int = 3) -> DataFrame:
    """sha256 of each key's rows as canonical lines, in whatever order they come, and their number.

    Lines are dealt to 16 ** ``digits`` chunks by the first digits of their md5; a chunk's sorted lines have a digest, and
    the key's digest is that of the sorted 'chunk:digest' list, so a key with most rows is never gathered in one place.
    """
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.select(*keys, line.alias("_l")).withColumn("_c", F.substring(F.md5(F.col("_l").cast("binary")), 1, digits))
    sha = lambda c, sep: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), sep).cast("binary"), 256)
    chunks = rows.groupBy(*keys, "_c").agg(sha("_l", "\n").alias("_s"), F.count("*").alias("_n"))
    return chunks.select(*keys, F.concat_ws(":", "_c", "_s").alias("_d"), "_n").groupBy(*keys).agg(sha("_d", ",").alias("sha256"), F.sum("_n").alias("n"))
