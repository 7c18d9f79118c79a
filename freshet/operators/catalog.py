"""Pathname catalogs: /A/B/C/D/E/F/ parsed, filtered and chosen from, in catalog order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PARTS = ("a", "b", "c", "d", "e", "f")

# Result types and the C part of the pathname that each stands for, as a regular expression.
RESULT_TYPES = {
    "flow": "FLOW[^/]*", "flow-total": "FLOW", "flow-observed": "FLOW-OBSERVED", "flow-direct": "FLOW-DIRECT", "flow-base": "FLOW-BASE", "flow-combine": "FLOW-COMBINE",
    "precipitation": "PRECIP[^/]*", "precip-inc": "PRECIP-INC", "precip-cum": "PRECIP-CUM", "precip-excess": "PRECIP-EXCESS", "precip-loss": "PRECIP-LOSS",
    "stage": "STAGE", "storage": "STORAGE[^/]*", "storage-gw": "STORAGE-GW", "storage-soil": "STORAGE-SOIL", "elevation": "ELEV",
    "outflow": "OUTFLOW[^/]*", "inflow": "INFLOW[^/]*", "excess": "EXCESS[^/]*", "baseflow": "BASEFLOW", "infiltration": "INFILTRATION", "et": "ET[^/]*",
}


def parse(df: DataFrame, path: str = "path") -> DataFrame:
    """Columns a to f and run_name (F without a leading RUN:, in either case); a missing part is ''."""
    inner = F.regexp_replace(F.regexp_replace(F.col(path), "^/", ""), "/$", "")
    parts = F.split(inner, "/", -1)
    get = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return df.withColumns({p: get(i) for i, p in enumerate(PARTS)}).withColumn("run_name", F.regexp_replace("f", "(?i)^RUN:", ""))


def build(a: Column, b: Column, c: Column, d: Column, e: Column, run: Column) -> Column:
    return F.concat(F.lit("/"), a, F.lit("/"), b, F.lit("/"), c, F.lit("/"), d, F.lit("/"), e, F.lit("/RUN:"), run, F.lit("/"))


def filter_catalog(df: DataFrame, pattern: str | None = None, data_type: str | None = None, element: str | None = None, run: str | None = None, exact_run: bool = False) -> DataFrame:
    """Rows of a parsed catalog: regex anywhere in the path, C and B containing a text, run equal or containing; case ignored."""
    out = df
    if pattern is not None:
        out = out.where(F.col("path").rlike(f"(?i){pattern}"))
    for column, text in (("c", data_type), ("b", element)):
        if text is not None:
            out = out.where(F.contains(F.upper(column), F.lit(text.upper())))
    if run is not None:
        name = F.upper("run_name")
        out = out.where(name == run.upper() if exact_run else F.contains(name, F.lit(run.upper())))
    return out


def is_table() -> Column:
    """Whether a part of the path is TABLE."""
    return F.array_contains(F.transform(F.split("path", "/"), F.upper), "TABLE")


def matches_type(kind: str) -> Column:
    """Whether the path is of the result type, case ignored; an unknown type fits all, flow-total is C = FLOW exactly."""
    key = kind.lower()
    if key == "flow-total":
        return F.upper("c") == RESULT_TYPES[key]
    return F.col("path").rlike(f"(?i)/{RESULT_TYPES[key]}/") if key in RESULT_TYPES else F.lit(True)


def select_results(df: DataFrame, kind: str = "flow", elements: list[str] | None = None, run: str | None = None, exclude_tables: bool = True) -> DataFrame:
    """Paths of a parsed catalog by type, elements and run (equal, case ignored); ordinal keeps catalog order."""
    out = df.where(matches_type(kind))
    if exclude_tables:
        out = out.where(~is_table())
    if elements:
        out = out.where(F.upper("b").isin([str(x).upper() for x in elements]))
    return out if run is None else out.where(F.upper("run_name") == run.upper())


def prefer_interval_precip(df: DataFrame) -> DataFrame:
    """One path for each element and run (case ignored): PRECIP-INC before PRECIP, then the first; other C parts never."""
    rank = F.when(F.upper("c") == "PRECIP-INC", 0).when(F.upper("c") == "PRECIP", 1)
    w = W.partitionBy(F.upper("b"), F.upper("run_name")).orderBy(rank, "ordinal")
    return df.where(rank.isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_elements(df: DataFrame) -> DataFrame:
    """Element names, first spelling of each without regard to case, with its ordinal."""
    return df.where("b <> ''").groupBy(F.upper("b").alias("_u")).agg(F.min_by("b", "ordinal").alias("element"), F.min("ordinal").alias("ordinal")).drop("_u")


def by_element(df: DataFrame) -> DataFrame:
    """Paths of each element, spelling kept apart, in catalog order."""
    return df.groupBy(F.col("b").alias("element")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "path"))), lambda x: x["path"]).alias("paths"))


def one_match(df: DataFrame, keys: list[str], which: str = "last") -> DataFrame:
    """The first or last catalog match of each key."""
    order = F.desc("ordinal") if which == "last" else F.asc("ordinal")
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def statistics(df: DataFrame, group: str, top: int = 3) -> DataFrame:
    """The ``top`` most frequent values of a column, ties by name."""
    return df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(top)


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, n_distinct): rows with a value and different values of each column, one pass for all of them."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("z")).select("z.*")
    return long.groupBy("name", "v").agg(F.count("v").alias("n")).groupBy("name").agg(F.sum("n").alias("n"), F.count("v").alias("n_distinct"))
