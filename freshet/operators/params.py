"""Project views and parameter tables: lookups, upserts, exports, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys of an element's text block, and the typed columns they become.
SUBBASIN = {
    "area": ("Area", "double"), "downstream": ("Downstream", "string"),
    "loss_method": ("LossRate", "string"), "initial_deficit": ("Initial Deficit", "double"), "maximum_deficit": ("Maximum Deficit", "double"), "constant_rate": ("Constant Rate", "double"),
    "percolation_rate": ("Percolation Rate", "double"), "percent_impervious": ("Percent Impervious Area", "double"), "curve_number": ("Curve Number", "double"), "initial_abstraction": ("Initial Abstraction", "double"),
    "transform_method": ("Transform", "string"), "time_of_concentration": ("Time of Concentration", "double"), "storage_coefficient": ("Storage Coefficient", "double"), "lag_time": ("Lag Time", "double"),
    "snyder_tp": ("Snyder Tp", "double"), "snyder_cp": ("Snyder Cp", "double"),
    "baseflow_method": ("Baseflow", "string"), "recession_factor": ("Recession Factor", "double"), "initial_discharge": ("Initial Discharge", "double"), "gw1_initial": ("GW 1 Initial", "double"), "gw1_coefficient": ("GW 1 Coefficient", "double"),
    "canvas_x": ("Canvas X", "double"), "canvas_y": ("Canvas Y", "double"),
    "lag": ("Lag", "double"), "divert_to": ("Divert To", "string"),
}


# Keys of a frequency storm's parameters and the typed columns they become; yes stands for true.
FREQUENCY = {
    "exceedance_frequency": ("Exceedance Frequency", "double"), "storm_size": ("Storm Size", "double"), "total_duration": ("Total Duration", "int"), "time_interval": ("Time Interval", "int"),
    "peak_position": ("Percent of Duration Before Peak Rainfall", "int"), "convert_from_annual": ("Convert From Annual Series", "boolean"), "convert_to_annual": ("Convert to Annual Series", "boolean"),
    "storm_type": ("Storm Type", "string"), "depth_area_reduction_method": ("Depth-Area Reduction Method", "string"), "uniform_depth_duration_curve": ("Uniform Depth Duration Curve", "boolean"),
    "single_hypothetical_storm_size": ("Single Hypothetical Storm Size", "boolean"), "user_specified_storm_area": ("User Specified Storm Area", "boolean"),
}


def frequency_parameters(blocks: DataFrame) -> DataFrame:
    """file, method, the columns of FREQUENCY and depths (in order) of met blocks 'Precip Method Parameters'.

    The first key may be spelt Exceedence too. Blank settings are null, but the two annual series ones false.
    """
    own = blocks.where("kind = 'Precip Method Parameters'")
    get = lambda k: F.nullif(F.element_at("attrs", F.lit(k)), F.lit(""))
    as_type = {"boolean": lambda v: F.lower(v) == "yes", "string": lambda v: v}
    out = {c: as_type.get(t, lambda v, t=t: v.try_cast(t))(get(k)) for c, (k, t) in FREQUENCY.items()}
    out["exceedance_frequency"] = F.coalesce(out["exceedance_frequency"], get("Exceedence Frequency").try_cast("double"))
    for c in ("convert_from_annual", "convert_to_annual"):
        out[c] = F.coalesce(out[c], F.lit(False))
    depths = F.transform(F.filter("lines", lambda x: (x["k"] == "Depth") & x["v"].try_cast("double").isNotNull()), lambda x: x["v"].cast("double"))
    return own.select("file", F.col("name").alias("method"), *[v.alias(c) for c, v in out.items()], depths.alias("depths"))


def typed(blocks: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Blocks with attribute keys as typed columns; text that is no number gives null."""
    return blocks.withColumns({c: F.expr(f"try_cast(element_at(attrs, '{k}') as {t})") for c, (k, t) in columns.items()})


def elements(blocks: DataFrame) -> DataFrame:
    return typed(blocks, SUBBASIN)


def subbasin_detail(blocks: DataFrame) -> DataFrame:
    """file, name and the 23 detail columns of each subbasin block; a block may name its loss method by LossRate or Loss."""
    own = elements(blocks.where("kind = 'Subbasin'")).withColumn("loss_method", F.coalesce("loss_method", F.element_at("attrs", F.lit("Loss"))))
    return own.select("file", "name", *[c for c in SUBBASIN if c not in ("lag", "divert_to")])


def with_geometry(geometry: DataFrame, parameters: DataFrame, key: str) -> DataFrame:
    """Rows of geometry with the parameters of their key; a parameter column that geometry has already is left out."""
    held = {c.lower() for c in geometry.columns}
    return geometry.join(parameters.select(key, *[c for c in parameters.columns if c.lower() not in held]), key, "left")


def gages(df: DataFrame, gage_type: str | None = None, dss_file: str | None = None) -> DataFrame:
    """gages(gage, gage_type, dss_file, path) of a type and of a file, case ignored; all with neither."""
    for column, value in (("gage_type", gage_type), ("dss_file", dss_file)):
        if value is not None:
            df = df.where(F.lower(column) == value.lower())
    return df


def folded_order(df: DataFrame, column: str) -> DataFrame:
    """Rows ordered by a name without regard to case, equal names by their spelling."""
    return df.orderBy(F.lower(column), column)


def basin_summary(blocks: DataFrame, keys: list[str] = ["file"]) -> DataFrame:
    """Element counts, true and unanchored area totals, and the distinct methods of each basin file.

    total_area_compat also adds the values of keys that merely end in 'Area'.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    e = elements(blocks).withColumn("_any", F.aggregate(F.map_values(F.map_filter("attrs", lambda k, v: k.rlike("Area$"))), F.lit(0.0), lambda a, v: a + F.coalesce(F.regexp_extract(v, r"^([\d.]+)", 1).try_cast("double"), F.lit(0.0))))
    method = lambda c: F.concat_ws(", ", F.array_sort(F.collect_set(c)))
    return e.groupBy(*keys).agg(
        of("Subbasin").alias("n_subbasins"), of("Reach").alias("n_reaches"), of("Junction").alias("n_junctions"), of("Reservoir").alias("n_reservoirs"), of("Diversion").alias("n_diversions"),
        of("Source").alias("n_sources"), of("Sink").alias("n_sinks"), F.sum(F.when(F.col("kind") == "Subbasin", F.col("area"))).alias("total_area"), F.sum("_any").alias("total_area_compat"),
        method("loss_method").alias("loss_methods"), method("transform_method").alias("transform_methods"), method("baseflow_method").alias("baseflow_methods"),
    )


def configuration(runs: DataFrame, basins: DataFrame, mets: DataFrame, controls: DataFrame) -> DataFrame:
    """Each run with what its basin, met and control are; unknown names leave nulls."""
    return runs.join(basins, "basin", "left").join(mets, "met", "left").join(controls, "control", "left")


def known_components(runs: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """Runs whose component exists (semi join)."""
    return runs.join(known.select(F.col(name).alias(column)).distinct(), column, "left_semi")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], value: str = "value", insert: bool = False) -> DataFrame:
    """keys, old, value, status: updated, unchanged, kept, inserted, absent.

    Only non-null changes count; equal numbers (or equal texts) are unchanged. A key that the current table
    lacks is inserted with ``insert``, else reported as absent.
    """
    new = changes.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_asked"))
    old = current.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_had"))
    both = old.join(new, keys, "full")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    same = F.coalesce(number("old") == number("_new"), F.col("old").cast("string") == F.col("_new").cast("string"))
    status = F.when(F.col("_asked").isNull(), "kept").when(F.col("_had").isNull(), "inserted" if insert else "absent").when(same, "unchanged").otherwise("updated")
    return both.withColumn("status", status).select(*keys, "old", F.when(F.col("status").isin("updated", "inserted"), F.col("_new")).otherwise(F.col("old")).alias(value), "status")


def export(frames: list[DataFrame]) -> DataFrame:
    """One table of frames with different columns, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_files(columns: list[DataFrame]) -> DataFrame:
    """Sorted distinct file references of several one-column tables."""
    return reduce(lambda a, b: a.union(b), columns).distinct().orderBy(columns[0].columns[0])


def method_sets(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Distinct methods of comma-separated lists, sorted."""
    return df.select(*keys, F.explode(F.split(column, ",")).alias("m")).withColumn("m", F.trim("m")).where("m <> ''").groupBy(*keys).agg(F.concat_ws(", ", F.array_sort(F.collect_set("m"))).alias("methods"))


def percent_change(old: DataFrame, new: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Change by position in percent; from 0 it is 0 when nothing changed, else infinite."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    return a.join(b, key).withColumn("pct", F.when(F.col("old") != 0, (F.col("new") - F.col("old")) / F.col("old") * 100).when(F.col("new") == 0, 0.0).otherwise(F.lit(float("inf"))))


def depth_vector(lines: DataFrame, keys: list[str], name: str = "Depth") -> DataFrame:
    """Ordered values of a repeated key, trailing blanks cut: lines(keys, k, v, pos)."""
    own = lines.where(F.col("k") == name).withColumn("num", F.expr("try_cast(v as double)"))
    last = own.where("num is not null").groupBy(*keys).agg(F.max("pos").alias("_last"))
    return own.join(last, keys).where("pos <= _last").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "num"))), lambda x: x["num"]).alias("depths"))
