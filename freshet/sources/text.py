"""Block-structured model text, distributions, frequency tables, geometry text: files to DataFrames.

Files are read through Spark's binary reader, so any store that Spark can open will do. A file is the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENCODINGS = ("utf-8", "cp1252", "latin-1")


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, content): text of each file in the first of ENCODINGS that decodes it."""
    import pandas as pd

    def decoded(raw: bytes) -> str:
        for name in ENCODINGS:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                pass
        return raw.decode("latin-1", "replace")

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"file": pdf["path"], "content": [decoded(bytes(x)) for x in pdf["content"]]})

    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "content").mapInPandas(run, "file string, content string")


def lines(files: DataFrame) -> DataFrame:
    """(file, pos, line)."""
    return files.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))


def blocks(text: DataFrame, keys: list[str] = ["file"]) -> DataFrame:
    """keys, ordinal, kind, name, attrs, lines of text(keys, pos, line): from 'Kind: name' at a line's start to 'End:'.

    attrs has the last value of each key; lines keeps every key with its place, for keys that repeat by position.
    """
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.col("line").rlike(r"^[A-Za-z][^:]*:") & ~F.col("line").rlike(r"^End:")
    part = lambda i: F.trim(F.regexp_extract("line", r"^\s*([^:]+):(.*)$", i))
    rows = text.withColumn("_h", head).withColumn("ordinal", F.sum(F.col("_h").cast("long")).over(w)).where("ordinal > 0").withColumn("k", part(1)).withColumn("v", part(2))
    names = rows.where("_h").select(*keys, "ordinal", F.col("k").alias("kind"), F.col("v").alias("name"))
    body = rows.where(~F.col("_h") & (F.col("k") != "") & ~F.col("line").rlike(r"^\s*End:"))
    last = body.groupBy(*keys, "ordinal", "k").agg(F.max_by("v", "pos").alias("v"))
    attrs = last.groupBy(*keys, "ordinal").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attrs"))
    kept = body.groupBy(*keys, "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", "v"))), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["pos"].alias("pos"))).alias("lines"))
    none = F.expr("cast(map() as map<string,string>)")
    empty = F.expr("cast(array() as array<struct<k:string,v:string,pos:int>>)")
    return names.join(attrs, [*keys, "ordinal"], "left").join(kept, [*keys, "ordinal"], "left").withColumn("attrs", F.coalesce("attrs", none)).withColumn("lines", F.coalesce("lines", empty))


def read_blocks(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    return blocks(lines(read_files(spark, path, glob)))


def load_project(spark: SparkSession, folder: str, views: bool = True) -> dict[str, DataFrame]:
    """The nine tables of a project folder: project, basins, subbasins, mets, controls, runs, gages, tables, and grids, the
    SQLite files that make it a gridded model."""
    from ..functions.units import parse_datetime
    from ..operators import params

    from .tables import sqlite_files

    own = {kind: read_blocks(spark, folder, f"*.{kind}") for kind in ("hms", "basin", "met", "control", "run", "gage", "pdata")}
    get = lambda k: F.element_at("attrs", F.lit(k))
    try_num = lambda k: get(k).try_cast("double")
    c = own["control"].where("kind = 'Control'")
    out = {
        "project": own["hms"].select("file", "ordinal", "kind", "name", "attrs"),
        "basins": params.basin_summary(own["basin"]).join(own["basin"].where("kind = 'Basin'").select("file", F.col("name").alias("basin")), "file", "left"),
        "subbasins": params.elements(own["basin"]).where("kind = 'Subbasin'").drop("lines"),
        "mets": own["met"].where("kind = 'Meteorology'").select("file", F.col("name").alias("met"), get("Precipitation Method").alias("precip_method"), get("Use Basin Model").alias("basin_model")),
        "controls": c.select("file", F.col("name").alias("control"), parse_datetime(get("Start Date"), get("Start Time")).alias("start"), parse_datetime(get("End Date"), get("End Time")).alias("end"), try_num("Time Interval").alias("interval_minutes")),
        "runs": own["run"].where("kind = 'Run'").select("file", F.col("name").alias("run"), get("Basin").alias("basin"), get("Precip").alias("met"), get("Control").alias("control"), get("DSS File").alias("dss_file")),
        "gages": own["gage"].where("kind = 'Gage'").select("file", F.col("name").alias("gage"), get("Gage Type").alias("gage_type"), get("Filename").alias("dss_file"), get("Pathname").alias("path")),
        "tables": own["pdata"].where("kind = 'Table'").select("file", F.col("name").alias("table"), get("Table Type").alias("table_type"), get("DSS File").alias("dss_file"), get("Pathname").alias("path")),
    }
    out["grids"] = sqlite_files(spark, folder)
    if views:
        for name, df in out.items():
            df.createOrReplaceTempView(name)
    return out


def gage_assignments(met_blocks: DataFrame) -> DataFrame:
    """file, subbasin, gage, weight (1 where none is given) of met blocks."""
    s = met_blocks.where("kind = 'Subbasin'")
    get = lambda k: F.element_at("attrs", F.lit(k))
    return s.select("file", F.col("name").alias("subbasin"), F.coalesce(get("Gage"), get("Precip Gage")).alias("gage"), F.coalesce(get("Gage Weight").try_cast("double"), F.lit(1.0)).alias("weight"))


def temporal_distributions(files: DataFrame) -> DataFrame:
    """(file, quartile, hours, probability, cum_pct) of sectioned distribution files."""
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    title = F.regexp_extract("line", r"^CUMULATIVE PERCENTAGES OF TOTAL PRECIPITATION FOR (.*?)\s*(?:CASES)?\s*,*\s*$", 1)
    head = F.when(F.col("line").rlike("^hours,"), F.split("line", ","))
    rows = lines(files).withColumn("quartile", F.last(F.when(title != "", title), True).over(w)).withColumn("_h", F.last(head, True).over(w))
    cells = F.transform(F.split("line", ","), lambda x: F.trim(x).try_cast("double"))
    data = rows.where(F.col("_h").isNotNull() & F.col("line").rlike(r"^\s*[0-9.]+\s*,")).withColumn("_c", cells)
    return data.select("file", "quartile", F.col("_c")[0].alias("hours"), F.posexplode(F.slice("_c", F.lit(2), F.size("_c") - 1)).alias("_p", "cum_pct"), "_h").select("file", "quartile", "hours", F.trim(F.get("_h", F.col("_p") + 1)).alias("probability"), "cum_pct").where("probability is not null")


def paired_distributions(rows: DataFrame, region: str, hours: int) -> DataFrame:
    """paired(path, ord, x, y) of temporal_distributions rows, as sinks.write_paired takes it: hours against fractions."""
    named = F.regexp_replace(F.upper("quartile"), " ", "-")
    path = F.concat(F.lit(f"//{region}/"), named, F.lit(f"/{hours}HR//"), "probability", F.lit("/"))
    place = F.row_number().over(W.partitionBy("file", "quartile", "probability").orderBy("hours")) - 1
    return rows.select(path.alias("path"), place.alias("ord"), F.col("hours").alias("x"), (F.col("cum_pct") / 100).alias("y"))


def epsg(wkt: Column) -> Column:
    """The EPSG code that a coordinate system's text ends with; null without one."""
    return F.nullif(F.regexp_extract(wkt, r'AUTHORITY\["EPSG",\s*"(\d+)"\]\s*\]?\s*$', 1), F.lit("")).try_cast("int")


def project_crs(spark: SparkSession, folder: str) -> DataFrame:
    """(rank, file, wkt, epsg): coordinate systems of a project folder in order of trust, rank 1 first: its SQLite grids,
    then .prj files. A project without either gives no rows."""
    from .tables import read_layer, sqlite_files

    found = read_files(spark, folder, "*.prj").select(F.lit(1).alias("k"), "file", F.trim("content").alias("wkt"))
    for path in (r.file for r in sqlite_files(spark, folder).collect()):  # the grids of one project
        own = read_layer(spark, path, "spatial_ref_sys").select(F.lit(0).alias("k"), F.lit(path).alias("file"), F.trim(F.get_json_object("row", "$.srtext")).alias("wkt"))
        found = found.union(own)
    return found.where("wkt <> ''").select(F.row_number().over(W.orderBy("k", "file", "wkt")).alias("rank"), "file", "wkt", epsg(F.col("wkt")).alias("epsg"))


def point_frequencies(files: DataFrame) -> DataFrame:
    """(file, duration_row, ari_col, depth) of a response with the assignment quantiles = [[...], ...]."""
    raw = F.regexp_replace(F.regexp_extract("content", r"(?s)quantiles\s*=\s*(\[\[.*?\]\])\s*;", 1), "'", '"')
    table = F.from_json(raw, "array<array<string>>")
    rows = files.select("file", F.posexplode(table).alias("duration_row", "_r"))
    return rows.select("file", "duration_row", F.posexplode("_r").alias("ari_col", "_d")).select("file", "duration_row", "ari_col", F.col("_d").cast("double").alias("depth"))


def depth_table(files: DataFrame) -> DataFrame:
    """(file, duration, ari, depth) of 'label:, d1, d2, ...' rows under 'by duration for ARI (years):, ...'; duration in minutes."""
    from ..functions.units import interval_minutes

    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = F.transform(F.split(F.regexp_extract("line", r"^[^:]*:(.*)$", 1), ","), lambda x: F.trim(x).try_cast("double"))
    own = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))
    rows = lines(files).withColumn("_a", F.last(F.when(F.col("line").startswith("by duration for ARI"), own), True).over(w))
    label = F.regexp_extract("line", r"^(\d+)-(min|hr|day):", 0)
    minutes = interval_minutes(F.replace(F.replace(F.replace(label, F.lit("-"), F.lit(" ")), F.lit("hr"), F.lit("HOUR")), F.lit(":"), F.lit("")))
    return rows.where(F.col("_a").isNotNull() & (label != "")).select("file", minutes.alias("duration"), F.explode(F.arrays_zip(F.col("_a").alias("ari"), own.alias("depth"))).alias("z")).select("file", "duration", F.col("z.ari").cast("int").alias("ari"), "z.depth")


def element_points(files: DataFrame) -> DataFrame:
    """(file, kind, name, x, y) of canvas coordinates in geometry or basin text."""
    get = lambda k: F.element_at("attrs", F.lit(k)).try_cast("double")
    return blocks(lines(files)).select("file", "kind", "name", get("Canvas X").alias("x"), get("Canvas Y").alias("y")).where("x is not null and y is not null")


def bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def map_segments(files: DataFrame) -> DataFrame:
    """(file, segment, map_type, segment_type, ord, x, y) of map text; broken coordinate lines are left out."""
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = lambda k: F.when(F.col("line").rlike(rf"^\s*{k}:"), F.trim(F.regexp_extract("line", r":(.*)$", 1)))
    xy = F.split("line", ",")
    rows = lines(files).withColumn("map_type", F.last(after("MapGeo"), True).over(w)).withColumn("segment_type", F.last(after("MapSegment"), True).over(w)).withColumn("segment", F.count(after("MapSegment")).over(w))
    rows = rows.where(F.size(xy) == 2).withColumn("x", F.trim(xy[0]).try_cast("double")).withColumn("y", F.trim(xy[1]).try_cast("double")).where("x is not null and y is not null and segment > 0")
    return rows.select("file", "segment", "map_type", "segment_type", F.row_number().over(W.partitionBy("file", "segment").orderBy("pos")).alias("ord"), "x", "y")


def grid_cells(files: DataFrame) -> DataFrame:
    """(file, subbasin, x, y, travel_length, area) of GRIDCELL lines under their SUBBASIN line."""
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    name = F.when(F.col("line").rlike(r"^\s*SUBBASIN:"), F.trim(F.regexp_extract("line", r":(.*)$", 1)))
    parts = F.split(F.trim(F.regexp_extract("line", r"^\s*GRIDCELL:(.*)$", 1)), r"\s+")
    rows = lines(files).withColumn("subbasin", F.last(name, True).over(w)).where(F.col("line").rlike(r"^\s*GRIDCELL:") & (F.size(parts) >= 4) & F.col("subbasin").isNotNull())
    return rows.select("file", "subbasin", parts[0].cast("int").alias("x"), parts[1].cast("int").alias("y"), parts[2].cast("double").alias("travel_length"), parts[3].cast("double").alias("area"))


def pathnames(files: DataFrame) -> DataFrame:
    """(file, ordinal, path) of a JSON list of pathnames."""
    return files.select("file", F.posexplode(F.from_json("content", "array<string>")).alias("ordinal", "path"))


def log_lines(files: DataFrame) -> DataFrame:
    from ..operators import logs

    return logs.messages(lines(files))


def empirical_curves(spark: SparkSession, path: str) -> DataFrame:
    """(supplement, quartile, duration_class, interval_pct, percentile, value) of a CSV with columns p<NN>."""
    wide = spark.read.csv(path, header=True, comment="#")
    cols = [c for c in wide.columns if c[:1] == "p" and c[1:].isdigit()]
    long = wide.select("supplement", "quartile", "duration_class", F.col("interval_pct").cast("double").alias("interval_pct"), F.explode(F.array(*[F.struct(F.lit(int(c[1:])).alias("percentile"), F.col(c).cast("double").alias("value")) for c in cols])).alias("z"))
    return long.select("supplement", "quartile", "duration_class", "interval_pct", "z.percentile", "z.value")
