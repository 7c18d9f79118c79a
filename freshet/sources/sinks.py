"""Writers that check before they write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series


class Rejected(ValueError):
    """The data may not be written as asked."""


def write_series(df: DataFrame, path: str, keys: list[str] = ["path"], mode: str = "append") -> None:
    """Regular series only: finite, unique, evenly spaced by a minute or more; the check is one aggregation."""
    kind = dict(df.dtypes)["ts"]
    if kind != "timestamp_ntz":
        raise Rejected(f"ts must be naive, not {kind}")
    bad = series.check_regular(df, keys).where("non_finite + duplicates + sub_minute + irregular > 0").limit(5).collect()
    if bad:
        raise Rejected(f"not regular: {bad}")
    df.write.mode(mode).parquet(f"{path}/series")


def write_paired(df: DataFrame, path: str, mode: str = "append") -> None:
    """paired(path, ord, x, y): six-part paths, no path twice in a batch (an ord once in each)."""
    six = F.size(F.split("path", "/")) == 8
    bad = df.groupBy("path", "ord").agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~six).limit(5).collect()
    if bad:
        raise Rejected(f"paths that may not be written: {bad}")
    df.write.mode(mode).parquet(f"{path}/paired")


def write_grid(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.repartition("t").sortWithinPartitions("row", "col").write.mode(mode).partitionBy("t").parquet(f"{path}/grid")


def block_text(blocks: DataFrame, keys: list[str] = ["file"]) -> DataFrame:
    """(keys, content): blocks back as text, in order."""
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("     "), x["k"], F.lit(": "), F.coalesce(x["v"], F.lit("")))), "\n")
    one = F.concat(F.col("kind"), F.lit(": "), F.coalesce("name", F.lit("")), F.lit("\n"), F.when(F.size("lines") > 0, F.concat(body, F.lit("\n"))).otherwise(""), F.lit("End:\n"))
    return blocks.select(*keys, "ordinal", one.alias("t")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "t"))), lambda x: x["t"]), "\n").alias("content"))


def edit_blocks(blocks: DataFrame, changes: DataFrame, insert: bool = False) -> DataFrame:
    """Blocks with changes(kind, name, k, v) put into attrs and lines; absent keys are appended only with ``insert``."""
    entry = F.struct("k", "v")
    c = changes.where("v is not null").groupBy("kind", "name").agg(F.map_from_entries(F.collect_list(entry)).alias("_c"))
    out = blocks.join(c, ["kind", "name"], "left")
    none = F.expr("cast(map() as map<string,string>)")
    asked = F.coalesce("_c", none)
    kept = F.transform("lines", lambda x: F.struct(x["k"].alias("k"), F.coalesce(F.element_at(asked, x["k"]), x["v"]).alias("v"), x["pos"].alias("pos")))
    fresh = F.filter(F.map_keys(asked), lambda k: ~F.exists("lines", lambda x: x["k"] == k))
    added = F.transform(fresh, lambda k: F.struct(k.alias("k"), F.element_at(asked, k).alias("v"), F.lit(None).cast("int").alias("pos")))
    lines = F.concat(kept, added) if insert else kept
    attrs = F.map_concat(F.map_filter("attrs", lambda k, v: ~F.map_contains_key(asked, k)), asked if insert else F.map_filter(asked, lambda k, v: F.map_contains_key("attrs", k)))
    return out.withColumn("_l", lines).withColumn("attrs", attrs).drop("lines", "_c").withColumnRenamed("_l", "lines")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("comment", "#")
    return (reader.schema(schema) if schema else reader).csv(path)


def feature(geometry: str, coordinates: Column, properties: Column) -> Column:
    """A GeoJSON feature as text; geometry Point, LineString or Polygon."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def points_geojson(points: DataFrame, properties: list[str]) -> DataFrame:
    return points.select(feature("Point", F.array("x", "y"), F.struct(*properties)).alias("feature"))


def shapes_geojson(vertices: DataFrame, keys: list[str], closed: bool) -> DataFrame:
    """A feature for each ring or line of vertices(keys, ord, x, y)."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    g = vertices.groupBy(*keys).agg(ring.alias("_r"))
    coords = F.array(F.when(F.col("_r")[0] == F.element_at("_r", -1), F.col("_r")).otherwise(F.concat("_r", F.slice("_r", 1, 1)))) if closed else F.col("_r")
    return g.select(feature("Polygon" if closed else "LineString", coords, F.struct(*keys)).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line, for layers of any size."""
    features.select("feature").write.mode("overwrite").text(path)


def collection(features: DataFrame, limit: int = 100_000) -> DataFrame:
    """All features as one document, for layers that a reader opens whole; a layer of more than ``limit`` is refused, see
    write_features."""
    if features.limit(limit + 1).count() > limit:
        raise Rejected(f"more than {limit} features for one document")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list("feature")), ","), F.lit("]}")).alias("content"))


PRODUCT = "freshet/product/1"


def assets(spark, path: str) -> DataFrame:
    """(href, size_bytes, sha256) of the data files below a folder, hrefs relative to it; each file is hashed where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    root = f"/{path.rstrip('/').rsplit('/', 1)[-1]}/"
    return files.select(F.substring_index("path", root, -1).alias("href"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(df: DataFrame, summary: DataFrame, files: DataFrame) -> DataFrame:
    """(content): one JSON document on a product: its span, columns, rows, how many series qualify, and every file with size and hash.

    A series qualifies when its summary row has no false among its boolean columns. The document lists files, not rows.
    """
    flags = [f.name for f in summary.schema.fields if f.dataType.typeName() == "boolean"]
    good = F.lit(True)
    for c in flags:
        good = good & F.coalesce(F.col(c), F.lit(False))
    span = df.agg(F.date_format(F.min("time"), "yyyy-MM-dd'T'HH:mm:ss").alias("start"), F.date_format(F.max("time"), "yyyy-MM-dd'T'HH:mm:ss").alias("end"), F.count("*").alias("rows"))
    status = summary.agg(F.count("*").alias("series"), F.count_if(good).alias("qualified"))
    listed = files.agg(F.array_sort(F.collect_list(F.struct("href", "size_bytes", "sha256"))).alias("assets"))
    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in df.dtypes])
    doc = F.struct(F.lit(PRODUCT).alias("schema"), F.struct("start", "end").alias("time"), F.col("rows"), columns.alias("columns"), F.struct("series", "qualified", (F.col("series") == F.col("qualified")).alias("all_qualified")).alias("status"), F.col("assets"))
    return span.join(status).join(listed).select(F.to_json(doc).alias("content"))  # one row each


def write_product(df: DataFrame, summary: DataFrame, path: str) -> None:
    """Long table sorted by (time, mapping_id), its qualification and a manifest of both, staged and then renamed, so readers see
    all or nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    stage = f"{path}-{uuid.uuid4()}"
    df.orderBy("time", "mapping_id").write.parquet(f"{stage}/series")
    summary.write.parquet(f"{stage}/qualification")
    manifest(spark.read.parquet(f"{stage}/series"), spark.read.parquet(f"{stage}/qualification"), assets(spark, stage)).write.text(f"{stage}/manifest")
    hadoop = sc._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(hadoop.Path(stage), target):
        fs.delete(hadoop.Path(stage), True)
        raise Rejected(f"{path} exists")


def product_problems(spark, path: str) -> DataFrame:
    """(href, problem) of a product's files: missing, changed since the manifest was written, or not in it."""
    shape = "assets array<struct<href:string,size_bytes:bigint,sha256:string>>"
    said = spark.read.text(f"{path}/manifest").select(F.explode(F.from_json("value", shape)["assets"]).alias("a")).select("a.href", F.col("a.size_bytes").alias("_n"), F.col("a.sha256").alias("_s"))
    there = assets(spark, path)
    both = said.join(there, "href", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_s").isNull(), "not in the manifest").when((F.col("_n") != F.col("size_bytes")) | (F.col("_s") != F.col("sha256")), "changed")
    return both.select("href", problem.alias("problem")).where("problem is not null")


def digest(df: DataFrame) -> str:
    """Order-free fingerprint of a table: row count and a sum of row hashes."""
    cols = sorted(df.columns)
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


def write_once(df: DataFrame, path: str) -> bool:
    """Write, or accept an equal table that is there; a different one is refused. True if it wrote."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        if digest(spark.read.parquet(path).select(*df.columns)) != digest(df):
            raise Rejected(f"{path} holds something else")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True
