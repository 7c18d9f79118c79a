"""Series, catalogs and layers kept as tables; small foreign files through a Python data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import series


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/catalog")


def read_series(spark: SparkSession, path: str, names: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Samples of a stored series table; names and window reach the Parquet scan."""
    df = spark.read.parquet(f"{path}/series")
    return series.window_of(df if names is None else df.where(F.col("path").isin(names)), start, end)


def read_paired(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/paired")
    return df if name is None else df.where(F.col("path") == name)


def read_grid(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Long grid(t, row, col, value), partitioned by t: window and box prune files and row groups."""
    df = spark.read.parquet(f"{path}/grid")
    if box:
        df = df.where(F.col("col").between(box[0], box[2]) & F.col("row").between(box[1], box[3]))
    if start:
        df = df.where(F.col("t") >= start)
    return df.where(F.col("t") <= end) if end else df


def read_results(spark: SparkSession, path: str, variables: list[str] | None = None, elements: list[str] | None = None) -> DataFrame:
    """Landed results(element, variable, ts, value) of a run; both filters reach the Parquet scan."""
    df = spark.read.parquet(f"{path}/results").select("element", "variable", "ts", "value")
    for column, names in (("variable", variables), ("element", elements)):
        df = df if names is None else df.where(F.col(column).isin(names))
    return df


def sqlite_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file) of the SQLite files below a folder, in order; only their names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sqlite").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("file")).orderBy("file")


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """(layer, n) of a SQLite file, one row for each user table."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_layers").option("path", path).load().groupBy("layer").agg(F.count("row").alias("n"))


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(layer, rowid, row) of one table, row as JSON; from_json gives it types."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_layers").option("path", path).option("layer", layer).load()


def layer_vertices(spark: SparkSession, path: str, layer: str, column: str = "geometry") -> DataFrame:
    """(id, part, ring, ord, x, y, problem) of a layer's geometries, id being the rowid; attributes are in read_layer."""
    from . import wkb

    rows = read_layer(spark, path, layer)
    return wkb.vertices(rows.select(F.col("rowid").alias("id"), F.unbase64(F.get_json_object("row", f"$['{column}']")).alias("blob")), "blob")


class _Layer(InputPartition):
    def __init__(self, layer: str, low: int, high: int):
        self.layer, self.low, self.high = layer, low, high


class SqliteSource(DataSource):
    """Tables of a SQLite file that every machine can open; a partition is a range of ``rows`` rowids (50,000) of a table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_layers"

    def schema(self) -> str:
        return "layer string, rowid long, row string"

    def reader(self, schema):
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layer, self.rows = options["path"], options.get("layer"), int(options.get("rows", "50000"))

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        con = self._open()
        names = [self.layer] if self.layer else [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
        out = []
        for n in names:
            low, high = con.execute(f"select min(rowid), max(rowid) from {self._quoted(n)}").fetchone()
            if low is not None:
                out += [_Layer(n, at, min(high, at + self.rows - 1)) for at in range(low, high + 1, self.rows)]
        con.close()
        return out or [_Layer(n, 1, 0) for n in names[:1]]

    @staticmethod
    def _quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def read(self, partition):
        import base64
        import json

        con = self._open()
        cur = con.execute(f"select rowid, * from {self._quoted(partition.layer)} where rowid between ? and ?", (partition.low, partition.high))
        names = [d[0] for d in cur.description][1:]
        plain = lambda v: base64.b64encode(v).decode() if isinstance(v, bytes) else v
        for r in cur:
            yield partition.layer, r[0], json.dumps(dict(zip(names, map(plain, r[1:]))))
        con.close()
