"""Digests of exact bytes: ordinates as little-endian doubles, stamps as ISO text, JSON in canonical form."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def series_digests(df: DataFrame, keys: list[str], tie: str = "ts") -> DataFrame:
    """keys, n, ordinate_sha256 and timestamp_sha256 of each series of df(keys, ts, value), in the order of ts, then ``tie``.

    Ordinates are hashed as the bytes of little-endian doubles one after another (null as NaN), stamps as ISO text to the second, joined
    by line feeds. Rows are sorted by key and time within a partition and streamed past one running hash, so a series of any
    length takes the memory of one batch; a hash has an order, so a series stays in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f for f in df.schema.fields}
    schema = T.StructType([kinds[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("ordinate_sha256", T.StringType()), T.StructField("timestamp_sha256", T.StringType())])
    mark = F.xxhash64(F.struct(*keys))
    rows = df.select(*keys, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("_stamp"), F.col("value").cast("double").alias("_value"), mark.alias("_mark"), F.col("ts").alias("_ts"), F.col(tie).alias("_tie"))
    rows = rows.repartition(n, "_mark").sortWithinPartitions("_mark", *keys, "_ts", "_tie").drop("_ts", "_tie")
    width = len(keys)

    def run(batches):
        held = None

        def done():
            count, values, stamps, row = held
            return pa.RecordBatch.from_arrays([*row.columns[:width], pa.array([count], pa.int64()), pa.array([values.hexdigest()]), pa.array([stamps.hexdigest()])], names=[*keys, "n", "ordinate_sha256", "timestamp_sha256"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            mark = np.asarray(b.column(width + 2))
            value = b.column(width + 1).to_numpy(zero_copy_only=False).astype("<f8")
            stamps = b.column(width)
            cuts = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows]):
                if held is None or mark[x] != last:
                    if held is not None:
                        yield done()
                    held, last = [0, hashlib.sha256(), hashlib.sha256(), b.slice(x, 1)], mark[x]
                text = "\n".join(s or "" for s in stamps[x:y].to_pylist())
                held[2].update((("\n" if held[0] else "") + text).encode("ascii"))
                held[1].update(value[x:y].tobytes())
                held[0] += y - x
        if held is not None:
            yield done()

    return rows.mapInArrow(run, schema)


def canonical_sha256(document: Column) -> Column:
    """sha256 of a JSON text with sorted keys, no white space and plain characters; null for null or malformed text."""

    @F.pandas_udf(T.StringType())
    def digest(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t)
            except (TypeError, ValueError):
                return None
            return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

        return texts.map(one)

    return digest(document)
