"""Shared helpers: word hashing over Arrow buffers, checkpoints, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
PIECE = 1 << 19

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POW = np.cumprod(np.full(1 << 16, 0xD6E8FEB86659FD93, U64))


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE):
    """Yield (first row, last row, bytes, offsets) for runs of rows of about ``limit`` bytes; null is empty text."""
    col = batch.column([n.lower() for n in batch.schema.names].index(column))  # Spark's names do not mind case
    col = col.cast(pa.large_binary()) if col.null_count == 0 else pa.array([x or b"" for x in col.cast(pa.large_binary()).to_pylist()], pa.large_binary())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """Hashes, byte starts and byte ends of the words of several texts, and each text's first word.

    A word is a maximal run of bytes other than space and 0x09-0x0D. Texts lie one after another in ``data``,
    text i in offsets[i]:offsets[i+1]. Temporary arrays cover pieces of about PIECE bytes, cut between words.
    """
    out_h, out_s, out_e, at = [], [], [], 0
    size = len(data)
    while at < size:
        end = min(size, at + PIECE)
        while end < size and not _WS[data[end]]:
            nxt = data[end : end + 4096]
            ws = np.flatnonzero(_WS[nxt])
            end += int(ws[0]) if len(ws) else len(nxt)
        a = data[at:end]
        word = ~_WS[a]
        cut = np.zeros(len(a) + 1, bool)
        cut[offsets[(offsets >= at) & (offsets <= end)] - at] = True
        prev = np.empty(len(a), bool)
        prev[0] = False
        prev[1:] = word[:-1]
        starts = np.flatnonzero(word & (~prev | cut[:-1]))
        if len(starts):
            follow = np.empty(len(a), bool)
            follow[-1] = False
            follow[:-1] = word[1:]
            ends = np.flatnonzero(word & (~follow | cut[1:])) + 1
            first = np.zeros(len(a), np.int32)
            first[starts] = np.diff(starts, prepend=0)
            pos = np.arange(len(a), dtype=np.int32) - np.cumsum(first, dtype=np.int32)
            v = _BYTE[_LOWER[a] if lower else a] * _POW[pos & 0xFFFF]
            v[~word] = 0
            out_h.append(mix(np.add.reduceat(v, starts) + (ends - starts).astype(U64)))
            out_s.append(starts + at)
            out_e.append(ends + at)
        at = end
    if not out_h:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64)
    h, s, e = (np.concatenate(x) if len(x) > 1 else x[0] for x in (out_h, out_s, out_e))
    return h, s, e, np.searchsorted(s, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; those across two texts are for the caller to leave out."""
    if len(h) < k:
        return np.zeros(0, U64)
    g = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        g = g * U64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j]
    return mix(g + U64(k))


def shingle_sets(data, offsets, k: int):
    """Sorted distinct k-word shingle hashes of each lower-cased text; a shorter text is one shingle, an empty one none."""
    h, _, _, first = hash_words(data, offsets, lower=True)
    g = grams(h, k)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield grams(h[a:b], b - a)
        else:
            yield np.zeros(0, U64)


def unicode_hash() -> Column:
    """64-bit hash of column text, computed in the JVM."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    if (set_ := sc.getConf().get("spark.checkpoint.dir")) is not None:
        return set_.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="freshet-checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the checkpoint folder and reread: smaller on disk than a checkpoint."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


FILTER_BITS = 1 << 22


def key_filter(keys: DataFrame, columns: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """A bit for the hash of each key, as rows (_word, _mask): always bits / 64 of them, whatever the number of keys.

    That fixed size (65,536 rows, 1 MB) is what lets it be broadcast. It only spares rows that cannot match a
    shuffle; with far more keys than bits it lets all rows through, and the join after it gives the same result.
    """
    h = F.pmod(F.xxhash64(*columns), F.lit(bits))
    held = keys.select(h.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("_mask"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("_word"))
    return checkpoint(every.join(held, "_word", "left").select("_word", F.coalesce("_mask", F.lit(0)).alias("_mask")))


def filtered(rows: DataFrame, table: DataFrame, columns: list[str], inside: bool = True, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose key may be among the table's, or those whose key is certainly not."""
    h = F.pmod(F.xxhash64(*[rows[c] for c in columns]), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    hit = (F.floor(h / 64) == table["_word"]) & (table["_mask"].bitwiseAND(one) != 0)
    return rows.join(F.broadcast(table), hit, "left_semi" if inside else "left_anti")


def anti_join(rows: DataFrame, keys: DataFrame, on: list[str | Column]) -> DataFrame:
    """Rows without a match among the keys, whose columns stand for those of ``on`` in order. Null keys match null keys.

    Only rows that may have a match are shuffled. A row travels as one struct, so its columns may have any names.
    """
    names = [f"k{i}" for i in range(len(on))]
    keys = checkpoint(keys.toDF(*names).distinct())
    table = key_filter(keys, names)
    named = keys.toDF(*[f"x{i}" for i in range(len(on))])
    held = rows.select(F.struct("*").alias("row"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(on, names)])
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"x{i}"))
    free = filtered(held, table, names, inside=False).select("row.*")
    return free.unionByName(filtered(held, table, names).join(named, same, "left_anti").select("row.*"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also where it is used inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefixes(values: Column, zero: Column, join: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each element of an array the fold of those before it, ``zero`` for the first.

    A fold that appends to an array copies it at every step, so it runs over blocks, then over the blocks' folds.
    """

    def folds(xs: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.filter(F.array(start), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(xs, empty, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda k: F.slice(xs, k * block + 1, F.lit(block)))

    def whole(xs: Column) -> Column:
        return let(blocks(xs), lambda bs: let(folds(F.transform(bs, lambda b: F.aggregate(b, zero, join)), zero), lambda starts: F.flatten(F.zip_with(bs, starts, folds))))

    return let(values, lambda xs: F.when(F.size(xs) <= block, folds(xs, zero)).otherwise(whole(xs)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges(src, dst)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds, each cut by checkpoint(). A hub's edges are read through a
    partial minimum and a join that adaptive execution can split, so no group is gathered anywhere.
    """
    e = checkpoint(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = checkpoint(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected_components: no fixed point")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most in this session, so that a worker's memory does not follow the texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
