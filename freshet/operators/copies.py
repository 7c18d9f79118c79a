"""Equal rows are worked once: one of each kind stands for its copies, and pairs of those are paired out to all of them at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import checkpointed

CHUNK = 256  # ids of one row before pairs are written out
ROWS = 4_000_000  # pairs that one task writes out


def shuffled(df: DataFrame) -> DataFrame:
    """df, never broadcast in a join: rows exploded from a small file are taken for small by the planner."""
    return df.hint("merge")


def kinds(rows: DataFrame, key: list[str], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(one, copies) of rows(id, key): one(key, rep, n) has the smallest id of each key and how many rows have it,
    copies(id, rep) every row's. Rows with a null in the key are left out."""
    rows = rows.select(F.col(id).alias("id"), *key).dropna(subset=key)
    one = checkpointed(rows.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    return one, checkpointed(rows.join(shuffled(one), key).select("id", "rep"))


def chunks(copies: DataFrame, p: str) -> DataFrame:
    """(rep, chunk, ids) of copies(id, rep) with names that begin with p: about CHUNK ids a row."""
    parts = copies.groupBy("rep").count().where(F.col("count") > CHUNK).select(F.col("rep").alias("_r"), F.ceil(F.col("count") / CHUNK).alias("_n"))
    at = copies.join(parts, F.col("rep") == F.col("_r"), "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1))))
    return at.groupBy(F.col("rep").alias(f"{p}_rep"), F.col("chunk").alias(f"{p}_chunk")).agg(F.collect_list("id").alias(f"{p}_ids"))


def paired(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs(a_id, b_id, ...) between those that stand for copies a(id, rep) and b(id, rep), for all of these.

    Ids meet as rows of CHUNK times CHUNK, dealt evenly, and are written out where they lie: only these short lists are
    shuffled, however many copies two kinds have.
    """
    pairs = checkpointed(pairs)
    n = lambda copies, p: copies.groupBy(F.col("rep").alias(f"{p}_id")).agg(F.count("*").alias(f"{p}_n"))
    total = pairs.select("a_id", "b_id").join(shuffled(n(a, "a")), "a_id").join(shuffled(n(b, "b")), "b_id").agg(F.sum(F.col("a_n") * F.col("b_n"))).first()[0] or 0
    more = [c for c in pairs.columns if c not in ("a_id", "b_id")]
    met = pairs.join(shuffled(chunks(a, "a")), F.col("a_id") == F.col("a_rep")).join(shuffled(chunks(b, "b")), F.col("b_id") == F.col("b_rep"))
    if total > ROWS:
        tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-total // ROWS))
        met = met.repartition(tasks, "a_rep", "a_chunk", "b_rep", "b_chunk")
    out = met.select(F.explode("a_ids").alias("a_id"), "b_ids", *more)
    return out.select("a_id", F.explode("b_ids").alias("b_id"), *more)
