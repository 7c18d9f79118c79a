"""Packing: optimal length buckets and token-budget batches.

Encoded documents are cut into pieces of at most ``context`` tokens (the last one holds the rest), so the global
histogram has ``context`` entries at most whatever the input's size. Dynamic programming over it picks the
bucket boundaries that minimise padding; inside a bucket, batches hold as many pieces as the token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common, tokens


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending boundaries, the last being the longest length, of least total padding; ties go to the smaller boundary."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return []
    cc, cx = np.concatenate(([0], np.cumsum(c))), np.concatenate(([0], np.cumsum(c * x)))
    k = min(buckets, n)
    best = x * cc[1:] - cx[1:]
    back = np.zeros((k, n), np.int64)
    for b in range(1, k):
        new = best.copy()
        for j in range(b, n):
            cost = best[b - 1 : j] + x[j] * (cc[j + 1] - cc[b : j + 1]) - (cx[j + 1] - cx[b : j + 1])
            i = int(np.argmin(cost))
            new[j], back[b, j] = cost[i], b + i
        best = new
    out, j = [], n - 1
    for b in range(k - 1, -1, -1):
        out.append(int(x[j]))
        if b:
            j = int(back[b, j]) - 1
    return out[::-1]


def histogram(sizes: DataFrame, context: int) -> dict[int, int]:
    """Pieces by length of documents with n_tokens tokens: whole ones of ``context`` and the rests, ``context`` entries at most."""
    n = F.col("n_tokens")
    rests = sizes.where("n_tokens > 0").groupBy((n % context).alias("rest")).agg(F.count("*").alias("docs"), F.sum(F.floor(n / context)).alias("whole")).collect()
    out = {int(r.rest): int(r.docs) for r in rests if r.rest}
    if whole := sum(int(r.whole) for r in rests):
        out[context] = whole
    return out


def pack(encoded: DataFrame, context: int = 2048, buckets: int = 16, budget: int = 65536, per_shard: int = 4096) -> DataFrame:
    """One row for each piece of encoded(doc_id, token_ids): doc_id, piece, start, n_tokens, token_ids, bucket_len,
    padding, batch_id, slot. The pieces of a document, one after another, are its tokens.

    A batch has at most ``budget // bucket_len`` pieces, all of one bucket. A bucket is dealt to shards of about
    ``per_shard`` pieces by a hash of the piece, so a bucket with most rows is never ranked in one task; each shard leaves
    one short batch at most. Slots follow doc_id, piece and tokens; rows equal in all three are interchangeable. Null ids
    and repeated rows are kept as they are; null or empty token lists give no piece, an empty table no rows.
    The encoded documents are written once, as Parquet in the checkpoint folder, and read twice: for their lengths, then for the pieces.
    """
    encoded = common.stored(encoded.select("doc_id", "token_ids"))
    hist = histogram(encoded.select(F.size("token_ids").alias("n_tokens")), context)
    lengths = np.array(sorted(hist), np.int64)
    counts = np.array([hist[x] for x in lengths.tolist()], np.int64)
    ends = optimal_boundaries(lengths, counts, buckets) or [context]
    bucket = np.searchsorted(ends, lengths)
    shards = [max(1, -(-int(counts[bucket == b].sum()) // per_shard)) for b in range(len(ends))]
    starts = F.sequence(F.lit(0), F.size("token_ids") - 1, F.lit(context))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("token_ids", s + 1, F.lit(context)).alias("ids")))
    pieces = encoded.where(F.size("token_ids") > 0).select("doc_id", F.posexplode(cut).alias("piece", "z")).select("doc_id", F.col("piece").cast("long"), F.col("z.start").cast("long").alias("start"), F.size("z.ids").cast("long").alias("n_tokens"), F.col("z.ids").alias("token_ids"))
    k = F.lit(None).cast("int")
    for b in range(len(ends) - 1, -1, -1):
        k = F.when(F.col("n_tokens") <= ends[b], F.lit(b)).otherwise(k)
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("b") + 1)
    dealt = (
        pieces.withColumn("b", k)
        .withColumn("bucket_len", at(ends).cast("long"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "token_ids"), at(shards)))
        .withColumn("rank", F.row_number().over(W.partitionBy("b", "shard").orderBy("doc_id", "piece", "token_ids")) - 1)
    )
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return dealt.select(
        "doc_id", "piece", "start", "n_tokens", "token_ids", "bucket_len",
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.concat_ws("-", "bucket_len", "shard", F.floor(F.col("rank") / room)).alias("batch_id"),
        (F.col("rank") % room).cast("long").alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokens.encoded(common.documents(spark, sf_dir)))
