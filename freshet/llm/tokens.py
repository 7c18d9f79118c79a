"""Token counts: an exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


PART = 1 << 20
FLUSH = 1 << 21
# A place between a character that is no white space and a space before a letter: the pattern always cuts there, so both
# sides may be encoded on their own.
_SEAM = re.compile(r"(?<=\S)(?= [^\W\d_])")


def parts_of(text: str, size: int = PART):
    """The text in parts of about ``size`` characters whose encodings, one after another, are that of the whole text."""
    at = 0
    while len(text) - at > size and (seam := _SEAM.search(text, at + size)):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


LONG_RUN = 1 << 16
# White space as the pattern understands it; the pattern takes a run of it whole, but for the last character before a word.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


class Encoder:
    """Token ids of texts of any kind and length, by a vocabulary file that is only read here.

    Matching the pattern needs stack for each character of a run of white space, so a run of ``LONG_RUN`` or more goes to the
    vocabulary's merges by itself, as the one piece that the pattern would make of it.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by = lambda pattern: tiktoken.Encoding(os.path.basename(vocabulary), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.piece = by(PATTERN), by("(?s:.+)")
        self.size = self.pattern.n_vocab

    def parts(self, text: str):
        """The ids of the whole text, in lists of which each holds about a part of ``PART`` characters or one long run."""
        at = 0
        for run in _LONG_RUN.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > at:
                yield from map(self.pattern.encode_ordinary, parts_of(text[at : run.start()]))
            yield self.piece.encode_ordinary(text[run.start() : end])
            at = end
        if at < len(text):
            yield from map(self.pattern.encode_ordinary, parts_of(text[at:] if at else text))


@lru_cache(1)
def _encoder(vocabulary: str) -> Encoder:
    """Made once in a worker."""
    return Encoder(vocabulary)


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, column: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row's whole text; null and empty texts have none. The file must lie on every machine."""

    def run(batches):
        encode = _encoder(vocabulary)
        for b in batches:
            n = [sum(map(len, encode.parts(v))) if v else 0 for v in (v.as_py() for v in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col(column).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, column: str = "text", end: int | None = None) -> DataFrame:
    """doc_id and token_ids (array of int) of every row's whole text, then the token ``end`` (default: the id after the
    vocabulary's last). Null and empty texts have that one alone."""

    def run(batches):
        encode = _encoder(vocabulary)
        last = end if end is not None else encode.size
        for b in batches:
            ids, cuts, values, held = b.column(0), [0], [], 0

            def out(first: int, upto: int) -> pa.RecordBatch:
                flat = pa.array(np.concatenate(values), pa.int32())
                return pa.RecordBatch.from_arrays([ids[first:upto], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)], names=["doc_id", "token_ids"])

            first = 0
            for k, v in enumerate(b.column(1)):
                for x in encode.parts(v.as_py() or ""):
                    values.append(np.array(x, np.int32))
                    held += len(values[-1])
                values.append(np.array([last], np.int32))
                held += 1
                cuts.append(held)
                if held >= FLUSH:
                    yield out(first, k + 1)
                    first, cuts, values, held = k + 1, [0], [], 0
            if len(cuts) > 1:
                yield out(first, b.num_rows)

    return docs.select("doc_id", F.col(column).alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """One row for each length that occurs, with figures for a context limit of that length.

    n_tokens, n_docs, docs_above (longer ones), docs_upto, tokens_upto (total of those no longer),
    tokens_truncated (total when each is cut to n_tokens), total_docs, total_tokens, quantile (share of documents
    no longer). Suffix sums run in two levels: over blocks of ``block`` lengths, then inside each block, so no
    task holds more than the block totals. Null lengths are left out; no lengths give no rows.
    """
    hist = lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    hist = common.checkpoint(hist.withColumn("b", F.floor(F.col("n_tokens") / block)).withColumn("t", F.col("n_docs") * F.col("n_tokens")))
    totals = hist.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    after = W.orderBy("b").rowsBetween(1, W.unboundedFollowing)
    every = W.orderBy("b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select("b", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bd").over(every).alias("total_docs"), F.sum("bt").over(every).alias("total_tokens"))
    own = W.partitionBy("b").orderBy("n_tokens").rowsBetween(1, W.unboundedFollowing)
    out = hist.join(totals, "b").withColumn("docs_above", F.coalesce(F.sum("n_docs").over(own), F.lit(0)) + F.col("ad")).withColumn("tokens_above", F.coalesce(F.sum("t").over(own), F.lit(0)) + F.col("at"))
    return out.select(
        "n_tokens", "n_docs", "docs_above",
        (F.col("total_docs") - F.col("docs_above")).alias("docs_upto"),
        (F.col("total_tokens") - F.col("tokens_above")).alias("tokens_upto"),
        (F.col("total_tokens") - F.col("tokens_above") + F.col("docs_above") * F.col("n_tokens")).alias("tokens_truncated"),
        "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_above")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_above, tokens_cut: those beyond it) for any limits, lengths that do not occur included.

    Read off the suffix sums: the figures of the longest length up to the limit hold for it. Limits below every length
    (and an empty histogram) are answered from the totals.
    """
    found = []
    for limit in sorted({int(x) for x in limits}):
        at = F.max_by(F.struct("docs_above", "tokens_upto"), "n_tokens")
        row = histogram.where(F.col("n_tokens") <= limit).agg(at.alias("r"))
        every = histogram.agg(F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"))
        above = F.coalesce("r.docs_above", "d", F.lit(0))
        cut = F.coalesce(F.col("t") - F.col("r.tokens_upto"), "t", F.lit(0)) - above * limit
        found.append(row.join(every).select(F.lit(limit).cast("long").alias("context_limit"), above.alias("docs_above"), cut.alias("tokens_cut")))  # one row each
    return reduce(DataFrame.union, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(common.documents(spark, sf_dir)))
