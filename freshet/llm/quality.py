"""Compression classifier: zstandard dictionaries built from good and from bad labelled text.

A text is compressed in blocks of ``BLOCK`` bytes with either dictionary. The normalised difference of the two
sizes, together with the plain size ratio, goes through a weighted logistic calibration to a score in [0, 1].
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK = 1024
DICTIONARY_BYTES = 112_640


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False)


def _sizes(raw: bytes, cg, cb) -> tuple[float, float]:
    """Normalised difference of the two compressed sizes, and their mean over the plain size."""
    g = p = 0
    for at in range(0, max(1, len(raw)), BLOCK):
        piece = raw[at : at + BLOCK]
        g += len(cg.compress(piece))
        p += len(cb.compress(piece))
    return (g - p) / (g + p), (g + p) / 2 / max(1, len(raw))


def _features(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """doc_id, difference, ratio; an empty or null text is one empty block."""

    def run(batches):
        cg, cb = _compressor(good), _compressor(bad)
        for b in batches:
            diff, ratio = [], []
            for i, j, data, offsets in common.text_blocks(b):
                for k in range(j - i):
                    d, r = _sizes(data[offsets[k] : offsets[k + 1]].tobytes(), cg, cb)
                    diff.append(d)
                    ratio.append(r)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(diff, pa.float64()), pa.array(ratio, pa.float64())], names=["doc_id", "difference", "ratio"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, difference double, ratio double")


def _columns(diff: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    d, r = 10 * np.asarray(diff, float), np.minimum(np.asarray(ratio, float), 2)
    return np.column_stack([np.ones(len(d)), d, r, d * r])


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-2 * beta)
    return beta


def train(docs: DataFrame, labels: DataFrame, dictionary_docs: int = 1000, calibration_docs: int = 2000) -> dict:
    """Dictionaries and calibration from ``labels(doc_id, quality)`` joined to ``docs``.

    The sample of labelled rows is bounded by two parameters: for each class, the ``dictionary_docs`` labelled ids of smallest
    hash build the dictionary from all blocks of their whole texts; the next ``calibration_docs`` give two figures each,
    from whole texts. Calibration weights restore the classes' shares among all labels. An id that is labelled both 0
    and 1 says nothing and is left out, as null ids and labels are; repeated labels count once. With one class or none, every
    score is the share of label 1 (0.5 without labels).
    """
    lab = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    counts = {r[0]: r[1] for r in lab.groupBy("quality").count().collect()}
    model = {"good": b"", "bad": b"", "beta": None, "share": counts.get(1, 0) / sum(counts.values()) if counts else 0.5}
    if len(counts) < 2:
        return model
    order = F.xxhash64("doc_id")
    picked = []
    for q in (0, 1):
        ids = [r[0] for r in lab.where(F.col("quality") == q).orderBy(order, "doc_id").limit(dictionary_docs + calibration_docs).select("doc_id").collect()]
        n = min(dictionary_docs, max(1, len(ids) // 2))
        picked += [(i, q, k < n) for k, i in enumerate(ids)]
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int, builds boolean")  # bounded by the two parameters
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def pieces(batches):
        for b in batches:
            for i, _, data, offsets in common.text_blocks(b, limit=1):
                for base in range(0, int(offsets[1]), 1024 * BLOCK):
                    out = [data[at : min(int(offsets[1]), at + BLOCK)].tobytes() for at in range(base, min(int(offsets[1]), base + 1024 * BLOCK), BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(2)[i].as_py()] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["quality", "piece"])

    blocks = chosen.where("builds").select("doc_id", "text", "quality").mapInArrow(pieces, "quality int, piece binary")
    for q, name in ((0, "bad"), (1, "good")):
        own = sorted(bytes(r[0]) for r in blocks.where(F.col("quality") == q).select("piece").collect())
        try:
            model[name] = zstandard.train_dictionary(DICTIONARY_BYTES, own).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little text for the trainer: the text itself is the dictionary
            model[name] = b"".join(own)
    seen = _features(chosen.where("not builds"), model["good"], model["bad"]).join(F.broadcast(sample), "doc_id").select("quality", "difference", "ratio").collect()
    y = np.array([r[0] for r in seen], float)
    if len(set(y)) < 2:
        return model
    w = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    model["beta"] = _fit(_columns([r[1] for r in seen], [r[2] for r in seen]), y, w * len(y) / w.sum())
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row; repeated rows and null ids are scored as they come."""
    f = _features(docs, model["good"], model["bad"])
    if model["beta"] is None:
        return f.select("doc_id", F.lit(float(model["share"])).alias("score"))
    b = [float(v) for v in model["beta"]]
    d, r = 10 * F.col("difference"), F.least(F.col("ratio"), F.lit(2.0))
    return f.select("doc_id", (1 / (1 + F.exp(-(b[0] + b[1] * d + b[2] * r + b[3] * d * r)))).alias("score"))


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return train(docs, labels.where(fold() != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, fitted(spark, docs, sf_dir)).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that the classifier keeps (score of 0.3 or more), with all their columns.

    Null and empty texts are scored as one empty block, null ids and repeated rows as they come. With labels of one class
    only, all rows stay or all go, by that class.
    """
    model = fitted(spark, docs, sf_dir)
    good, bad = model["good"], model["bad"]
    if model["beta"] is None:
        return docs if model["share"] >= 0.3 else docs.limit(0)
    beta = model["beta"]
    schema = T.StructType(docs.schema.fields)

    def run(batches):
        cg, cb = _compressor(good), _compressor(bad)
        for b in batches:
            pairs = []
            for i, j, data, offsets in common.text_blocks(b):
                pairs += [_sizes(data[offsets[k] : offsets[k + 1]].tobytes(), cg, cb) for k in range(j - i)]
            x = _columns([d for d, _ in pairs], [r for _, r in pairs])
            keep = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500))) >= 0.3
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
