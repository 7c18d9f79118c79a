"""Masked pseudo-likelihood scoring with a bidirectional window network trained in numpy.

A token is a word (lower-cased) of the corpus vocabulary or one of a few hash buckets. The network reads the two
tokens on either side and predicts the one between through a two-level softmax. Training is by rounds of local
steps in every task that together mask every position of all documents once, with parameter averaging by slices; scoring sums the
conditional log-probabilities of all positions, a bucket's words each with their share of its count in the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64

GROUPS = 32
SIZE = GROUPS * GROUPS
BUCKETS = 96
DIM = 16
HIDDEN = 32
REACH = 2
SLICES = 16
STEP = 8192
ROWS = 2048

SHAPES = {"embed": (SIZE + 1, DIM), "into": (2 * REACH * DIM, HIDDEN), "bias": (HIDDEN,), "group": (HIDDEN, GROUPS), "gbias": (GROUPS,), "member": (GROUPS, HIDDEN, GROUPS), "mbias": (GROUPS, GROUPS)}
TOTAL = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def start(seed: int = 1) -> np.ndarray:
    p = unpack(np.zeros(TOTAL, np.float32))
    rng = np.random.default_rng(seed)
    for k in ("embed", "into", "group", "member"):
        p[k][...] = rng.normal(0, 0.1, p[k].shape)
    return np.concatenate([v.ravel() for v in p.values()])


def token_ids(h: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """vocabulary: sorted hashes, rank: their ids; other words go to the last BUCKETS ids by hash."""
    out = (SIZE - BUCKETS + (h % U64(BUCKETS)).astype(np.int64)).astype(np.int32)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[at] == h
        out[hit] = rank[at[hit]]
    return out


def contexts(ids: np.ndarray, first: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
    """The 2 * REACH neighbours of each token, or of those picked; SIZE stands for places outside its text."""
    pad = 2 * REACH
    lens = np.diff(first)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(lens)) * pad, lens) + REACH
    wide = np.full(len(ids) + pad * (len(lens) + 1), SIZE, np.int32)
    wide[place] = ids
    place = place if pick is None else place[pick]
    return np.stack([wide[place + d] for d in (*range(-REACH, 0), *range(1, REACH + 1))], 1)


TOP = np.float32(80)  # e ** 80 still fits 32 bits; only a diverged network has larger logits


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the rows and their sums."""
    e = np.exp(np.clip(x, -TOP, TOP))
    return e, e.sum(axis=1)  # the same for equal rows, wherever they lie


def _softmax(x: np.ndarray) -> np.ndarray:
    e, total = _exp(x)
    e /= total[:, None]
    return e


def _log_picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at one column of each row."""
    e, total = _exp(x)
    return np.log(e[np.arange(len(x)), at] / total)


def log_probabilities(p: dict, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log p(token | both sides) of every row."""
    out = np.empty(len(ids), np.float32)
    for s in range(0, len(ids), STEP):
        c, t = ctx[s : s + STEP], ids[s : s + STEP]
        order, cut = _by_group(t)
        c, t = np.take(c, order, axis=0), t[order]
        hid = np.tanh(np.take(p["embed"], c, axis=0).reshape(len(c), -1) @ p["into"] + p["bias"])
        part = _log_picked(hid @ p["group"] + p["gbias"], t // GROUPS)
        out[s : s + STEP][order] = part + _log_picked(_member_logits(p, hid, cut, t // GROUPS), t % GROUPS)
    return out


def _by_group(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their token's group, and where each group begins in it."""
    g = (ids // GROUPS).astype(np.int16)  # 16 bits are sorted by radix
    order = np.argsort(g, kind="stable")
    return order, np.searchsorted(g[order], np.arange(GROUPS + 1)).tolist()


def _member_logits(p: dict, hid: np.ndarray, cut: list[int], g: np.ndarray) -> np.ndarray:
    """Logits within the group of each row; the rows are in the order of their groups."""
    out = np.take(p["mbias"], g, axis=0)
    for k in range(GROUPS):
        i, j = cut[k], cut[k + 1]
        if i < j:
            out[i:j] += hid[i:j] @ p["member"][k]
    return out


def train_step(p: dict, squares: dict, ctx: np.ndarray, ids: np.ndarray, rate: float = 0.1) -> None:
    """One Adagrad step on the mean loss of the rows."""
    n = len(ids)
    order, cut = _by_group(ids)
    ctx, ids = np.take(ctx, order, axis=0), ids[order]
    rows = np.arange(n)
    x = np.take(p["embed"], ctx, axis=0).reshape(n, -1)
    hid = np.tanh(x @ p["into"] + p["bias"])
    g, m = ids // GROUPS, ids % GROUPS
    dg = _softmax(hid @ p["group"] + p["gbias"])
    dg[rows, g] -= 1
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["group"], grad["gbias"] = hid.T @ dg, dg.sum(0)
    dh = dg @ p["group"].T
    dm = _softmax(_member_logits(p, hid, cut, g))
    dm[rows, m] -= 1
    for k in range(GROUPS):
        i, j = cut[k], cut[k + 1]
        if i < j:
            grad["member"][k], grad["mbias"][k] = hid[i:j].T @ dm[i:j], dm[i:j].sum(0)
            dh[i:j] += dm[i:j] @ p["member"][k].T
    dh *= 1 - hid * hid
    grad["into"], grad["bias"] = x.T @ dh, dh.sum(0)
    dx = (dh @ p["into"].T).reshape(-1, DIM)
    flat = ctx.ravel().astype(np.int16)
    order = np.argsort(flat, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) != 0)))
    grad["embed"][flat[order[at]]] = np.add.reduceat(np.take(dx, order, axis=0), at, axis=0)
    for k in p:
        q = grad[k] / n
        squares[k] += q * q
        p[k] -= rate * q / (np.sqrt(squares[k]) + 1e-6)


def vocabulary_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hash and count of every word of the corpus."""

    def run(batches):
        for b in batches:
            parts = [np.unique(common.hash_words(data, offsets, lower=True)[0], return_counts=True) for _, _, data, offsets in common.text_blocks(b)]
            if parts:
                h, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(back, np.concatenate([c for _, c in parts]), len(h)).astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def turn_of(h: np.ndarray, place: np.ndarray, rounds: int) -> np.ndarray:
    """The round that masks each position."""
    return (common.mix(h + place.astype(U64)) % U64(rounds)).astype(np.int64)


def train(docs: DataFrame, rounds: int = 2, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, vocabulary, ranks). Every position of every text is masked in exactly one of the rounds (by a hash
    of word and place), so all are trained on. The driver gets the SIZE - BUCKETS most frequent words' hashes and, each round, one averaged
    parameter vector; the averages are formed by slices on the executors."""
    top = (vocabulary_counts(docs) if counts is None else counts).orderBy(F.desc("n"), "word").limit(SIZE - BUCKETS).collect()
    words = np.array([r[0] for r in top], np.int64).view(U64)
    order = np.argsort(words)
    vocabulary, rank = words[order], order.astype(np.int32)
    flat = start()

    for turn in range(rounds):
        now = flat

        def run(batches):
            own = now.copy()
            p = unpack(own)
            squares = {k: np.full_like(v, 1e-4) for k, v in p.items()}
            seen = 0
            wait: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for b in batches:
                for _, _, data, offsets in common.text_blocks(b):
                    h, _, _, first = common.hash_words(data, offsets, lower=True)
                    ids = token_ids(h, vocabulary, rank)
                    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                    pick = np.flatnonzero(turn_of(h, place, rounds) == turn)
                    if not len(pick):
                        continue
                    wait.append((contexts(ids, first, pick), ids[pick]))
                    size += len(pick)
                    if size >= 4 * STEP:
                        c, t = (np.concatenate(x) for x in zip(*wait))
                        mixed = np.random.default_rng(seen).permutation(len(t))
                        for s in range(0, len(t), ROWS):
                            train_step(p, squares, np.take(c, mixed[s : s + ROWS], axis=0), t[mixed[s : s + ROWS]])
                        seen, wait, size = seen + len(t), [], 0
            if size:
                c, t = (np.concatenate(x) for x in zip(*wait))
                for s in range(0, len(t), ROWS):
                    train_step(p, squares, c[s : s + ROWS], t[s : s + ROWS])
                seen += len(t)
            if seen:
                parts = np.array_split(own, SLICES)
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task] * SLICES, pa.int32()), pa.array([seen] * SLICES, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "task", "weight", "part"])

        def average(batches):
            sums: dict[int, list] = {}
            for b in batches:
                for s, w, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                    v = np.frombuffer(x.as_py(), np.float32).astype(np.float64) * w
                    if s in sums:
                        sums[s][0] += v
                        sums[s][1] += w
                    else:
                        sums[s] = [v, w]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(v / w).astype(np.float32).tobytes() for v, w in sums.values()], pa.binary())], names=["slice", "part"])

        local = docs.select("text").mapInArrow(run, "slice int, task int, weight long, part binary")
        got = local.repartition(SLICES, "slice").sortWithinPartitions("slice", "task").mapInArrow(average, "slice int, part binary").orderBy("slice").collect()
        if not got:
            break
        flat = np.concatenate([np.frombuffer(bytes(r[1]), np.float32) for r in got])
    return flat, vocabulary, rank


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob (summed over all positions), mean_log_prob for every row.

    ``counts`` is the vocabulary_counts of the trained corpus (of docs, if not given). A word of a hash bucket has the
    bucket's probability times its share n / (N + 1) of the bucket's N counted words; the share that is left, 1 / (N + 1),
    is for words that the corpus lacks. The scan gives one row per Arrow batch of texts with its distinct bucket words and
    the texts they stand in; only these words meet the counts, and their logarithms go back to their batch.
    Null and empty texts have no tokens, a sum of 0 and a null mean. Rows are scored as they come: repeated texts alike,
    null ids too.
    """
    flat, vocabulary, rank = model
    counts = common.checkpoint(vocabulary_counts(docs)) if counts is None else counts
    # the remainder of the word as an unsigned number
    bucket = F.pmod(F.pmod("word", F.lit(BUCKETS)) + F.when(F.col("word") < 0, (1 << 64) % BUCKETS).otherwise(0), F.lit(BUCKETS))
    rare = counts.where(~F.col("word").isin(vocabulary.view(np.int64).tolist())) if len(vocabulary) else counts
    held = np.zeros(BUCKETS)
    for k, n in rare.groupBy(bucket.alias("bucket")).agg(F.sum("n")).collect():
        held[k] = n
    rest = np.concatenate((np.zeros(SIZE - BUCKETS), np.log(held + 1)))

    def run(batches):
        p = unpack(flat.copy())
        for b in batches:
            lens, total, hashes, texts = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, U64)], [np.zeros(0, np.int32)]
            for i, j, data, offsets in common.text_blocks(b):
                h, _, _, first = common.hash_words(data, offsets, lower=True)
                ids = token_ids(h, vocabulary, rank)
                run_sum = np.concatenate(([0.0], np.cumsum(log_probabilities(p, contexts(ids, first), ids) - rest[ids], dtype=np.float64)))
                other = ids >= SIZE - BUCKETS
                lens.append(np.diff(first))
                total.append(run_sum[first[1:]] - run_sum[first[:-1]])
                hashes.append(h[other])
                texts.append(np.repeat(np.arange(i, j, dtype=np.int32), np.diff(first))[other])
            h, text = np.concatenate(hashes), np.concatenate(texts)
            order = np.argsort(h, kind="stable")
            words, at = np.unique(h[order], return_index=True)
            ends = np.append(at, len(h)).astype(np.int32) * 4
            places = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(text[order])])
            columns = [b.column(0), pa.array(np.concatenate(lens), pa.int64()), pa.array(np.concatenate(total)), pa.array(words.view(np.int64)), places]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["doc_id", "n_tokens", "log_prob", "word", "places"])

    def whole(texts: pa.Table, words: pa.Table) -> pa.Table:
        doc_id, n, total = (texts.column(c).combine_chunks().flatten() for c in ("doc_id", "n_tokens", "log_prob"))
        total = total.to_numpy().copy()
        if words.num_rows:
            v = words.column("v").to_numpy()
            raw = words.column("places").to_pylist()
            v = np.repeat(v, [len(x) // 4 for x in raw])
            order = np.argsort(v, kind="stable")  # the same sum whatever the order of arrival
            total += np.bincount(np.frombuffer(b"".join(raw), np.int32)[order], v[order], len(total))
        return pa.table({"doc_id": doc_id, "n_tokens": n, "log_prob": total})

    blocks = docs.select("doc_id", "text").mapInArrow(run, "doc_id array<long>, n_tokens array<long>, log_prob array<double>, word array<long>, places array<binary>")
    blocks = common.checkpoint(blocks.withColumn("block", F.monotonically_increasing_id()))
    words = blocks.select("block", F.explode(F.arrays_zip("word", "places")).alias("z")).select("block", "z.word", "z.places")
    # a word that occurs once adds log 1
    words = words.join(counts.where("n > 1"), "word").select(F.col("block").alias("home"), F.log("n").alias("v"), "places")
    texts = blocks.select("block", "doc_id", "n_tokens", "log_prob")
    out = texts.groupBy("block").cogroup(words.groupBy("home")).applyInArrow(whole, "doc_id long, n_tokens long, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    counts = common.checkpoint(vocabulary_counts(docs))
    return score(docs, train(docs, counts=counts), counts)
