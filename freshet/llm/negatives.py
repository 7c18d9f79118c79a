"""Hard-negative mining by dual-tree search.

Rows lie in cells, the leaves of a tree over a bounded sample, and cells in chunks. An anchor goes to the chunks of those cells
whose inner-product interval can still change its result. In a chunk a tree over the candidates meets a tree over the
anchors: intervals of node pairs, from boxes, prune whole anchor groups; leaf pairs are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

CHUNK = 4096
CELLS = 1024
SAMPLE = 4096
LEAF = 64
GROUP = 16
ANCHORS = 1024
ROUTED = 8192
LOWEST, HIGHEST = -(2**62), 2**62


def box_bounds(alo, ahi, clo, chi):
    """(lowest, highest) inner products of the boxes' points, each against each; integer or float as the boxes are."""
    a, b = alo[:, None], ahi[:, None]
    p = np.stack((a * clo, a * chi, b * clo, b * chi))
    return p.min(axis=0).sum(axis=-1), p.max(axis=0).sum(axis=-1)


class BoxTree:
    """A binary tree of equal halves over rows; leaves hold ``leaf`` rows or fewer.

    A node with several labels is cut along the order of the labels, any other along the coordinate that varies most. ``cuts[l]``
    are the starts of level l's nodes in ``order``; each node has its box, and the lowest and highest label below it.
    """

    def __init__(self, v: np.ndarray, label: np.ndarray, leaf: int):
        self.order = np.arange(len(v))
        cuts = np.array([0, len(v)])
        self.cuts = [cuts[:-1]]
        while (np.diff(cuts) > leaf).any():
            mid = (cuts[:-1] + cuts[1:]) // 2
            for a, m, b in zip(cuts[:-1].tolist(), mid.tolist(), cuts[1:].tolist()):
                own = self.order[a:b]
                labels = label[own]
                by = labels if labels.min() < labels.max() else v[own, int(np.argmax(np.ptp(v[own], axis=0)))] if v.shape[1] else labels
                self.order[a:b] = own[np.argpartition(by, m - a)]
            cuts = np.sort(np.concatenate((cuts, mid)))
            self.cuts.append(cuts[:-1])
        x, y = v[self.order], label[self.order]
        self.low, self.high, self.least, self.most = ([f.reduceat(z, c, axis=0) for c in self.cuts] for f, z in ((np.minimum, x), (np.maximum, x), (np.minimum, y), (np.maximum, y)))
        self.ends = [np.append(c[1:], len(v)) for c in self.cuts]


def exact_type(v: np.ndarray) -> type:
    """float64 where every sum of products is a whole number that it holds exactly, else int64."""
    top = float(np.abs(v).max(initial=0))
    return np.float64 if top * top * max(1, v.shape[1]) < 2**52 else np.int64


class Windows:
    """For anchors in windows low <= score <= high the k best scores so far; ``floor`` is what a score must reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.top = np.full((*low.shape, k), LOWEST, np.int64)
        self.floor = np.maximum(low, floor)

    def add(self, rows: np.ndarray, score: np.ndarray, fits: np.ndarray):
        """(anchor, window, candidate) places among score[anchor, candidate] of those rows that may be in the result."""
        ok = fits[:, None] & (score[:, None] <= self.high[rows][:, :, None]) & (score[:, None] >= self.floor[rows][:, :, None])
        if ok.any():
            every = np.concatenate((self.top[rows], np.where(ok, score[:, None], LOWEST)), axis=2)
            self.top[rows] = np.partition(every, every.shape[2] - self.k, axis=2)[:, :, -self.k :]
            self.floor[rows] = np.maximum(self.floor[rows], self.top[rows].min(axis=2))
            ok &= score[:, None] >= self.floor[rows][:, :, None]
        return np.nonzero(ok)

    def wants(self, rows: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
        """Whether scores from lowest to highest can change the result of any of the anchors ``rows``."""
        return highest >= self.floor[rows].min() if lowest is None else (highest >= self.floor[rows].min()) & (lowest <= self.high[rows].max())


def dual_search(tree: BoxTree, cand, anchors, windows: Windows, same: bool):
    """(anchor, window, candidate, score) of all that may be in an anchor's windows, from cand and anchors (ids, labels, vectors).

    Same label only (and another id), or different labels only. Node pairs are taken level by level; a pair that cannot
    change any result of its anchors goes. Leaves then come by their highest product, and the rest of a group's leaves
    goes as soon as they cannot reach the scores found.
    """
    ids, labels, v = cand
    aids, alabels, av = anchors
    kind = np.float64 if exact_type(v) is np.float64 and exact_type(av) is np.float64 else np.int64
    mine = BoxTree(av, alabels, GROUP)
    levels = max(len(tree.cuts), len(mine.cuts))
    a, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    out = []
    bounds = {}
    for step in range(levels):
        la, lc = min(step, len(mine.cuts) - 1), min(step, len(tree.cuts) - 1)
        keep = np.zeros(len(a), bool)
        highest = np.zeros(len(a))
        for g in np.unique(a).tolist():
            at = np.flatnonzero(a == g)
            n = c[at]
            lo, hi = box_bounds(*(x[la][g][None].astype(np.float64) for x in (mine.low, mine.high)), *(x[lc][n].astype(np.float64) for x in (tree.low, tree.high)))
            lo, hi = lo[0] - 1 - 1e-9 * np.abs(lo[0]), hi[0] + 1 + 1e-9 * np.abs(hi[0])
            rows = mine.order[mine.cuts[la][g] : mine.ends[la][g]]
            ok = windows.wants(rows, lo, hi)
            if same:
                ok &= (tree.least[lc][n] <= mine.most[la][g]) & (tree.most[lc][n] >= mine.least[la][g])
            else:
                ok &= ~((tree.least[lc][n] == tree.most[lc][n]) & (mine.least[la][g] == mine.most[la][g]) & (tree.least[lc][n] == mine.least[la][g]))
            keep[at], highest[at] = ok, hi
        a, c, highest = a[keep], c[keep], highest[keep]
        if step == levels - 1:
            bounds = highest
            break
        ka = 2 if step + 1 < len(mine.cuts) else 1
        kc = 2 if step + 1 < len(tree.cuts) else 1
        below = [(a * ka + i, c * kc + j) for i in range(ka) for j in range(kc)]
        a, c = np.concatenate([x for x, _ in below]), np.concatenate([y for _, y in below])
    for g in np.unique(a).tolist():
        rows = mine.order[mine.cuts[-1][g] : mine.ends[-1][g]]
        at = np.flatnonzero(a == g)
        at = at[np.argsort(-bounds[at], kind="stable")]
        step = 8
        while len(at):
            at = at[windows.wants(rows, None, bounds[at])]
            some, at = c[at[:step]], at[step:]
            if not len(some):
                break
            own = np.concatenate([tree.order[tree.cuts[-1][n] : tree.ends[-1][n]] for n in some.tolist()])
            score = (av[rows].astype(kind) @ v[own].astype(kind).T).astype(np.int64)
            equal = labels[own][None] == alabels[rows][:, None]
            fits = equal & (ids[own][None] != aids[rows][:, None]) if same else ~equal
            i, w, j = windows.add(rows, score, fits)
            out.append((rows[i], w, own[j], score[i, j]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    i, w, j, s = (np.concatenate(x) for x in zip(*out))
    keep = s >= windows.floor[i, w]
    i, w, j, s = i[keep], w[keep], j[keep], s[keep]
    order = np.lexsort((ids[j], -s, w, i))
    i, w, j, s = i[order], w[order], j[order], s[order]
    key = i * windows.low.shape[1] + w
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else key
    best = np.arange(len(key)) - start < windows.k
    return i[best], w[best], j[best], s[best]


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as int64, shorter ones padded with zeros."""
    offsets = np.asarray(col.offsets, np.int64)
    flat = np.asarray(col.values, np.int64)[offsets[0] : offsets[-1]] if len(col) else np.zeros(0, np.int64)
    size = np.diff(offsets)
    if len(size) and (size == d).all():
        return flat.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def quantised(rows: DataFrame, scale: int = 256) -> tuple[DataFrame, int]:
    """(vec_id, label, v) with v = floor(scale * x), and the longest v. Rows with a null id, label or vector, or with a null or
    non-finite component, are left out; of rows that repeat an id the one of smallest label, then vector, stays."""
    x = F.col("embedding")
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(whole)
    d = max(1, kept.agg(F.max(F.size(x))).first()[0] or 1)
    most = int((2.0**62 / d) ** 0.5)
    ints = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(float(-most))), F.lit(float(most)))).cast("long"))
    pairs = kept.select(F.col("vec_id").cast("long"), F.struct(F.col("label").cast("long").alias("label"), ints.alias("v")).alias("r"))
    one = pairs.groupBy("vec_id").agg(F.min("r").alias("r"))
    return common.checkpoint(one.select("vec_id", "r.label", "r.v")), d


class Index:
    """All rows in cells and chunks: v(vec_id, label, v, cell, chunk), the cells' boxes, chunks of each, and a sample of the rows.

    The sample (the ``SAMPLE`` rows of smallest id hash) places the cells' cuts and gives first bounds of the results; every row is
    in the index. Cells number ``CELLS`` at most, so their boxes have a fixed bound. A cell's rows are dealt by a hash to chunks
    of about ``CHUNK`` rows, so a cell of a third of all rows is many chunks.
    """

    def __init__(self, rows: DataFrame, d: int):
        self.d = d
        n = rows.count()
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "label", "v").toArrow().combine_chunks()
        self.sample = self._parts(picked)
        cells = min(CELLS, max(1, n // CHUNK))
        tree = self.tree = BoxTree(self.sample[2], np.zeros(len(self.sample[1]), np.int64), max(1, -(-len(self.sample[1]) // cells))) if n else None
        centres = (tree.low[-1] + tree.high[-1]) / 2 if n else np.zeros((1, d))
        d_ = d

        def place(batches):
            for b in batches:
                v = _matrix(b.column(2), d_).astype(np.float64)
                near = np.argmin((centres**2).sum(axis=1) - 2 * v @ centres.T, axis=1) if len(v) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["vec_id", "label", "v", "cell"])

        self.cells = common.checkpoint(rows.select("vec_id", "label", "v").mapInArrow(place, "vec_id long, label long, v array<long>, cell int"))

        def boxes(batches):
            lo, hi, size = {}, {}, {}
            for b in batches:
                v, cell = _matrix(b.column(0), d_), np.asarray(b.column(1))
                for c in np.unique(cell).tolist():
                    x = v[cell == c]
                    lo[c] = np.minimum(lo.get(c, HIGHEST), x.min(axis=0))
                    hi[c] = np.maximum(hi.get(c, LOWEST), x.max(axis=0))
                    size[c] = size.get(c, 0) + len(x)
            for c in lo:
                yield pa.RecordBatch.from_arrays([pa.array([c] * d_, pa.int32()), pa.array(range(d_), pa.int32()), pa.array(lo[c], pa.int64()), pa.array(hi[c], pa.int64()), pa.array([size[c]] * d_, pa.int64())], names=["cell", "k", "lo", "hi", "n"])

        found = self.cells.select("v", "cell").mapInArrow(boxes, "cell int, k int, lo long, hi long, n long").groupBy("cell", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        table = found.orderBy("cell", "k").toArrow().combine_chunks()
        cell = np.asarray(table["cell"]).reshape(-1, d)[:, 0]
        count = len(centres)
        self.low, self.high, self.chunks = np.zeros((count, d)), np.zeros((count, d)), np.zeros(count, np.int64)
        self.low[cell], self.high[cell] = (np.asarray(table[x], np.float64).reshape(-1, d) for x in ("lo", "hi"))
        self.chunks[cell] = -(-np.asarray(table["n"]).reshape(-1, d)[:, 0] // CHUNK)

    def _parts(self, t):
        return np.asarray(t["vec_id"], np.int64), np.asarray(t["label"], np.int64), _matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], self.d)

    def rows(self) -> DataFrame:
        """cell, chunk, kind = 0, and a candidate."""
        chunks = F.element_at(F.array(*[F.lit(int(max(1, x))) for x in self.chunks]), F.col("cell") + 1)
        return self.cells.select("cell", F.pmod(F.xxhash64("vec_id"), chunks).cast("int").alias("chunk"), F.lit(0).alias("kind"), "vec_id", "label", "v", F.array().cast("array<long>").alias("low"), F.array().cast("array<long>").alias("high"), F.array().cast("array<long>").alias("floor"))

    def routed(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """cell, chunk, kind = 1, and an anchor with its windows (arrays low and high): a row for each chunk it has to visit."""
        d, chunks, sample, clo, chi = self.d, self.chunks, self.sample, self.low, self.high
        some = np.flatnonzero(chunks)

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, ANCHORS):
                    p = b.slice(at, ANCHORS)
                    if not p.num_rows:
                        continue
                    ids, labels, v = np.asarray(p.column(0)), np.asarray(p.column(1)), _matrix(p.column(2), d)
                    low, high = _windows(p.column(3)), _windows(p.column(4))
                    windows = Windows(low, high, np.full(low.shape, LOWEST), k)
                    dual_search(BoxTree(sample[2], sample[1], LEAF), sample, (ids, labels, v), windows, same)
                    groups = BoxTree(v, labels, GROUP)
                    for g, (x, y) in enumerate(zip(groups.cuts[-1].tolist(), groups.ends[-1].tolist())):
                        own = groups.order[x:y]
                        lo, hi = box_bounds(groups.low[-1][g][None].astype(float), groups.high[-1][g][None].astype(float), clo[some], chi[some])
                        wanted = some[windows.wants(own, lo[0] - 1 - 1e-9 * np.abs(lo[0]), hi[0] + 1 + 1e-9 * np.abs(hi[0]))]
                        floors = pa.array(windows.floor[own].tolist(), pa.list_(pa.int64()))
                        # a row for each chunk of each cell and anchor of the group, in batches of ROUTED
                        cell, chunk = np.repeat(wanted, chunks[wanted]), np.arange(chunks[wanted].sum()) - np.repeat(np.cumsum(chunks[wanted]) - chunks[wanted], chunks[wanted])
                        step = max(1, ROUTED // len(own))
                        for s in range(0, len(cell), step):
                            c, h = cell[s : s + step], chunk[s : s + step]
                            r = np.tile(np.arange(len(own)), len(c))
                            out = p.take(pa.array(own[r]))
                            places = [pa.array(np.repeat(z, len(own)), pa.int32()) for z in (c, h)]
                            yield pa.RecordBatch.from_arrays([*places, pa.array(np.ones(len(r)), pa.int32()), *out.columns, floors.take(pa.array(r))], names=FIELDS)

        return anchors.select("vec_id", "label", "v", "low", "high").mapInArrow(run, "cell int, chunk int, kind int, vec_id long, label long, v array<long>, low array<long>, high array<long>, floor array<long>")

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor_id, window, vec_id, score): the k first rows, by score descending, then id, in each window of anchors(vec_id,
        label, v, low, high) among the rows of the same label and another id, or of other labels."""
        n = int(self.cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        d = self.d

        def run(batches):
            at, held, tree, cand = None, [], None, None
            for b in batches:
                key = np.stack([np.asarray(b.column(i), np.int64) for i in range(3)])
                cuts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))) if b.num_rows else []
                for x, y in zip(cuts, np.append(cuts[1:], b.num_rows)):
                    p = b.slice(int(x), int(y - x))
                    if (own := tuple(key[:2, x].tolist())) != at:
                        at, held, tree = own, [], None
                    if key[2, x] == 0:
                        held.append((np.asarray(p.column(3)), np.asarray(p.column(4)), _matrix(p.column(5), d)))
                        continue
                    if not held:
                        continue
                    if tree is None:
                        cand = tuple(np.concatenate(z) for z in zip(*held))
                        tree = BoxTree(cand[2], cand[1], LEAF)
                    for s in range(0, p.num_rows, ANCHORS):
                        q = p.slice(s, ANCHORS)
                        ids = np.asarray(q.column(3))
                        low, high, floor = (_windows(q.column(i)) for i in (6, 7, 8))
                        i, w, j, score = dual_search(tree, cand, (ids, np.asarray(q.column(4)), _matrix(q.column(5), d)), Windows(low, high, floor, k), same)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(w, pa.int32()), pa.array(cand[0][j], pa.int64()), pa.array(score, pa.int64())], names=["anchor_id", "window", "vec_id", "score"])

        rows = self.rows().unionByName(self.routed(anchors, k, same))
        found = rows.repartition(n, "cell", "chunk").sortWithinPartitions("cell", "chunk", "kind").mapInArrow(run, "anchor_id long, window int, vec_id long, score long")
        order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FIELDS = ["cell", "chunk", "kind", "vec_id", "label", "v", "low", "high", "floor"]


def _windows(col: pa.Array) -> np.ndarray:
    """A list column whose rows are equally long within a batch, or padded with windows that nothing fits."""
    size = np.diff(np.asarray(col.offsets, np.int64))
    width = int(size.max(initial=1))
    if (size == width).all():
        return _matrix(col, width)
    out = np.full((len(size), width), HIGHEST, np.int64)
    for i, v in enumerate(col.to_pylist()):
        out[i, : len(v)] = v
    return out


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vectors(vec_id, label, embedding).

    Scores are inner products of the components floor(scale * x). For each row that ``anchors`` (a condition on vec_id) picks,
    its positives are the first rows of the same label and another id; for each of them the first rows of other labels whose
    score lies between least and most per cent of the positive's. Higher scores come first, ties by smaller vec_id.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; of rows that repeat an id
    the one of smallest label, then vector, does. Vectors of fewer components count as padded with zeros. Scaled components
    are held within the square root of 2^62 / dimension, so that no score leaves 64 bits. An anchor without positives,
    or with a positive that no row fits (all with a negative score), has no rows for it; an empty table gives none.
    """
    rows, d = quantised(vectors, scale)
    index = Index(rows, d)
    asked = rows.where(anchors)
    whole = asked.withColumns({"low": F.array(F.lit(LOWEST)), "high": F.array(F.lit(HIGHEST))})
    found = common.checkpoint(index.search(whole, positives, same=True))
    per = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score"))).alias("p"))
    low = F.transform("p", lambda p: -_floor_div(-p["score"] * least, 100))
    high = F.transform("p", lambda p: _floor_div(p["score"] * most, 100))
    windows = asked.join(per, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", low.alias("low"), high.alias("high"))
    best = index.search(windows, negatives, same=False)
    named = found.select(F.col("anchor_id"), (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.select("anchor_id", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _floor_div(x: Column, by: int) -> Column:
    """Whole part of x / by, rounded down, without loss for any 64-bit x."""
    scaled = x.cast("decimal(38,0)")
    return F.floor(scaled / by).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
