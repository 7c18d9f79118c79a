"""Substring deduplication with a compressed FM-index per shard.

Every window of ``WINDOW`` words is routed by its minimizer (the smallest hash of its 4-word grams), so equal
windows lie in one shard wherever they occur. Only minimizers that several different texts share are followed.
A shard indexes its distinct segments (BWT in a wavelet matrix with packed bits and rank blocks), backward search
gives each window's interval, and the smallest document of the interval decides what is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64
from .decontam import bit_set, dense, has

WINDOW = 13
GRAM = 4
DEPTH = 16
SHARD_WORDS = 100_000
HOT = 20_000
BITS = 1 << 24


def _segments(h: np.ndarray, first: np.ndarray):
    """(text, first window, last window, anchor) of each run of windows with one minimizer, texts apart."""
    none = np.zeros(0, np.int64)
    span = WINDOW - GRAM + 1
    g = common.grams(h, GRAM)
    if len(g) < span:
        return none, none, none, np.zeros(0, U64)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.concatenate([view[i : i + 65536].argmin(axis=1) for i in range(0, len(view), 65536)]) + np.arange(len(view))
    text = np.searchsorted(first, np.arange(len(view)), "right") - 1
    ok = np.arange(len(view)) + WINDOW <= first[np.minimum(text + 1, len(first) - 1)]
    w = np.flatnonzero(ok)
    if not len(w):
        return none, none, none, np.zeros(0, U64)
    new = np.concatenate(([True], (at[w[1:]] != at[w[:-1]]) | (text[w[1:]] != text[w[:-1]])))
    lo = w[new]
    hi = w[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(w) - 1]))]
    return text[lo], lo, hi, g[at[lo]]


def _anchors(batches):
    """(anchor, text_hash, doc_id, lead): the distinct anchors of each text; its smallest one leads."""
    for b in batches:
        ids, hashes = np.asarray(b.column(0)), np.asarray(b.column(2))
        for i, j, data, offsets in common.text_blocks(b):
            h, _, _, first = common.hash_words(data, offsets)
            text, _, _, anchor = _segments(h, first)
            if not len(text):
                continue
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            fresh = np.concatenate(([True], text[1:] != text[:-1]))
            keep = fresh | np.concatenate(([True], anchor[1:] != anchor[:-1]))
            text, anchor, fresh = text[keep], anchor[keep], fresh[keep]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(hashes[i + text]), pa.array(ids[i + text]), pa.array(fresh)], names=["anchor", "text_hash", "doc_id", "lead"])


def _repeated(batches):
    """From rows sorted by (anchor, text_hash, doc_id): the first document of each text where several texts share
    the anchor, and, at the leading anchor, each later document of one text as a copy."""
    state = None  # anchor, text_hash, first document of that text, whether the anchor has several texts
    for b in batches:
        if not b.num_rows:
            continue
        a, t, d, lead = (np.asarray(b.column(k)) if k < 3 else np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in range(4))
        new_a = np.concatenate(([state is None or a[0] != state[0]], a[1:] != a[:-1]))
        new_c = new_a | np.concatenate(([state is None or t[0] != state[1]], t[1:] != t[:-1]))
        c = np.flatnonzero(new_c)
        rank = np.cumsum(new_c) - 1
        head = np.where(rank >= 0, d[c[np.maximum(rank, 0)]] if len(c) else 0, state[2] if state else 0)
        copies = np.flatnonzero(lead & (d != head))
        out = [(d[copies], t[copies], a[copies], np.ones(len(copies), bool))]
        multi = bool(state and state[3])
        if len(c):
            run = np.cumsum(new_a[c]) - (1 if new_a[c[0]] else 0)  # 0: goes on with the state's anchor, if any
            if new_a[c[0]]:
                sizes = np.bincount(run)
                several = sizes[run] > 1
            else:
                sizes = np.bincount(run)
                sizes[0] += 1
                several = sizes[run] > 1
                if not multi:
                    out.append(tuple(np.array([x]) for x in (state[2], state[1], state[0])) + (np.zeros(1, bool),))
            last = run[-1]
            held = (run == last) & ~several
            emit = c[several]
            out.append((d[emit], t[emit], a[emit], np.zeros(len(emit), bool)))
            multi = bool(several[-1])
            del held
        state = (a[-1], t[-1], head[-1], multi)
        rows = [np.concatenate([x[k] for x in out]) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.bool_())], names=["doc_id", "text_hash", "anchor", "copied"])


def _marked(b, i: int, first: np.ndarray, text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """For each segment of the texts from row i on, how many splits its anchor has; 0 without a mark on its text."""
    marks, cuts = np.asarray(b.column(3).values).view(U64), np.asarray(b.column(3).offsets)
    hot, hot_cuts = b.column(4).values, np.asarray(b.column(4).offsets)
    hot_marks, hot_splits = np.asarray(hot.field(0)).view(U64), np.asarray(hot.field(1))
    splits = np.zeros(len(text), np.int64)
    edges = np.searchsorted(text, np.arange(len(first)))
    for k in range(len(first) - 1):
        x, y = edges[k], edges[k + 1]
        if y > x:
            splits[x:y] = np.isin(anchor[x:y], marks[cuts[i + k] : cuts[i + k + 1]])
            for q in range(hot_cuts[i + k], hot_cuts[i + k + 1]):
                splits[x:y][anchor[x:y] == hot_marks[q]] = hot_splits[q]
    return splits


def _names(whole: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Keys of segments by the hashes of their first and last window and their number of windows."""
    return common.mix(whole[lo] * U64(0x9E3779B97F4A7C15) + whole[hi] + (hi - lo).astype(U64)).view(np.int64)


def _hot_windows(hot: tuple):
    """(h, text_hash): the single windows at anchors that may be in the bit set ``hot``, each once for its text."""

    def run(batches):
        bits = dense(hot, BITS)
        for b in batches:
            hashes = np.asarray(b.column(2))
            for i, _, data, offsets in common.text_blocks(b):
                h, _, _, first = common.hash_words(data, offsets)
                text, lo, hi, anchor = _segments(h, first)
                held = has(bits, anchor)
                text, lo, hi = text[held], lo[held], hi[held]
                if not len(text):
                    continue
                n = hi - lo + 1
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs = np.unique(np.stack((np.repeat(text, n), _names(common.grams(h, WINDOW), at, at)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(hashes[i + pairs[:, 0]])], names=["h", "text_hash"])

    return run


def _cut(shards: int, repeated: tuple, frequent: tuple):
    """Segments at the marked anchors: kind 0 has the words, for the index, kind 1 the places in a document, as runs (first
    and last, int32) of places no more than WINDOW apart.

    A segment has at most WINDOW - GRAM + 1 windows, so its first and last window cover it and their hashes name it.
    At a hot anchor (more than one split) a segment is cut into its windows, each dealt to the one shard of its own hash, words
    and places; windows that no other text has stay behind. Only a window that is hot itself is split: its places by their
    document, its words to every split. ``repeated`` and ``frequent`` are bit sets of fixed size over the windows at hot
    anchors that several texts, or more than HOT, have; where one says so wrongly, more rows travel and nothing else changes.
    Equal segments go to the index once a task (again only for a smaller document), as far as a bounded table goes.
    """

    def run(batches):
        several, often = dense(repeated, BITS), dense(frequent, BITS)
        lowest: dict[int, int] = {}
        for b in batches:
            ids, hashes = np.asarray(b.column(0)), np.asarray(b.column(2))
            for i, _, data, offsets in common.text_blocks(b):
                h, s, e, first = common.hash_words(data, offsets)
                text, lo, hi, anchor = _segments(h, first)
                splits = _marked(b, i, first, text, anchor)
                held = splits > 0
                text, lo, hi, anchor, splits = text[held], lo[held], hi[held], anchor[held], splits[held]
                if not len(text):
                    continue
                alone = splits > 1
                n = np.where(alone, hi - lo + 1, 1)
                if alone.any():
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    text, anchor, splits, alone = (np.repeat(v, n) for v in (text, anchor, splits, alone))
                    lo = np.repeat(lo, n) + step
                    hi = np.where(alone, lo, np.repeat(hi, n))
                key = _names(common.grams(h, WINDOW), lo, hi)
                if alone.any():
                    held = ~alone | has(several, key.view(U64))
                    text, lo, hi, anchor, splits, alone, key = (v[held] for v in (text, lo, hi, anchor, splits, alone, key))
                    splits = np.where(alone & ~has(often, key.view(U64)), 1, splits)
                    if not len(text):
                        continue
                doc = ids[i + text]
                spot = np.where(alone, common.mix(key.view(U64)), anchor)  # shard of split 0; the next splits follow by steps of their own
                order = np.lexsort((lo, text, key))
                key, doc, spot, splits, text, lo, hi = (v[order] for v in (key, doc, spot, splits, text, lo, hi))
                fresh = np.concatenate(([True], key[1:] != key[:-1]))
                each = fresh | np.concatenate(([True], text[1:] != text[:-1]))
                own = np.flatnonzero(each)
                run = np.flatnonzero(each | np.concatenate(([True], np.diff(lo) > WINDOW)))  # what nearer places remove is one piece
                ends = np.append(run[1:], len(key)) - 1
                pairs = np.stack([lo[run] - first[text[run]], lo[ends] - first[text[run]]], 1).astype(np.int32).tobytes()
                at = np.append(np.searchsorted(run, own), len(run)).tolist()
                places = [pairs[8 * x : 8 * y] for x, y in zip(at, at[1:])]
                split = common.mix(doc[own].astype(np.int64).view(U64)) % splits[own].astype(U64)
                yield _rows(_shard(spot[own], split, shards), np.ones(len(own), np.int32), key[own], doc[own], hashes[i + text[own]], places)
                fresh = np.flatnonzero(fresh)
                lowest_here = np.minimum.reduceat(doc, fresh)
                doc = doc.copy()
                doc[fresh] = lowest_here
                new = [q for q, k, d in zip(fresh.tolist(), key[fresh].tolist(), doc[fresh].tolist()) if lowest.get(k, d + 1) > d]
                lowest.update(zip(key[new].tolist(), doc[new].tolist()))
                if new:
                    words = [data[s[x] : e[y + WINDOW - 1]].tobytes() for x, y in zip(lo[new].tolist(), hi[new].tolist())]
                    new = np.array(new)
                    for split in range(int(splits[new].max())):
                        to = np.flatnonzero(splits[new] > split)
                        at = new[to]
                        yield _rows(_shard(spot[at], np.full(len(at), split, U64), shards), np.zeros(len(at), np.int32), key[at], doc[at], np.zeros(len(at), np.int64), [words[t] for t in to.tolist()])
                if len(lowest) > 500_000:
                    lowest.clear()

    return run


def _shard(spot: np.ndarray, split: np.ndarray, shards: int) -> np.ndarray:
    return (np.where(split > 0, common.mix(spot + split.astype(U64)), spot) % U64(shards)).astype(np.int64)


def _rows(shard, kind, key, doc, text_hash, data) -> pa.RecordBatch:
    columns = [pa.array(shard), pa.array(kind), pa.array(key), pa.array(doc), pa.array(text_hash), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "kind", "key", "doc_id", "text_hash", "data"])


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit row a level, with a running count every 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        cur = seq.astype(np.int64)
        for b in range(self.levels - 1, -1, -1):
            bit = ((cur >> b) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, np.uint8))), bitorder="little").view(U64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(len(bit) - bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        every = np.arange(sigma)
        self.base = self.place(every, np.zeros(sigma, np.int64))

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            q = i >> 6
            ones = self.counts[k][q] + np.bitwise_count(self.words[k][q] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        return self.place(c, i) - self.base[c]


class FMIndex:
    """Backward search over word sequences; suffixes are ordered by their first DEPTH words, enough for patterns up to that."""

    def __init__(self, segments: list[np.ndarray]):
        """segments: word hashes; a separator smaller than every word ends each."""
        flat = np.concatenate(segments)
        self.alphabet, ids = np.unique(flat, return_inverse=True)
        ends = np.cumsum([len(s) for s in segments])
        seq = np.insert(ids + 1, ends, 0)
        self.sigma = len(self.alphabet) + 1
        rank, step = seq.astype(np.int64), 1
        while step < DEPTH:
            nxt = np.zeros(len(rank), np.int64)
            nxt[:-step] = rank[step:] + 1 if step < len(rank) else 0
            rank = np.unique(rank * (int(rank.max()) + 2) + nxt, return_inverse=True)[1]
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        self.sequence = seq.astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=self.sigma))))
        self.bwt = WaveletMatrix(seq[self.suffixes - 1], self.sigma)

    def search(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns of ``length`` words at the given places of the indexed sequence."""
        c = self.sequence[starts + length - 1]
        lo, hi = self.first[c], self.first[c + 1]
        for k in range(length - 2, -1, -1):
            c = self.sequence[starts + k]
            lo, hi = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
        return lo, hi


def window_owners(words: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
    """For each segment, the smallest document in which each of its windows starts, found in the FM-index of all."""
    index = FMIndex(words)
    sizes = np.array([len(w) for w in words])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    counts = sizes - WINDOW + 1
    where = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    owner = np.repeat(docs, sizes + 1)[index.suffixes]
    lo = np.empty(len(where), np.int64)
    hi = np.empty(len(where), np.int64)
    for s in range(0, len(where), 1 << 17):
        lo[s : s + (1 << 17)], hi[s : s + (1 << 17)] = index.search(where[s : s + (1 << 17)], WINDOW)
    spans, back = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
    least = np.minimum.reduceat(np.append(owner, np.iinfo(np.int64).max), spans.ravel())[::2]
    return np.split(least[back.ravel()], np.cumsum(counts)[:-1])


class _Shard:
    """Distinct segments of a shard, then the owners of their windows, by key."""

    def __init__(self):
        self.words: dict[int, bytes] = {}
        self.docs: dict[int, int] = {}
        self.keys = None

    def add(self, key: list[int], doc: list[int], words: list[bytes]) -> None:
        for k, d, w in zip(key, doc, words):
            self.words[k] = w
            self.docs[k] = min(d, self.docs.get(k, d))

    def close(self) -> None:
        keys = sorted(self.words)
        joined = b"\n".join(self.words[k] for k in keys)
        offsets = np.concatenate(([0], np.cumsum([len(self.words[k]) + 1 for k in keys])))
        offsets[-1] -= 1
        h, _, _, first = common.hash_words(np.frombuffer(joined, np.uint8), offsets)
        owners = window_owners([h[first[i] : first[i + 1]] for i in range(len(keys))], np.array([self.docs[k] for k in keys], np.int64))
        self.keys = np.array(keys, np.int64)
        self.counts = np.array([len(x) for x in owners])
        self.begin = np.concatenate(([0], np.cumsum(self.counts)[:-1]))
        self.owners = np.concatenate(owners)
        self.words, self.docs = {}, {}

    def hits(self, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each place that a smaller document owns; last is -1 where there is none."""
        at = np.searchsorted(self.keys, key)
        n = self.counts[at]
        edge = np.concatenate(([0], np.cumsum(n)[:-1]))
        window = np.arange(int(n.sum())) - np.repeat(edge, n)
        hit = self.owners[np.repeat(self.begin[at], n) + window] < np.repeat(doc, n)
        return np.minimum.reduceat(np.where(hit, window, WINDOW), edge), np.maximum.reduceat(np.where(hit, window, -1), edge)


def _search(batches):
    """From rows sorted by (shard, kind): (doc_id, text_hash, start, end) of the words to remove."""
    shard, now = None, _Shard()
    for b in batches:
        s, kind, key, doc, text_hash = (np.asarray(b.column(k)) for k in range(5))
        if not len(s):
            continue
        cuts = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (kind[1:] != kind[:-1])))).tolist() + [len(s)]
        out = []
        for x, y in zip(cuts, cuts[1:]):
            if s[x] != shard:
                shard, now = s[x], _Shard()
            if kind[x] == 0:
                now.add(key[x:y].tolist(), doc[x:y].tolist(), b.column(5)[x:y].to_pylist())
                continue
            if now.keys is None:
                now.close()
            lo, hi = now.hits(key[x:y], doc[x:y])
            q = np.flatnonzero(hi >= 0)
            if len(q):
                places = b.column(5).slice(x, y - x).take(pa.array(q)).to_pylist()
                n = np.array([len(v) // 8 for v in places])
                ends = np.frombuffer(b"".join(places), np.int32).astype(np.int64).reshape(-1, 2)
                out.append((np.repeat(doc[x:y][q], n), np.repeat(text_hash[x:y][q], n), ends[:, 0] + np.repeat(lo[q], n), ends[:, 1] + np.repeat(hi[q] + WINDOW, n)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(4)], names=["doc_id", "text_hash", "start", "end"])


def _keep(batches):
    for b in batches:
        ids, spans, copied = b.column(0), b.column(2), b.column(3).to_pylist()
        n, gone, sha = [], [], []
        for i, j, data, offsets in common.text_blocks(b):
            for k in range(j - i):
                words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                n.append(len(words))
                kept = words
                if copied[i + k]:
                    kept = []
                elif spans[i + k].is_valid:
                    off = np.zeros(len(words), bool)
                    for x in spans[i + k].as_py():
                        off[x["start"] : x["end"]] = True
                    kept = [w for w, o in zip(words, off) if not o]
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, copies): (doc_id, text_hash, start, end) in words, and (doc_id, text_hash) of later exact copies.

    Rows with null id or fewer than 13 words take no part. Of equal texts the smallest id stands for all. Repeated
    segments travel once a task to their shard, their places as small rows that are streamed there; the windows at an anchor of
    more than HOT texts are spread over the shards one by one (see _cut).
    """
    rows = docs.select("doc_id", "text", common.unicode_hash().alias("text_hash")).where("doc_id is not null")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.mapInArrow(_anchors, "anchor long, text_hash long, doc_id long, lead boolean").repartition(n, "anchor").sortWithinPartitions("anchor", "text_hash", "doc_id")
    marks = common.checkpoint(found.mapInArrow(_repeated, "doc_id long, text_hash long, anchor long, copied boolean"))
    copies = marks.where("copied").select("doc_id", "text_hash").distinct()
    marks = marks.where("not copied")
    hot = common.checkpoint(marks.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", (F.ceil(F.col("count") / HOT) + 1).cast("long").alias("splits"), "count"))
    total = marks.count() + (WINDOW - GRAM) * (hot.agg(F.sum("count")).first()[0] or 0)
    shards = max(1, -(-total * (WINDOW + 4) // SHARD_WORDS))
    own = marks.join(hot.select("anchor", "splits"), "anchor", "left").groupBy("doc_id", "text_hash").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("splits").isNotNull(), F.struct("anchor", "splits"))).alias("hot"))
    own = common.checkpoint(own)
    texts = common.filtered(rows, common.key_filter(own, ["doc_id", "text_hash"]), ["doc_id", "text_hash"])
    counts = hot.sparkSession.createDataFrame([], "h long, n long")
    if not hot.isEmpty():
        windows = rows.mapInArrow(_hot_windows(bit_set(hot.select(F.col("anchor").alias("h")), BITS)), "h long, text_hash long")
        seen = windows.groupBy("h").agg(F.count("*").alias("n"), F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
        counts = common.checkpoint(seen.where("low <> high").select("h", "n"))  # copies of one text do not count as several
    repeated, frequent = bit_set(counts, BITS), bit_set(counts.where(F.col("n") > HOT), BITS)
    marked = texts.join(own, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "anchors", "hot")
    cut = marked.mapInArrow(_cut(shards, repeated, frequent), "shard long, kind int, key long, doc_id long, text_hash long, data binary")
    spans = cut.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_search, "doc_id long, text_hash long, start long, end long")
    return spans, copies


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; null text has no words."""
    spans, copies = repeated_spans(docs)
    marks = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"), F.lit(False).alias("copied"))
    marks = marks.unionByName(copies.select("doc_id", "text_hash", F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(True).alias("copied")))
    marks = common.checkpoint(marks)
    key = ["doc_id", "text_hash"]
    rows = docs.select("doc_id", "text", common.unicode_hash().alias("text_hash"))
    table = common.key_filter(marks, key)
    whole = common.filtered(rows, table, key, inside=False).select("doc_id", "text", F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(False).alias("copied"))
    cut = common.filtered(rows, table, key).join(marks, key, "left").select("doc_id", "text", "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    return whole.union(cut).mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
f AS (SELECT g, min(doc_id) AS m FROM v GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN f USING (g) WHERE m < doc_id),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM u ANTI JOIN h USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
