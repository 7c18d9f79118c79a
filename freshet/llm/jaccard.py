"""N-gram Jaccard join with signature trees.

Texts become sets of word shingles; equal sets collapse to classes. A pigeonhole partition of the hash space
deals out the classes to blocks: sets that link differ in few shingles, so one of their parts must be equal. In a
block a tree is built whose nodes hold OR-combined token bitmaps and size ranges; a dual traversal prunes node
pairs whose largest possible overlap is too small. What is left at the leaves ties candidate clusters, in which a
second tree over the full sets is traversed and each remaining pair verified exactly.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64

LEVEL = 1.5
SEEDS = 12
CHUNK_DOCS = 2048
CHUNK_SHINGLES = 4_000_000
FANOUT = 8


@lru_cache(None)
def _level(i: int) -> int:
    """Smallest set size of level i."""
    return 1 if i == 0 else max(_level(i - 1) + 1, math.ceil(LEVEL**i))


@lru_cache(None)
def _parts(level: int, num: int, den: int) -> tuple[int, int]:
    """(parts, empties) of a level for a threshold num/den.

    Sets that meet in the level differ in D shingles at most, so of parts = D + 1 + empties parts at least
    empties + 1 are equal. empties is the number for which a set has the fewest keys: more parts mean more keys,
    fewer mean that more sets have too many empty parts and are dealt out again.
    """
    low = max(1, math.floor(_level(level) * num / den))
    d = 2 * (_level(level + 1) - 1) * (den - num) // (den + num)

    def keys(e: int) -> float:
        k = d + 1 + e
        p = (1 - 1 / k) ** low
        fits = 0.5 * math.erfc((k * p - e - 0.5) / math.sqrt(2 * k * p * (1 - p) + 1e-9))  # share of sets with few enough empty parts
        return k * (1 - p) / max(1e-9, fits)

    best = min(range(0, 2 * d + 2, 1 + d // 64), key=keys)
    return d + 1 + best, best


def part_keys(x: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys under which the sorted set ``x`` is looked up; sets that reach num/den share one at least, unless equal.

    Only parts that hold something are keys. If two linked sets share none, then the equal parts, more than ``empties``,
    are empty in both; such sets both deal out their shingles again by the next seed, and so on. What is left after SEEDS
    deals, next to nothing, has one key for the level.
    """
    n = len(x)
    if n == 0 or 2 * n * (den - num) // (den + num) == 0 and 2 * math.floor(n * den / num) * (den - num) // (den + num) == 0:
        return np.zeros(0, U64)
    own = 0
    while _level(own + 1) <= n:
        own += 1
    levels = [own]
    if n * den >= _level(own + 1) * num:  # it can link with a set of the next level; they meet there
        levels.append(own + 1)
    out = []
    for level in levels:
        k, e = _parts(level, num, den)
        for seed in range(SEEDS + 1):
            base = U64((level << 32) + (seed << 24))
            if seed == SEEDS:
                out.append(common.mix(np.array([base])))
                break
            y = x if seed == 0 else np.sort(common.mix(x + U64(seed)))
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(common.mix(y))))
            part = ((y >> U64(32)) * U64(k)) >> U64(32)
            cut = np.searchsorted(part, np.arange(k + 1, dtype=U64))
            held = cut[1:] > cut[:-1]
            key = common.mix((sums[cut[1:]] - sums[cut[:-1]]) + common.mix(np.arange(k, dtype=U64) + base))
            out.append(key[held])
            if k - int(held.sum()) <= e:
                break
    return np.concatenate(out)


def signature(x: np.ndarray) -> np.ndarray:
    """Token bitmap of a set, of two to four bits a token: bit (hash mod width) of each."""
    width = 1 << max(6, int(2 * len(x) - 1).bit_length()) if len(x) else 64
    out = np.zeros(width // 64, U64)
    at = x & U64(width - 1)
    np.bitwise_or.at(out, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap at a smaller width."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


class SignatureTree:
    """Levels of nodes over sets in an order that puts like sets together; leaves are single sets.

    ``bits[l]`` holds a row of OR-combined token bits for each node of level l, ``low`` and ``high`` the range of
    set sizes below it, ``spare`` the largest number of tokens of one set that share a bit with another of its own.
    """

    def __init__(self, signatures: list[np.ndarray], sizes: np.ndarray):
        words = min(map(len, signatures))
        rows = np.stack([folded(b, words) for b in signatures])
        sizes = np.asarray(sizes, np.int64)
        self.order = np.lexsort((sizes, *rows[:, :3].T))
        rows, sizes = rows[self.order], sizes[self.order]
        self.bits, self.low, self.high, self.spare = [rows], [sizes], [sizes], [sizes - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)]
        while len(self.bits[-1]) > 1:
            cut = np.arange(0, len(self.bits[-1]), FANOUT)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cut, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.spare.append(np.maximum.reduceat(self.spare[-1], cut))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether some pair of sets below nodes a and b can reach num/den, by size ranges and the overlap bound."""
        la, lb, ha, hb = self.low[level][a], self.low[level][b], self.high[level][a], self.high[level][b]
        ok = (ha * den >= lb * num) & (hb * den >= la * num)
        out = np.zeros(len(a), bool)
        at = np.flatnonzero(ok)
        for s in range(0, len(at), 4096):
            i = at[s : s + 4096]
            both = np.bitwise_count(self.bits[level][a[i]] & self.bits[level][b[i]]).sum(axis=1, dtype=np.int64)
            most = np.minimum(both + np.minimum(self.spare[level][a[i]], self.spare[level][b[i]]), np.minimum(ha[i], hb[i]))
            out[i] = most * (num + den) >= num * (la[i] + lb[i])
        return out


def reach(signatures: list[np.ndarray], sizes: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """For each set the smallest index of a set that it reaches: by verified links, or without ``sets`` by possible ones.

    Dual traversal from the root pair down. Sets already known to be connected are not compared again, which
    keeps a large group of near copies near linear; any two sets left unconnected have been ruled out by a bound
    or compared exactly.
    """
    n = len(signatures)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def verify(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a == b:
            return
        if sets is not None:
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if den * both < num * (len(x) + len(y) - both):
                return
        root[max(a, b)] = min(a, b)

    tree = SignatureTree(signatures, sizes)
    order = tree.order.tolist()
    next_to = np.arange(n - 1)
    for k in next_to[tree.possible(0, next_to, next_to + 1, num, den)].tolist():
        verify(order[k], order[k + 1])
    stack = [(len(tree.bits) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            keep = tree.possible(0, a, b, num, den) & (a != b)
            for i, j in zip(a[keep].tolist(), b[keep].tolist()):
                verify(order[i], order[j])
            continue
        keep = (a == b) | tree.possible(level, a, b, num, den)
        a, b = a[keep], b[keep]
        below = len(tree.bits[level - 1])
        comp = np.array([find(i) for i in order])
        cuts = np.arange(0, n, FANOUT ** (level - 1))
        lo, hi = np.minimum.reduceat(comp, cuts), np.maximum.reduceat(comp, cuts)
        for s in range(0, len(a), 2048):
            p, q = a[s : s + 2048], b[s : s + 2048]
            i = (p[:, None, None] * FANOUT + np.arange(FANOUT)[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
            j = (q[:, None, None] * FANOUT + np.zeros((1, FANOUT, 1), np.int64) + np.arange(FANOUT)[None, None, :]).ravel()
            ok = (i < below) & (j < below) & (i <= j)
            i, j = i[ok], j[ok]
            same = (lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j])
            stack.append((level - 1, i[~same], j[~same]))
    return np.array([find(i) for i in range(n)])


def links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    return reach([signature(x) for x in sets], np.array([len(x) for x in sets]), num, den, sets)


def _digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two hashes that together stand for the set, and its bitmap."""

    def run(batches):
        for b in batches:
            n, h1, h2, bits = [], [], [], []
            for _, _, data, offsets in common.text_blocks(b):
                for x in common.shingle_sets(data, offsets, words):
                    n.append(len(x))
                    h1.append(int(np.sum(common.mix(x ^ U64(0x5851F42D4C957F2D)), dtype=U64).astype(np.int64)))
                    h2.append(int(np.sum(common.mix(x + U64(0x14057B7EF767814F)), dtype=U64).astype(np.int64)))
                    bits.append(signature(x).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in (n, h1, h2)), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bits binary")


def _keys(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            for i, _, data, offsets in common.text_blocks(b):
                keys = [part_keys(x, num, den) for x in common.shingle_sets(data, offsets, words)]
                if any(map(len, keys)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids[i : i + len(keys)], [len(k) for k in keys]))], names=["key", "doc_id"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "key long, doc_id long")


SHORT = 64


def _runs(batches):
    """From rows sorted by (key, doc_id): (block, doc_id) of every key that several documents share.

    A short run is named by its members, so the many keys that one group of documents shares make one block; a
    longer run is named by its key and streamed. Repeats are left out within a task as far as a bounded set goes.
    """
    last, held, long = None, [], False
    seen: set[int] = set()

    def close():
        if not long and len(held) > 1:
            h = np.array(held, np.int64).view(U64)
            name = int(common.grams(common.mix(h), len(h))[0].astype(np.int64))
            if name not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(name)
                return [name] * len(held), held
        return [], []

    for b in batches:
        key, doc = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(key):
            continue
        again = np.concatenate(([key[0] == last], key[1:] == key[:-1])) if last is not None else np.concatenate(([False], key[1:] == key[:-1]))
        starts = np.flatnonzero(~again)
        blocks, docs = [], []
        first = int(starts[0]) if len(starts) else len(key)
        pieces = [(0, first)] if first else []
        ends = np.append(starts[1:], len(key)) if len(starts) else starts
        wide = ends - starts > 1
        if len(wide):
            wide[-1] = True
        pieces += [(int(x), int(y)) for x, y in zip(starts[wide], ends[wide])]
        for x, y in pieces:
            if x >= first:
                for o, v in zip((blocks, docs), close()):
                    o += v
                held, long = [], False
            some = doc[x:y].tolist()
            if held and some[0] == held[-1]:
                some = some[1:]
            held = held + some
            if long or len(held) > SHORT:
                blocks += [int(key[x])] * (len(held) if not long else len(some))
                docs += held if not long else some
                held, long = held[-1:], True
        last = key[-1]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(docs, pa.int64())], names=["block", "node"])
    blocks, docs = close()
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(docs, pa.int64())], names=["block", "node"])


def _placed(members: DataFrame, group: str) -> DataFrame:
    """members(group, node, size) of groups of two or more, with the chunk c of m that a hash deals each to."""
    heavy = members.groupBy(group).agg(F.count("*").alias("k"), F.sum("size").alias("w"))
    return members.join(heavy.where("k > 1").select(group, _chunks("k", "w").alias("m")), group).withColumn("c", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))


def _chunks(k: str, w: str):
    return F.greatest(F.ceil(F.col(k) / CHUNK_DOCS), F.ceil(F.col(w) / CHUNK_SHINGLES)).cast("int")


def _first_tasks(placed: DataFrame, group: str) -> DataFrame:
    """(group, ca, cb, node): each chunk together with the group's chunk 0, so the tasks' rows are twice the group's."""
    lead = placed.where("m > 1 and c = 0").select(group, F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("cb"), "node")
    every = lead.union(placed.where("m = 1 or c > 0").select(group, F.col("c").alias("cb"), "node"))
    return every.select(group, F.lit(0).alias("ca"), "cb", "node")


def _rest_tasks(placed: DataFrame, linked: DataFrame, group: str) -> DataFrame:
    """The same for what the first tasks leave open in groups of several chunks: the members outside the group's largest
    component, in chunks of their own, against every chunk. In a large group of near copies those are few."""
    hot = placed.where("m > 1").join(linked.toDF("node", "found"), "node", "left").select(group, "node", "size", "c", "m", F.coalesce("found", "node").alias("own"))
    top = hot.groupBy(group, "own").count().groupBy(group).agg(F.max_by("own", F.struct("count", -F.col("own"))).alias("top"))
    rest = hot.join(top, group).where("own <> top")
    n = rest.groupBy(group).agg(F.count("*").alias("k"), F.sum("size").alias("w")).select(group, _chunks("k", "w").alias("r"))
    left = rest.join(n, group).select(group, F.pmod(F.xxhash64("node"), F.col("r")).cast("int").alias("ca"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("cb"), "node")
    right = hot.join(n, group).select(group, F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("ca"), F.col("c").alias("cb"), "node")
    return left.union(right).distinct()


def _components(members: DataFrame, group: str, work) -> DataFrame:
    """(node, component) by the links that ``work`` finds in tasks(group, ca, cb, node), each a part of one group.

    Two members of a group either meet in a task or are in one component already, so no pair is lost and a large group is
    not taken in all pairs of its chunks.
    """
    placed = _placed(members, group)
    linked = common.connected_components(work(_first_tasks(placed, group)))
    if placed.where("m > 1").isEmpty():
        return linked
    linked = common.checkpoint(linked)
    more = work(_rest_tasks(placed, linked, group))
    return common.connected_components(more.union(linked.select("node", "component")))


def _edges(ids: list, root: np.ndarray) -> pa.RecordBatch:
    pairs = [(ids[i], ids[r]) for i, r in enumerate(root.tolist()) if i != r]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.int64()), pa.array([d for _, d in pairs], pa.int64())], names=["src", "dst"])


def _bitmap_join(num: int, den: int):
    """Possible links in each block, from rows (block, ca, cb, node, size, bits) sorted by block."""

    def run(batches):
        group, ids, sizes, bits = None, [], [], []
        for b in batches:
            for block, ca, cb, node, size, raw in zip(*(c.to_pylist() for c in b.columns)):
                if (block, ca, cb) != group:
                    if len(ids) > 1:
                        yield _edges(ids, reach(bits, np.array(sizes), num, den))
                    group, ids, sizes, bits = (block, ca, cb), [], [], []
                ids.append(node)
                sizes.append(size)
                bits.append(np.frombuffer(raw, U64))
        if len(ids) > 1:
            yield _edges(ids, reach(bits, np.array(sizes), num, den))

    return run


def _tree_join(words: int, num: int, den: int):
    def run(batches):
        group, ids, sets = None, [], []

        def close():
            if len(sets) < 2:
                return
            yield _edges(ids, links(sets, num, den))

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3))))
            nodes = b.column(3).to_pylist()
            for i, _, data, offsets in common.text_blocks(b):
                for k, x in enumerate(common.shingle_sets(data, offsets, words), i):
                    if keys[k] != group:
                        yield from close()
                        group, ids, sets = keys[k], [], []
                    if len(x):
                        ids.append(nodes[k])
                        sets.append(x)
        yield from close()

    return run


def similar_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents linked at Jaccard similarity num/den or more.

    Words are split at ASCII white space and A-Z lower-cased; a text shorter than ``words`` is one shingle.
    Without words n_shingles is 0 and the component the document itself. Rows that share an id are one node, which has the
    links of all its texts; a null id has no component. Equal sets are linked at once and count as one set from there on.
    Blocks and candidate clusters beyond ``CHUNK_DOCS`` sets or ``CHUNK_SHINGLES`` shingles are split into chunks (see
    _components), so no group has to fit in a task and no link is lost.
    """
    repeated = common.checkpoint(_repeated(docs))
    if repeated.isEmpty():
        return _groups(docs, words, num, den)
    single, again = _numbered(docs.select("doc_id", "text"), repeated)
    again = again.select(F.col("node").alias("doc_id"), "row.text", F.col("row.doc_id").alias("id"))
    found = _groups(single.union(again.drop("id")), words, num, den).join(again.select("doc_id", "id"), "doc_id", "left").withColumn("id", F.coalesce("id", "doc_id"))
    found = common.checkpoint(found.select("id", "n_shingles", F.col("component_id").alias("group")))
    held = found.where("id is not null")
    ties = held.join(held.groupBy("group").agg(F.min("id").alias("dst")), "group").select(F.col("id").alias("src"), "dst").distinct()
    joined = common.connected_components(ties).withColumnRenamed("node", "id")
    return found.join(joined, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _repeated(docs: DataFrame) -> DataFrame:
    """The ids, nulls apart, that several rows have."""
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")


def _numbered(docs: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id does not repeat, and (row, node) for the others: each as a struct with a number beyond all ids."""
    single = common.anti_join(docs, repeated, ["doc_id"])
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    start = high + 1 if high < 1 << 62 else low - (1 << 61)
    held = docs.select(F.struct("*").alias("row")).join(repeated, F.col("row.doc_id") == F.col("doc_id"), "left_semi")
    return single, common.checkpoint(held.select("row", (F.lit(start) + F.monotonically_increasing_id()).alias("node")))


def _groups(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """similar_groups for ids that do not repeat, nulls apart."""
    if 4 * num < 3 * den:
        raise ValueError("the level scheme holds for thresholds of 0.75 or more")
    own = common.checkpoint(_digests(docs, words))
    classes = own.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "bits")).alias("r"))
    classes = classes.select("h1", "h2", "n_shingles", F.col("r.doc_id").alias("rep"), F.col("r.bits").alias("bits"))
    classes = common.checkpoint(classes)
    reps = classes.select(F.col("rep").alias("node"), F.struct(F.col("n_shingles").alias("size"), "bits").alias("s"))
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # keys for one document of each class; only rows that may be copies are shuffled to leave them out
    copies = own.where("n_shingles > 0 and doc_id is not null").select("doc_id", "h1", "h2", "n_shingles").join(classes.drop("bits"), ["h1", "h2", "n_shingles"]).where("doc_id <> rep").select("doc_id")
    firsts = common.anti_join(docs.select("doc_id", "text"), copies, ["doc_id"])
    runs = _keys(firsts, words, num, den).repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(_runs, "block long, node long").distinct()
    members = common.checkpoint(runs.join(reps.select("node", "s.size"), "node"))
    dealt = lambda rows, group: rows.repartition(n, group, "ca", "cb").sortWithinPartitions(group, "ca", "cb", "node")

    def possible(tasks: DataFrame) -> DataFrame:
        rows = tasks.join(reps.select("node", "s.size", "s.bits"), "node").select("block", "ca", "cb", "node", "size", "bits")
        return dealt(rows, "block").mapInArrow(_bitmap_join(num, den), "src long, dst long")

    nodes = _components(members, "block", possible).join(reps.select("node", "s.size"), "node")
    nodes = common.checkpoint(nodes)
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    texts = common.filtered(texts, common.key_filter(nodes, ["node"]), ["node"])

    def verified(tasks: DataFrame) -> DataFrame:
        rows = tasks.join(texts, "node").select("component", "ca", "cb", "node", "text")
        return dealt(rows, "component").mapInArrow(_tree_join(words, num, den), "src long, dst long")

    joined = _components(nodes.select("component", "node", "size"), "component", verified).withColumnRenamed("node", "rep")
    labels = classes.join(joined, "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = own.where("doc_id is not null").drop("bits").join(labels, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.union(own.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(common.documents(spark, sf_dir), words=4, num=85, den=100)


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of docs, all their columns: of each group of near duplicates one row stays, that of smallest doc_id.

    Rows are judged one by one by their own text, whatever others have the same id: rows whose id repeats count as later than
    all others, in no order of their own, so each group keeps exactly one row and none is lost. Of equal rows one stays.
    Rows without words stay, and so do rows with a null id.
    """
    repeated = common.checkpoint(_repeated(docs))
    if repeated.isEmpty():
        groups = _groups(docs, words, num, den)
        return common.anti_join(docs, groups.where("component_id <> doc_id").select("doc_id"), ["doc_id"])
    single, again = _numbered(docs, repeated)
    every = single.select("doc_id", "text").union(again.select(F.col("node").alias("doc_id"), "row.text"))
    gone = common.checkpoint(_groups(every, words, num, den).where("component_id <> doc_id").select("doc_id"))
    return common.anti_join(single, gone, ["doc_id"]).unionByName(common.anti_join(again, gone, ["node"]).select("row.*"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r AS (SELECT DISTINCT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) c ON c.node = d.doc_id"""
