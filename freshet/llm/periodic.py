"""Periodic run detection by heavy/light lag counting.

A run of period q and length max(6, 4q) or more has at least ``need(q)`` places whose word is repeated q words later. The
matches of every lag are counted exactly: words that are frequent in a text by FFT autocorrelation, the others by the
differences of their pairs of places. Only lags with enough matches are scanned for islands of matches, and matches
that a run of a shorter period explains are taken off its multiples first.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .common import U64

EXPONENT, SHORTEST = 4, 6
PAIRS = 1 << 21


def need(q):
    """Matches in a row at lag q that make the shortest run of period q."""
    return np.maximum(SHORTEST, EXPONENT * q) - q


def _heavy_from(n: int) -> int:
    """Occurrences in a text of n words from which a transform costs less than the pairs."""
    return max(16, int(np.sqrt(1.2 * n * np.log2(n + 2))))


def lag_counts(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact matches of each lag 1..n//4 of several texts, text d at base[d] + lag; words of text d at first[d]:first[d+1]."""
    n = np.diff(first)
    limit = n // EXPONENT
    base = np.concatenate(([0], np.cumsum(limit + 1)))
    counts = np.zeros(base[-1], np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    key = common.mix(words + common.mix(doc.astype(U64)))
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))) if len(k) else np.zeros(0, np.int64)
    size = np.diff(start, append=len(k))
    heavy = size >= np.array([_heavy_from(int(x)) for x in n])[d[start]] if len(k) else np.zeros(0, bool)
    ends = np.repeat(start + size, size)
    left = np.flatnonzero(np.repeat(~heavy & (size > 1), size))
    held, total, step = [], 0, 1
    while len(left):
        left = left[left + step < ends[left]]
        lag = order[left + step] - order[left]
        near = lag <= limit[d[left]]
        left = left[near]
        held.append(base[d[left]] + lag[near])
        total += len(left)
        step += 1
        if total > PAIRS or not len(left):
            at, c = np.unique(np.concatenate(held), return_counts=True)
            counts[at] += c
            held, total = [], 0
    for text in np.unique(d[start[heavy]]).tolist():
        a, b = int(first[text]), int(first[text + 1])
        width = 1 << int(b - a + limit[text]).bit_length()
        power = np.zeros(width // 2 + 1)
        for g in np.flatnonzero(heavy & (d[start] == text)).tolist():
            places = np.zeros(width)
            places[order[start[g] : start[g] + size[g]] - a] = 1
            power += np.abs(np.fft.rfft(places)) ** 2
        counts[base[text] : base[text + 1]] += np.rint(np.fft.irfft(power, width)[: limit[text] + 1]).astype(np.int64)
    counts[base[:-1]] = 0
    return counts, base


def _reach(w: np.ndarray, i: int, q: int, step: int) -> int:
    """How many places from i on (step 1) or before i (step -1) match the word q later, without a gap."""
    got, width = 0, 64
    while True:
        if step > 0:
            a, b = w[i + got : min(i + got + width, len(w) - q)], w[i + got + q : i + got + q + width]
        else:
            lo = max(0, i - got - width)
            a, b = w[lo : i - got][::-1], w[lo + q : i - got + q][::-1]
        bad = np.flatnonzero(a != b)
        if len(bad):
            return got + int(bad[0])
        got += len(a)
        if len(a) < width:
            return got
        width *= 2


def islands(w: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(start, length) of all maximal stretches of period q with length max(6, 4q) or more.

    So many matches in a row contain a multiple of ``need(q)``, and lie half on one side of it: only such places are tried.
    """
    s, m = int(need(q)), len(w) - q
    i = np.arange(0, m, s)
    i = i[w[i] == w[i + q]]
    ahead, behind = np.ones(len(i), bool), np.ones(len(i), bool)
    for t in range(1, min((s - 1) // 2, 8) + 1):
        x, y = np.minimum(i + t, m - 1), np.maximum(i - t, 0)
        ahead &= (i + t < m) & (w[x] == w[x + q])
        behind &= (i - t >= 0) & (w[y] == w[y + q])
    out, done = [], -1
    for p in i[ahead | behind].tolist():
        if p > done:
            right = _reach(w, p, q, 1)
            left = _reach(w, p, q, -1)
            done = p + right
            if left + right >= s:
                out.append((p - left, left + right + q))
    return out


def runs_of(w: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period, from the text's words and its matches of each lag.

    Lags come in ascending order. A run of period d has length - q matches at each multiple q of d; no match of another run
    of smallest period q is among them, since two runs overlap in fewer than q words. So they are taken off, and a text
    that repeats one word is not scanned at every lag. A stretch found before has a shorter period.
    """
    counts = counts.copy()
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(counts >= need(np.arange(len(counts)))).tolist():
        if counts[q] < need(q):
            continue
        for at, length in islands(w, q):
            if (at, length) not in found:
                found[at, length] = q
                times = np.arange(2 * q, min(length, len(counts)), q)
                counts[times] -= length - times
    return sorted((a, n, q) for (a, n), q in found.items())


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray):
    """The bytes of words ``at`` joined by one space, in pieces of 65,536 words."""
    for k in range(0, len(at), 1 << 16):
        i = at[k : k + (1 << 16)]
        size = e[i] - s[i] + 1
        stop = np.cumsum(size)
        out = data[np.minimum(np.repeat(s[i] - stop + size, size) + np.arange(stop[-1]), len(data) - 1)]
        out[stop - 1] = 32
        yield (out if k + len(i) < len(at) else out[:-1]).tobytes()


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def tiled(doc_id: int | None, n: int) -> np.ndarray:
    """Numbers of the original words in a text of n words: one document in ten repeats a stretch of itself to its end."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def periodic_runs(docs: DataFrame, tile: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): its runs, the strongest one, and a digest of the text without repeats.

    A run is a stretch of words of smallest period q, at least max(6, 4q) long, that no neighbouring word extends. The
    strongest has the greatest length/period, then the smallest start and period; a text without runs (null, empty, short
    ones too) has n_runs 0 and nulls. A word after the first q words of a run that holds it is dropped from the collapsed
    text. Repeated rows each give a row; a null id stays null. With ``tile`` a document in ten, by crc32 of its id, is
    first made periodic (null ids are left as they are). Words are told apart by 64-bit hashes. Each text is worked on
    alone, in memory that is linear in its length; nothing is shuffled.
    """

    def run(batches):
        for b in batches:
            rows = []
            for i, j, data, offsets in common.text_blocks(b):
                h, s, e, first = common.hash_words(data, offsets)
                ids = b.column(0)[i:j].to_pylist()
                at = np.concatenate([tiled(d if tile else None, int(x)) + int(f) for d, x, f in zip(ids, np.diff(first), first)])
                w = h[at] if len(at) else h
                counts, base = lag_counts(w, first)
                lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
                some = np.add.reduceat(counts >= need(lag), base[:-1]) if len(counts) else np.zeros(len(ids))
                for k, d in enumerate(ids):
                    x, y = int(first[k]), int(first[k + 1])
                    runs = runs_of(w[x:y], counts[base[k] : base[k + 1]]) if some[k] else []
                    keep = np.ones(y - x, bool)
                    for start, length, q in runs:
                        keep[start + q : start + length] = False
                    left = hashlib.sha256()
                    for piece in _joined(data, s, e, at[x:y][keep]):
                        left.update(piece)
                    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
                    listed = hashlib.sha256("".join(f"{p},{n},{q}\n" for p, n, q in runs).encode()).hexdigest()
                    rows.append((d, len(runs), *top, 1000 * top[1] // top[2] if runs else None, listed, left.hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.string()) for k, c in enumerate(columns)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(common.documents(spark, sf_dir), tile=True)


ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: xor(c // 256, t[1 + xor(c, x) % 256])), 4294967295) AS h FROM documents, tab),
e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tile, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN tile THEN g % n ELSE n END AS a FROM e),
z AS (SELECT doc_id, n, i, w[1 + CASE WHEN tile AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS x FROM (SELECT *, unnest(range(n)) AS i FROM f)),
p AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM z u JOIN z v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i AND v.i - u.i <= u.n // 4),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := period) ORDER BY length / period DESC, start, period) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT DISTINCT z.doc_id, z.i, z.x FROM z ANTI JOIN r ON r.doc_id = z.doc_id AND z.i >= r.start + r.period AND z.i < r.start + r.length) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
  CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""
