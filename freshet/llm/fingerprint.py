"""Document fingerprints: a quartile bucket digest of hashed byte triplets, with a bounded difference score.

Every place of a text's bytes gives three triplets out of a window of four bytes, each hashed to one of 128 buckets. A bucket's
code says in which quartile of all counts its own count lies (0 to 3). The digest is the length (eight steps to a
doubling), two ratios of the quartiles and the codes, all in hexadecimal digits.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 128
# Fixed values of the digest: places in the window and multipliers of each triplet, bits below a bucket's number.
TRIPLETS = [((0, 1, 2), (2654435761, 2246822519, 3266489917)), ((0, 1, 3), (668265263, 374761393, 2654435769)), ((0, 2, 3), (2135587861, 2654289839, 1640531527))]
SHIFT = 25
PIECE = 1 << 18
UNLIKE = 256


def bucket_counts(data: np.ndarray) -> np.ndarray:
    """Triplets of each bucket in a text's bytes; a text of fewer than three bytes has none."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), PIECE):
        x = data[at : at + PIECE + 3].astype(np.uint32)
        for places, factors in TRIPLETS:
            m = min(len(x) - max(places), PIECE)
            if m > 0:
                a, b, c = (x[p : p + m] * np.uint32(f) for p, f in zip(places, factors))
                counts += np.bincount((a + b + c) >> np.uint32(SHIFT), minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Eight steps to a doubling; 0 for no bytes. Codes end at 255, beyond any text."""
    if not n:
        return 0
    e = n.bit_length() - 1
    return min(255, 8 * e + (n * 8 >> e) - 7)


class Digest:
    """Length code, ratios of the first and second quartile to the third (0 to 15), and the buckets' codes."""

    def __init__(self, data: np.ndarray):
        counts = bucket_counts(data)
        q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
        self.length, self.ratios = length_code(len(data)), (15 * q1 // max(q3, 1), 15 * q2 // max(q3, 1))
        self.codes = ((counts > q1).astype(np.int8) + (counts > q2) + (counts > q3)).astype(np.int8)

    def text(self) -> str:
        return f"{self.length:02x}{self.ratios[0]:x}{self.ratios[1]:x}" + np.packbits((self.codes.reshape(-1, 2)[:, :, None] >> np.array([1, 0]) & 1).astype(bool)).tobytes().hex()

    def difference(self, other: Digest) -> int:
        """0 for equal digests. A code two apart counts twice, three apart six times; a doubling of the length counts 8."""
        gap = np.abs(self.codes - other.codes)
        return int(gap.sum()) + 3 * int((gap == 3).sum()) + abs(self.length - other.length) + sum(abs(a - b) for a, b in zip(self.ratios, other.ratios))

    def likeness(self, other: Digest) -> float:
        """1 for equal digests, 0 from a difference of UNLIKE on."""
        return 1 - min(self.difference(other), UNLIKE) / UNLIKE


def prefix_bytes(data: np.ndarray, chars: int) -> int:
    """Bytes of the first ``chars`` code points, all if there are fewer."""
    at, left = 0, chars
    while at < len(data):
        starts = np.flatnonzero((data[at : at + PIECE] & 0xC0) != 0x80)
        if len(starts) > left:
            return at + int(starts[left])
        left -= len(starts)
        at += PIECE
    return len(data)


def code_points(data: np.ndarray) -> int:
    return sum(int(np.count_nonzero((data[at : at + PIECE] & 0xC0) != 0x80)) for at in range(0, len(data), PIECE))


def with_successors(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, ahead, doc_id, h, text): each document in its part of the order (doc_id, hash of the text), and with
    ahead = 1 the first one of the next part, so that every document meets its successor. The first follows the last.

    Only the first (doc_id, hash) of each part, ``parts`` of them at most, comes to the driver.
    """
    keyed = docs.select("doc_id", common.unicode_hash().alias("h"), "text")
    firsts = keyed.select("doc_id", "h").repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.asc("h")).groupBy(F.spark_partition_id().alias("p")).agg(F.min_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("k"))
    order = lambda doc, h: (doc is not None, doc or 0, h)
    bounds = sorted(order(r.k.doc_id, r.k.h) for r in firsts.collect())
    n = len(bounds)

    def placed(batches):
        for b in batches:
            keys = [order(d, h) for d, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            part = [max(0, bisect.bisect_right(bounds, k) - 1) for k in keys]
            twice = [k for k, (p, key) in enumerate(zip(part, keys)) if key == bounds[p]]
            rows = np.concatenate((np.arange(len(keys)), np.array(twice, np.int64))).astype(np.int64)
            to = part + [(part[k] - 1) % n for k in twice]
            ahead = [0] * len(keys) + [1] * len(twice)
            out = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(ahead, pa.int32()), *out.columns], names=["part", "ahead", "doc_id", "h", "text"])

    rows = keyed.mapInArrow(placed, "part int, ahead int, doc_id long, h long, text string")
    return rows.repartitionById(max(n, 1), "part").sortWithinPartitions("part", "ahead", F.asc_nulls_first("doc_id"), "h")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): its digest, that of its edited text, and the likeness to that and to the
    next document's.

    The edited text is the first half of the code points (the larger one) and as many of the next document's first ones
    as are missing, or all it has. Documents follow each other by doc_id, a null id first, rows of one id by the hash of
    their text; the last is followed by the first, a lone document by itself. A null text is empty; an empty text has the
    digest of no triplets. Equal texts have equal digests. Rows equal in id and text meet in one task; a task holds two
    texts and one Arrow batch, whatever their number.
    """
    spark = docs.sparkSession
    rows = with_successors(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        part, held = None, None

        def row(own, nxt):
            doc, data, digest = own
            n = code_points(data)
            half = n // 2
            edited = np.concatenate((data[: prefix_bytes(data, n - half)], nxt[1][: prefix_bytes(nxt[1], half)]))
            changed = Digest(edited)
            return doc, n, hashlib.sha256(edited).hexdigest(), digest.text(), changed.text(), digest.likeness(changed), digest.likeness(nxt[2])

        for b in batches:
            out, ids = [], b.column(2).to_pylist()
            parts, ahead = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, data, offsets in common.text_blocks(b):
                for k in range(i, j):
                    text = data[offsets[k - i] : offsets[k - i + 1]]
                    own = (ids[k], text, Digest(text))
                    if held is not None and part == parts[k]:
                        out.append(row(held, own))
                    part, held = parts[k], None if ahead[k] else own
            if held is not None:
                held = (held[0], held[1].copy(), held[2])
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.documents(spark, sf_dir))


_HASHES = ", ".join("((" + " + ".join(f"b{p} * {f}" for p, f in zip(places, factors)) + f") % 4294967296) // {1 << SHIFT}" for places, factors in TRIPLETS)
ORACLE = f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER w, CASE WHEN lead(doc_id) OVER w IS NULL THEN first_value(text) OVER w END, '') AS nxt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT doc_id, next_id, text, length(text) AS n, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) AS edited FROM o),
v AS (SELECT doc_id, 0 AS e, text AS t FROM x UNION ALL SELECT doc_id, 1, edited FROM x),
h AS (SELECT doc_id, e, hex(encode(t)) AS h FROM v),
y AS (SELECT doc_id, e, len(h) // 2 AS m, regexp_extract_all(h, '..') AS b FROM h),
i AS (SELECT doc_id, e, i, CAST((strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1 AS BIGINT) AS b0 FROM (SELECT doc_id, e, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM y)),
j AS (SELECT doc_id, e, b0, lead(b0, 1) OVER w AS b1, lead(b0, 2) OVER w AS b2, lead(b0, 3) OVER w AS b3 FROM i WINDOW w AS (PARTITION BY doc_id, e ORDER BY i)),
g AS (SELECT doc_id, e, unnest(list_filter([{_HASHES}], lambda z: z IS NOT NULL)) AS k FROM j),
c AS (SELECT doc_id, e, k, count(*) AS n FROM g GROUP BY ALL),
a AS (SELECT y.doc_id, y.e, any_value(y.m) AS m, list(coalesce(c.n, 0) ORDER BY z.k) AS n FROM y CROSS JOIN (SELECT unnest(range({BUCKETS})) AS k) z LEFT JOIN c ON c.doc_id = y.doc_id AND c.e = y.e AND c.k = z.k GROUP BY y.doc_id, y.e),
q AS (SELECT *, list_sort(n)[{BUCKETS // 4}] AS q1, list_sort(n)[{BUCKETS // 2}] AS q2, list_sort(n)[{3 * BUCKETS // 4}] AS q3 FROM a),
s AS (SELECT doc_id, e, list_transform(n, lambda z: (z > q1)::INT + (z > q2)::INT + (z > q3)::INT) AS code, 15 * q1 // greatest(q3, 1) AS r1, 15 * q2 // greatest(q3, 1) AS r2,
  CASE WHEN m = 0 THEN 0 ELSE least(255, 8 * (len(bin(m)) - 1) + (m * 8 >> (len(bin(m)) - 1)::INT) - 7) END AS l FROM q),
f AS (SELECT *, printf('%02x', l) || printf('%x', r1) || printf('%x', r2) || array_to_string(list_transform(range({BUCKETS // 2}), lambda i: printf('%x', code[2 * i + 1] * 4 + code[2 * i + 2])), '') AS fp FROM s),
p AS (SELECT x.doc_id, x.n, x.edited, own.fp AS fp, ed.fp AS efp, [{{'l': own.l, 'r1': own.r1, 'r2': own.r2, 'c': own.code}}, {{'l': ed.l, 'r1': ed.r1, 'r2': ed.r2, 'c': ed.code}}, {{'l': nx.l, 'r1': nx.r1, 'r2': nx.r2, 'c': nx.code}}] AS t
  FROM x JOIN f own ON own.doc_id = x.doc_id AND own.e = 0 JOIN f ed ON ed.doc_id = x.doc_id AND ed.e = 1 JOIN f nx ON nx.doc_id = x.next_id AND nx.e = 0),
u AS (SELECT *, list_transform([2, 3], lambda j: 1 - least({UNLIKE}, abs(t[1].l - t[j].l) + abs(t[1].r1 - t[j].r1) + abs(t[1].r2 - t[j].r2) + list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: [0, 1, 2, 6][1 + abs(t[1].c[i] - t[j].c[i])]))) / {UNLIKE}) AS near FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint, CAST(near[1] AS DOUBLE) AS near_edited, CAST(near[2] AS DOUBLE) AS near_next FROM u"""
