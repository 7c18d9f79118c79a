"""Geometry blobs (SpatiaLite, GeoPackage, plain and extended well-known binary) to vertices with parts and rings."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codes of the geometry kinds, marks of a SpatiaLite blob and its parts, and of the extra dimensions.
POINT, LINE, POLYGON, COLLECTIONS = 1, 2, 3, (4, 5, 6, 7)
SPATIALITE_START, SPATIALITE_AFTER_BOX, SPATIALITE_PART, SPATIALITE_END = 0x00, 0x7C, 0x69, 0xFE
EXTENDED_Z, EXTENDED_M, EXTENDED_SRID = 0x80000000, 0x40000000, 0x20000000
ENVELOPE_BYTES = (0, 32, 48, 48, 64)


class _Blob:
    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def number(self, kind: str):
        value = struct.unpack_from(self.order + kind, self.data, self.at)[0]
        self.at += struct.calcsize(kind)
        return value

    def points(self, n: int, width: int) -> np.ndarray:
        if n < 0 or self.at + 8 * n * width > len(self.data):
            raise ValueError("the blob ends inside a ring")
        out = np.frombuffer(self.data, f"{self.order}f8", n * width, self.at).reshape(n, width)[:, :2]
        self.at += 8 * n * width
        return out


def _kind(code: int) -> tuple[int, int]:
    """Kind and numbers in a point, of a plain or extended code."""
    extra = bool(code & EXTENDED_Z) + bool(code & EXTENDED_M)
    code &= 0x0FFFFFFF
    extra += (0, 1, 1, 2)[code // 1000] if code < 4000 else 99
    if extra > 2 or not POINT <= code % 1000 <= 7:
        raise ValueError(f"geometry kind {code} is not read")
    return code % 1000, 2 + extra


def _geometry(b: _Blob, kind: int, width: int, inner) -> list[list[np.ndarray]]:
    """Parts of rings; ``inner`` reads the head of a part of a collection."""
    if kind == POINT:
        return [[b.points(1, width)]]
    if kind == LINE:
        return [[b.points(b.number("I"), width)]]
    if kind == POLYGON:
        return [[b.points(b.number("I"), width) for _ in range(b.number("I"))]]
    out = []
    for _ in range(b.number("I")):
        out += _geometry(b, *inner(b), inner)
    return out


def _wkb_head(b: _Blob) -> tuple[int, int]:
    b.order = "<" if b.data[b.at] else ">"
    b.at += 1
    code = b.number("I")
    if code & EXTENDED_SRID:
        b.number("I")
    return _kind(code & ~EXTENDED_SRID)


def _spatialite_part(b: _Blob) -> tuple[int, int]:
    if b.data[b.at] != SPATIALITE_PART:
        raise ValueError("a part of the collection has no mark")
    b.at += 1
    return _kind(b.number("I"))


def parts(data: bytes) -> list[list[np.ndarray]]:
    """Parts, each a list of rings or lines, each an array of (x, y); an empty geometry has none. Damaged or compressed
    blobs raise ValueError."""
    b = _Blob(data)
    try:
        if len(data) > 43 and data[0] == SPATIALITE_START and data[38] == SPATIALITE_AFTER_BOX and data[-1] == SPATIALITE_END:
            b.order, b.at = "<" if data[1] else ">", 39
            found = _geometry(b, *_kind(b.number("I")), _spatialite_part)
        else:
            if data[:2] == b"GP":
                b.at = 8 + ENVELOPE_BYTES[data[3] >> 1 & 7]
            found = _geometry(b, *_wkb_head(b), _wkb_head)
    except (struct.error, IndexError) as e:
        raise ValueError("the blob is not whole") from e
    return [[r for r in rings if len(r) and not np.isnan(r).all()] for rings in found]


SCHEMA = "id long, part int, ring int, ord int, x double, y double, problem string"
ROWS = 1 << 16


def vertices(df: DataFrame, column: str, id: str = "id") -> DataFrame:
    """(id, part, ring, ord, x, y, problem) of the geometries in a binary column.

    Ring 0 of a polygon's part is its outline; a line or point is ring 0 of its part. A blob that cannot be read gives one row with
    the problem and no coordinates; null and empty geometries give none. A large geometry leaves in several batches.
    """

    def batch(rows: list) -> pa.RecordBatch:
        ids, part, ring, place, xy = zip(*rows)
        n = [len(v) for v in xy]
        at = [np.repeat(np.array(v, k), n) for v, k in ((part, np.int32), (ring, np.int32))]
        order = np.concatenate([np.arange(p, p + k, dtype=np.int32) for p, k in zip(place, n)])
        flat = np.concatenate(xy)
        owner = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
        columns = [owner, *map(pa.array, at), pa.array(order), pa.array(np.ascontiguousarray(flat[:, 0], np.float64)), pa.array(np.ascontiguousarray(flat[:, 1], np.float64)), pa.nulls(len(flat), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches):
        for b in batches:
            rows, held, bad = [], 0, []
            for i, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if blob is None:
                    continue
                try:
                    found = parts(blob)
                except ValueError as e:
                    bad.append((i, str(e)))
                    continue
                for p, rings in enumerate(found):
                    for r, ring in enumerate(rings):
                        for at in range(0, len(ring), ROWS):
                            rows.append((i, p, r, at, ring[at : at + ROWS]))
                            held += len(rows[-1][4])
                            if held >= ROWS:
                                yield batch(rows)
                                rows, held = [], 0
            if rows:
                yield batch(rows)
            if bad:
                ids, said = zip(*bad)
                none = [pa.nulls(len(bad), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *none, pa.array(said, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return df.select(F.col(id).cast("long").alias("id"), F.col(column).alias("blob")).mapInArrow(run, SCHEMA)
