"""Geometry blobs and GeoJSON to vertices, written here by hand and read back."""

import json
import sqlite3
import struct

import pytest

from freshet.operators import geometry, overlay
from freshet.sources import documents, tables, wkb

FRAME = [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]], [[(10, 0), (12, 0), (12, 1), (10, 0)]]]


def plain(kind, parts, order="<", dims=2, srid=None, extended=False):
    """WKB of a point, line, polygon or a collection of them."""

    def points(ring):
        return b"".join(struct.pack(order + "d" * dims, *p, *[9.0] * (dims - 2)) for p in ring)

    def code(k, top):
        extra = {2: 0, 3: 1000, 4: 3000}[dims]
        if extended:
            extra = {2: 0, 3: 0x80000000, 4: 0xC0000000}[dims] + (0x20000000 if srid and top else 0)
        return struct.pack(order + "BI", order == "<", k + extra) + (struct.pack(order + "I", srid) if extended and srid and top else b"")

    def one(k, rings, top=True):
        if k == 1:
            return code(1, top) + points(rings[0])
        if k == 2:
            return code(2, top) + struct.pack(order + "I", len(rings[0])) + points(rings[0])
        return code(3, top) + struct.pack(order + "I", len(rings)) + b"".join(struct.pack(order + "I", len(r)) + points(r) for r in rings)

    if kind <= 3:
        return one(kind, parts[0])
    return code(kind, True) + struct.pack(order + "I", len(parts)) + b"".join(one(kind - 3, p, False) for p in parts)


def spatialite(kind, parts, order="<"):
    body = plain(kind, parts, order)[5:] if kind <= 3 else struct.pack(order + "I", len(parts)) + b"".join(b"\x69" + plain(kind - 3, [p], order)[1:] for p in parts)
    return b"\x00" + struct.pack(order + "Bi4d", order == "<", 5070, 0, 0, 12, 4) + b"\x7c" + struct.pack(order + "I", kind) + body + b"\xfe"


def package(blob, envelope=1):
    return b"GP\x00" + bytes([envelope << 1 | 1]) + struct.pack("<i", 5070) + b"\0" * (0, 32, 48, 48, 64)[envelope] + blob


def flat(parts):
    return [(p, r, k, float(x), float(y)) for p, rings in enumerate(parts) for r, ring in enumerate(rings) for k, (x, y) in enumerate(ring)]


GOOD = [
    (plain(3, FRAME[:1]), FRAME[:1]), (plain(6, FRAME, ">"), FRAME), (plain(6, FRAME, dims=3), FRAME), (plain(3, FRAME[:1], dims=4, extended=True, srid=5070), FRAME[:1]),
    (spatialite(6, FRAME), FRAME), (spatialite(3, FRAME[:1], ">"), FRAME[:1]), (package(plain(6, FRAME)), FRAME), (package(plain(1, [[[(3, 4)]]]), 4), [[[(3, 4)]]]),
    (plain(2, [[FRAME[0][0]]]), [[FRAME[0][0]]]), (spatialite(5, [[FRAME[0][0]], [FRAME[0][1]]]), [[FRAME[0][0]], [FRAME[0][1]]]), (plain(4, [[[(1, 2)]], [[(3, 4)]]]), [[[(1, 2)]], [[(3, 4)]]]),
    (plain(3, [[]]), []), (plain(1, [[[(float("nan"), float("nan"))]]]), []),
]


def test_blobs(spark, monkeypatch):
    monkeypatch.setattr(wkb, "ROWS", 4)
    bad = [b"", b"\x01", plain(3, FRAME[:1])[:-5], b"\x01\x63\0\0\0", spatialite(6, FRAME).replace(b"\x69", b"\x68"), plain(3, [[[(0, 0)]]])[:9] + b"\xff\xff\xff\xff"]
    rows = [(i, blob) for i, (blob, _) in enumerate(GOOD)] + [(100 + i, bytes(x)) for i, x in enumerate(bad)] + [(200, None)]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None, i, "x") for i, b in rows], "shape binary, id int, part string")
    got = {}
    for r in wkb.vertices(df, "shape").collect():
        got.setdefault(r.id, []).append((r.part, r.ring, r.ord, r.x, r.y) if r.problem is None else r.problem)
    for i, (_, parts) in enumerate(GOOD):
        assert sorted(got.get(i, [])) == flat(parts), i
    assert all(len(got[100 + i]) == 1 and isinstance(got[100 + i][0], str) for i in range(len(bad))) and 200 not in got


def test_layers_feed_overlay(spark, tmp_path):
    path = str(tmp_path / "grid.sqlite")
    con = sqlite3.connect(path)
    con.execute("create table subbasin2d (name text, geometry blob)")
    con.executemany("insert into subbasin2d values (?, ?)", [("a", spatialite(6, FRAME)), ("b", spatialite(3, [[[(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]]])), ("c", None)])
    con.execute("create table empty (geometry blob)")
    con.executemany("insert into subbasin2d (rowid, name, geometry) values (?, 'far', ?)", [(k, spatialite(3, [[[(k, 50), (k + 1, 50), (k + 1, 51), (k, 50)]]])) for k in (90_000, 190_000)])
    con.commit()
    con.close()
    v = tables.layer_vertices(spark, path, "subbasin2d")
    areas = {r.id: r.area for r in overlay.areas(v).collect()}
    assert areas == {1: 13.0, 2: 16.0, 90_000: 0.5, 190_000: 0.5}
    both = {(r.a_id, r.b_id): r.area for r in overlay.intersections(v, v).collect()}
    assert both[1, 2] == pytest.approx(3.0)
    p = spark.createDataFrame([(1, 2.0, 2.5), (2, 0.5, 0.5), (3, 11.9, 0.5)], "point int, px double, py double")
    assert {tuple(r) for r in geometry.within(p, v, 1.0).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert tables.layer_vertices(spark, path, "empty").count() == 0
    assert {(r.layer, r.n) for r in tables.read_layers(spark, path).collect()} == {("subbasin2d", 5)}


def test_features_keep_parts_and_holes(spark):
    shapes = [("MultiPolygon", FRAME), ("Polygon", FRAME[0]), ("MultiLineString", FRAME[0]), ("LineString", FRAME[0][0]), ("MultiPoint", [(1, 2), (3, 4)]), ("Point", (5, 6)), ("GeometryCollection", None)]
    doc = json.dumps({"features": [{"geometry": {"type": k, "coordinates": c}, "properties": {}} for k, c in shapes] + [{"geometry": None, "properties": {}}]})
    f = documents.features(spark.createDataFrame([("f", doc)], "file string, content string"))
    got = {}
    for r in documents.vertices(f).collect():
        got.setdefault(r.id, []).append((r.part, r.ring, r.ord, r.x, r.y))
    want = [FRAME, FRAME[:1], [[FRAME[0][0]], [FRAME[0][1]]], [[FRAME[0][0]]], [[[(1, 2)]], [[(3, 4)]]], [[[(5, 6)]]]]
    assert {k: sorted(v) for k, v in got.items()} == {k: flat(w) for k, w in enumerate(want)}


def test_products_have_a_manifest(spark, tmp_path):
    import datetime as dt
    import glob
    import hashlib
    import os

    from freshet.sources import sinks

    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=h), m, float(h)) for h in range(6) for m in (2, 1)], "time timestamp_ntz, mapping_id int, value double")
    summary = spark.createDataFrame([(1, True, True), (2, True, False)], "mapping_id int, valid boolean, recedes boolean")
    path = str(tmp_path / "product")
    sinks.write_product(df, summary, path)
    doc = json.loads(spark.read.text(f"{path}/manifest").first().value)
    assert doc["time"] == {"start": "2024-01-01T00:00:00", "end": "2024-01-01T05:00:00"} and doc["rows"] == 12
    assert doc["status"] == {"series": 2, "qualified": 1, "all_qualified": False} and [c["name"] for c in doc["columns"]] == ["time", "mapping_id", "value"]
    files = {os.path.relpath(f, path): f for f in glob.glob(f"{path}/*/*.parquet")}
    assert {a["href"] for a in doc["assets"]} == set(files)
    for a in doc["assets"]:
        raw = open(files[a["href"]], "rb").read()
        assert (a["size_bytes"], a["sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert sinks.product_problems(spark, path).count() == 0
    with pytest.raises(sinks.Rejected):
        sinks.write_product(df, summary, path)
    first, second = sorted(files)[:2]
    os.rename(files[first], files[first].replace("part-", "other-"))
    with open(files[second], "ab") as f:
        f.write(b"x")
    os.remove(os.path.join(os.path.dirname(files[second]), f".{os.path.basename(files[second])}.crc"))  # the local file system's own check
    got = {r.href: r.problem for r in sinks.product_problems(spark, path).collect()}
    assert got == {first: "missing", first.replace("part-", "other-"): "not in the manifest", second: "changed"}
