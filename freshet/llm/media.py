"""Media columns: texts stored as 8-bit sample files, found again by signature sniffing.

An Aho-Corasick automaton over magic bytes proposes (offset, format) candidates; a validator for each format
confirms structure and declared lengths. A confirmed match at offset 0 corrects the declared type, later ones
are embedded media and are carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

BLOCK = 192
WAV_HEADER = 44

# Magic bytes of the formats, by the formats' public specifications.
MAGIC = {
    "audio/wav": b"RIFF",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "image/bmp": b"BM",
    "application/zip": b"PK\x03\x04",
}


def encode_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM; every payload byte is one sample."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload


def _wav(b: bytes, at: int) -> int:
    """Length of the RIFF/WAVE file at ``at``, 0 if its chunks do not add up."""
    if len(b) - at < WAV_HEADER or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, kinds = at + 12, set()
    if end > len(b):
        return 0
    while pos + 8 <= end:
        kinds.add(b[pos : pos + 4])
        pos += 8 + struct.unpack_from("<I", b, pos + 4)[0]
        pos += pos - at & 1 if pos < end else 0
    return end - at if pos == end and {b"fmt ", b"data"} <= kinds else 0


def _png(b: bytes, at: int) -> int:
    pos = at + 8
    first = True
    while pos + 12 <= len(b):
        n = struct.unpack_from(">I", b, pos)[0]
        kind = b[pos + 4 : pos + 8]
        if pos + 12 + n > len(b) or first and kind != b"IHDR" or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return 0
        pos += 12 + n
        first = False
        if kind == b"IEND":
            return pos - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or at + 13 > len(b):
        return 0
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos = blocks(pos + 10 + (3 << (flags & 7) + 1 if flags & 128 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return 0
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2:
            return 0
        pos += 2 + n
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", pos)
            return end + 2 - at if end >= 0 else 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    return size if zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size <= len(b) - at else 0


def _zip(b: bytes, at: int) -> int:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if offset + size == end - at and end + 22 + note <= len(b) else 0


VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/zip": _zip}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    a.make_automaton()
    return a


def sniff(blob: bytes, auto: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Confirmed (offset, length, type) from left to right; what lies inside a confirmed container's own payload is listed too."""
    found = []
    for last, (kind, n) in auto.iter(blob.decode("latin-1")):
        at = last - n + 1
        if size := VALIDATORS[kind](blob, at):
            found.append((at, size, kind))
    return sorted(found)


def sniff_media(df: DataFrame, blob: str = "blob", declared: str = "declared") -> DataFrame:
    """Each row with ``media_type`` (sniffed at offset 0, else the declared one), ``corrected`` and ``embedded``.

    Columns of df that have one of those names, in any case, come back with ``_in`` added to it. A null blob gives the declared type, corrected false and no embedded media. Embedded rows are
    struct(offset, length, type, bytes), all of them, nested ones too.
    """
    names = df.columns
    fields = [T.StructField(f"{f.name}_in" if f.name.lower() in ("media_type", "corrected", "embedded") else f.name, f.dataType) for f in df.schema.fields]
    ddl = "media_type string, corrected boolean, embedded array<struct<offset:long,length:long,type:string,bytes:binary>>"
    schema = T.StructType(fields + T._parse_datatype_string(ddl).fields)

    def run(batches):
        auto = automaton()
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))
        for b in batches:
            types, fixed, inner = [], [], []
            for x, d in zip(b.column(names.index(blob)), b.column(names.index(declared)).to_pylist()):
                x = x.as_py()
                found = sniff(x, auto) if x else []
                top = next((k for at, _, k in found if at == 0), d)
                types.append(top)
                fixed.append(top != d)
                inner.append([{"offset": at, "length": n, "type": k, "bytes": x[at : at + n]} for at, n, k in found if at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(inner, kind)], names=[*[f.name for f in fields], "media_type", "corrected", "embedded"])

    return df.select(*names).mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Digest columns of every text's stored form; one row for each row of ``docs(doc_id, text)``.

    Null text counts as empty; an empty text is one block of spaces. The stored form is declared as
    application/octet-stream; sniffing must confirm it as WAV at offset 0, and the payload is read back from the
    data chunk whose place the validated structure gives.
    """

    def run(batches):
        auto = automaton()
        for b in batches:
            out = [[] for _ in range(8)]
            for i, j, data, offsets in common.text_blocks(b):
                for k, doc in zip(range(i, j), b.column(0)[i:j].to_pylist()):
                    raw = data[offsets[k - i] : offsets[k - i + 1]].tobytes()
                    payload = raw + b" " * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)
                    blob = encode_wav(payload)
                    found = sniff(blob, auto)
                    if not found or found[0][0] or found[0][2] != "audio/wav":
                        raise ValueError("stored form not confirmed")
                    n = struct.unpack_from("<I", blob, WAV_HEADER - 4)[0]
                    back = blob[WAV_HEADER : WAV_HEADER + n]
                    samples = np.frombuffer(back, np.uint8)
                    level = samples.astype(np.int16) - 128
                    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
                    feature = f"audio/wav;rate=8000;samples={n};sum={int(samples.sum(dtype=np.int64))};crossings={crossings};embedded={len(found) - 1}"
                    row = (doc, len(raw), n, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature)
                    for c, v in zip(out, row):
                        c.append(v)
            long, text = pa.int64(), pa.string()
            kinds = [long, long, long, text, long, long, text, text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(common.documents(spark, sf_dir))


ORACLE = """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, len(h) // 2 AS n, greatest(192, (len(h) // 2 + 191) // 192 * 192) AS m, h FROM d),
q AS (SELECT doc_id, n, m, h || repeat('20', m - n) AS h FROM p),
b AS (SELECT *, list_transform(regexp_extract_all(h, '..'), lambda x: (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1) AS b FROM q),
w AS (SELECT *, '52494646' || printf('%02X%02X%02X%02X', (m + 36) % 256, (m + 36) // 256 % 256, (m + 36) // 65536 % 256, (m + 36) // 16777216) || '57415645666D74201000000001000100401F0000401F00000100080064617461' || printf('%02X%02X%02X%02X', m % 256, m // 256 % 256, m // 65536 % 256, m // 16777216) || h AS f FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  CAST(xor(list_reduce(list_concat([4294967295], CAST(b[-16:] AS BIGINT[])), lambda c, x: xor(c // 256, t[1 + xor(c, x) % 256])), 4294967295) AS BIGINT) AS tail_crc32,
  CAST(m + 44 AS BIGINT) AS media_bytes, sha256(unhex(f)) AS media_sha256,
  'audio/wav;rate=8000;samples=' || m || ';sum=' || CAST(list_sum(b) AS BIGINT) || ';crossings=' || len(list_filter(range(1, m), lambda i: (b[i] < 128) <> (b[i + 1] < 128))) || ';embedded=0' AS feature
FROM w, tab"""
