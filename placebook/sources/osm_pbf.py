"""OSM PBF files, read and written by Spark's text source: a row for each blob, decoded in Arrow batches from the public format.

A data blob's header holds the name OSMData, which compressed content does not: files are split into rows at that name, so
that they come from any path that Spark reads, in as many tasks as their bytes need.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, id long, lat double, lon double, refs array<long>, tags map<string,string>"
_REFS, _TAGS = pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", _REFS), ("tags", _TAGS)])
#: The field of a blob header that begins with the type of the blob.
_MARK = "\n\x07OSMData"
#: An unknown field, which readers pass over; blobs end with it, as text rows have an end.
_END = "x\x00"
#: Objects of a written blob.
_BLOCK = 8000


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out, at
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        elif kind == 1:
            value, at = b[at : at + 8], at + 8
        elif kind == 5:
            value, at = b[at : at + 4], at + 4
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield key >> 3, value


def _signed(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def _packed(b: bytes) -> np.ndarray:
    """The numbers of a packed field, all at once."""
    x = np.frombuffer(b, np.uint8)
    last = np.flatnonzero(x < 128)
    if not len(last):
        return np.zeros(0, np.uint64)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(last[-1] + 1) - np.repeat(first, last - first + 1)
    return np.add.reduceat((x[: last[-1] + 1] & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def _summed(b: bytes) -> np.ndarray:
    """The numbers of a packed field of signed differences."""
    x = _packed(b)
    return np.cumsum((x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64))


def _content(blob: bytes) -> bytes:
    fields = dict(_fields(blob))
    if 1 in fields:
        return fields[1]
    if 3 in fields:
        return zlib.decompress(fields[3])
    raise ValueError("only raw and zlib blobs are read")


def _data(row: bytes) -> bytes | None:
    """The blob in what follows a mark: the rest of its header, the blob, and the length of the next header; None before a file's first mark."""
    if row[:1] in (b"", b"\0"):
        return None
    at, size = 0, None
    while size is None:
        key, at = _varint(row, at)
        value, at = _varint(row, at)
        if key >> 3 == 3:
            size = value
        elif key & 7 == 2:
            at += value
    if at + size > len(row):
        raise ValueError("a blob that is not whole, or that holds the header of another")
    return row[at : at + size]


def _batches(block: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA in a primitive block, a batch for each kind of each of its groups."""
    strings: list[str] = []
    groups, scale, lat0, lon0 = [], 100, 0, 0
    for number, value in _fields(block):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for n, v in _fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            scale = value
        elif number == 19:
            lat0 = value
        elif number == 20:
            lon0 = value
    # offsets are signed 64-bit
    lat0, lon0 = (x - (1 << 64) if x >= 1 << 63 else x for x in (lat0, lon0))
    table = pa.array(strings, pa.string())

    def tagged(fields: dict) -> tuple[np.ndarray, np.ndarray]:
        keys, values = _packed(fields.get(2, b"")), _packed(fields.get(3, b""))
        n = min(len(keys), len(values))
        return keys[:n], values[:n]

    def batch(kind: str, ids, lats, lons, refs, counts, keys, values) -> pa.RecordBatch:
        n = len(ids)
        offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        tags = pa.MapArray.from_arrays(offsets, table.take(pa.array(keys, pa.int64())), table.take(pa.array(values, pa.int64())))
        place = [pa.nulls(n, pa.float64()) if x is None else pa.array(1e-9 * (x0 + scale * x), pa.float64()) for x, x0 in ((lats, lat0), (lons, lon0))]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind), n), pa.array(ids, pa.int64()), *place, pa.nulls(n, _REFS) if refs is None else pa.array(refs, _REFS), tags.cast(_TAGS)], schema=_ARROW)

    for group in groups:
        single: dict[int, list[dict]] = {1: [], 3: [], 4: []}
        for number, value in _fields(group):
            if number == 2:
                f = dict(_fields(value))
                ids, lats, lons = (_summed(f.get(n, b"")) for n in (1, 8, 9))
                pairs = _packed(f.get(10, b"")).astype(np.int64)
                # a node's keys and values end with a 0, which is no string's number; without any tags all is left out
                ends = np.flatnonzero(pairs == 0)
                if len(pairs) and len(ends) != len(ids):
                    raise ValueError("the tags of dense nodes are not as many as the nodes")
                counts = np.diff(ends, prepend=-1) // 2 if len(pairs) else np.zeros(len(ids), np.int64)
                flat = pairs[pairs != 0]
                yield batch("node", ids, lats, lons, None, counts, flat[::2], flat[1::2])
            elif number in single:
                single[number].append(dict(_fields(value)))
        for number, kind in ((1, "node"), (3, "way"), (4, "relation")):
            if some := single[number]:
                tags = [tagged(f) for f in some]
                places = [np.array([_signed(f[n]) for f in some], np.int64) if number == 1 else None for n in (8, 9)]
                refs = [_summed(f.get(8, b"")) for f in some] if number == 3 else None
                ids = [_signed(f[1]) if number == 1 else f[1] for f in some]
                yield batch(kind, ids, *places, refs, [len(k) for k, _ in tags], *(np.concatenate(x) for x in zip(*tags)))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for row in part.column(0):
            if blob := _data(row.as_py()):
                yield from _batches(_content(blob))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The nodes, ways and relations (SCHEMA) of PBF files at any path that Spark reads; tags without a value are none, positions are of nodes only."""
    return spark.read.option("lineSep", _MARK).text(path).select(F.col("value").cast("binary")).mapInArrow(_decoded, SCHEMA)


def _number(x: int) -> bytes:
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes(out + bytes([x]))


def _field(n: int, value: int | bytes) -> bytes:
    return _number(n << 3) + _number(value) if isinstance(value, int) else _number(n << 3 | 2) + _number(len(value)) + value


def _zigzag(x: int) -> int:
    return x << 1 if x >= 0 else (-x << 1) - 1


def _blob(kind: bytes, content: bytes) -> bytes:
    body = _field(2, len(content)) + _field(3, zlib.compress(content))
    head = _field(1, kind) + _field(3, len(body) + len(_END))
    return struct.pack(">I", len(head)) + head + body


def _block_of(rows: list[dict]) -> bytes:
    """A primitive block of nodes and ways."""
    strings = {"": 0}
    put = lambda x: strings.setdefault(x, len(strings))
    groups = []
    for number, kind in ((1, "node"), (3, "way")):
        out = []
        for r in (r for r in rows if r["kind"] == kind):
            tags = [(k, v) for k, v in r["tags"] or () if v is not None]
            body = _field(1, _zigzag(r["id"]) if number == 1 else r["id"]) + _field(2, b"".join(_number(put(k)) for k, _ in tags)) + _field(3, b"".join(_number(put(v)) for _, v in tags))
            if number == 1:
                body += b"".join(_field(n, _zigzag(round(r[x] * 1e7))) for n, x in ((8, "lat"), (9, "lon")))
            else:
                refs = r["refs"] or []
                body += _field(8, b"".join(_number(_zigzag(b - a)) for a, b in zip([0, *refs], refs)))
            out.append(_field(number, body))
        if out:
            groups.append(_field(2, b"".join(out)))
    return _field(1, b"".join(_field(1, x.encode()) for x in strings)) + b"".join(groups)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    header = _field(4, b"OsmSchema-V0.6")
    yield pa.RecordBatch.from_arrays([pa.array([_blob(b"OSMHeader", header)], pa.binary())], ["value"])
    for part in batches:
        for at in range(0, part.num_rows, _BLOCK):
            content = _block_of(part.slice(at, _BLOCK).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_blob(b"OSMData", content)], pa.binary())], ["value"])


def write(objects: DataFrame, path: str) -> None:
    """Write the nodes and ways of rows (SCHEMA) as a folder of PBF files, one a partition."""
    rows = objects.select("kind", F.col("id").cast("long"), F.col("lat").cast("double"), F.col("lon").cast("double"), "refs", "tags")
    rows.mapInArrow(_encoded, "value binary").select(F.col("value").cast("string")).write.option("lineSep", _END).text(path)
