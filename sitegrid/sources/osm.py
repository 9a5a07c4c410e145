"""OpenStreetMap extracts (PBF): blocks read side by side, elements as rows, areas and lines assembled by joins."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.operators.skew import skew_join

#: The classes of ways that are roads for vehicles or paths.
ROADS = "motorway trunk primary secondary tertiary unclassified residential service track path motorway_link trunk_link primary_link secondary_link tertiary_link living_street".split()
SCHEMA = "kind string, id bigint, lat double, lon double, tags map<string, string>, refs array<bigint>"
#: Elements of a block, as writers of the format use at most.
BLOCK = 8_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message; lengths are taken as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def _packed(data: bytes, signed: bool = False, deltas: bool = False) -> np.ndarray:
    """A packed list of varints; ``signed``: zigzag coded; ``deltas``: each is added to the one before."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        some = starts + k <= ends
        out[some] |= (raw[starts[some] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    values = (out >> np.uint64(1)).astype(np.int64) ^ -(out & np.uint64(1)).astype(np.int64) if signed else out.astype(np.int64)
    return np.cumsum(values) if deltas else values


def elements(block: bytes) -> Iterator[dict]:
    """The nodes and ways of a primitive block as rows."""
    top = list(_fields(block))
    texts = [v.decode("utf-8", "replace") for n, table in top if n == 1 for m, v in _fields(table) if m == 1]
    number = dict(top)
    scale, south, west = number.get(17, 100), number.get(19, 0), number.get(20, 0)
    for _, group in (f for f in top if f[0] == 2):
        for n, message in _fields(group):
            if n == 2:
                f = dict(_fields(message))
                ids, lats, lons = (_packed(f.get(k, b""), True, True) for k in (1, 8, 9))
                tags: list[dict] = [{} for _ in ids]
                pairs, i, at = _packed(f.get(10, b"")).tolist(), 0, 0
                while at < len(pairs) and i < len(tags):
                    if pairs[at] == 0:
                        i, at = i + 1, at + 1
                    else:
                        tags[i][texts[pairs[at]]] = texts[pairs[at + 1]]
                        at += 2
                for x, la, lo, t in zip(ids.tolist(), lats.tolist(), lons.tolist(), tags, strict=True):
                    yield {"kind": "node", "id": x, "lat": (south + scale * la) * 1e-9, "lon": (west + scale * lo) * 1e-9, "tags": list(t.items()), "refs": None}
            elif n == 3:
                f = dict(_fields(message))
                keys, values = _packed(f.get(2, b"")).tolist(), _packed(f.get(3, b"")).tolist()
                yield {"kind": "way", "id": f[1], "lat": None, "lon": None, "tags": [(texts[k], texts[v]) for k, v in zip(keys, values, strict=True)], "refs": _packed(f.get(8, b""), True, True).tolist()}


def _blobs(path: str) -> list[tuple[int, int]]:
    """Place and size of each data blob: only the headers between them are read."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(_fields(f.read(struct.unpack(">I", head)[0])))
            if header[1] == b"OSMData":
                out.append((f.tell(), header[3]))
            f.seek(header[3], 1)
    return out


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Nodes and ways of an extract: ``kind, id, lat, lon, tags, refs``; filter by tags with column expressions.

    The file must be in a folder all executors see. The driver reads the headers (a number pair for each block of some
    thousand elements); blocks are read, inflated and decoded by the tasks. Relations are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = spark.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                for at, size in zip(b.column("at").to_pylist(), b.column("size").to_pylist(), strict=True):
                    f.seek(at)
                    blob = dict(_fields(f.read(size)))
                    rows = list(elements(blob[1] if 1 in blob else zlib.decompress(blob[3])))
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    blobs = _blobs(path)
    frame = spark.createDataFrame(blobs, "at bigint, size bigint")
    return frame.repartition(max(1, min(len(blobs), 4096))).mapInArrow(decode, schema)


def lines(osm: DataFrame, ways: DataFrame) -> DataFrame:
    """``id, tags, ring, closed`` of ways: their nodes' places in order. A node that isn't there is left out.

    Ways meet their nodes by a join on the node's number (a node many ways share is salted); the format bounds a way's
    nodes (2,000), so its list fits.
    """
    used = ways.select("id", "tags", "refs").select("id", F.posexplode("refs").alias("i", "node"))
    places = osm.where("kind = 'node'").select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    met = skew_join(used, places, ["node"])
    rings = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    closed = (F.size("refs") > 3) & (F.get("refs", F.lit(0)) == F.element_at("refs", -1))
    return ways.where(F.size("refs") > 0).select("id", "tags", closed.alias("closed")).join(rings, "id").select("id", "tags", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"), "closed")


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _message(fields: list[tuple[int, int | bytes]]) -> bytes:
    return b"".join(_number(n << 3) + _number(v) if isinstance(v, int) else _number(n << 3 | 2) + _number(len(v)) + v for n, v in fields)


def _list(values, signed: bool = False) -> bytes:
    return b"".join(_number(v << 1 ^ v >> 63 if signed else v) for v in values)


def _steps(values: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def block_of(rows: list[dict]) -> bytes:
    """A primitive block of nodes and ways (rows as :func:`elements` gives them)."""
    texts: dict[str, int] = {"": 0}
    word = lambda t: texts.setdefault(t, len(texts))
    nodes, ways = [r for r in rows if r["kind"] == "node"], [r for r in rows if r["kind"] == "way"]
    groups = []
    if nodes:
        whole = [[round(r[c] * 1e7) for r in nodes] for c in ("lat", "lon")]
        pairs = [x for r in nodes for x in [*[word(t) for kv in r["tags"] for t in kv], 0]]
        groups.append((2, _message([(1, _list(_steps([r["id"] for r in nodes]), True)), (8, _list(_steps(whole[0]), True)), (9, _list(_steps(whole[1]), True)), (10, _list(pairs))])))
    groups += [(3, _message([(1, r["id"]), (2, _list([word(k) for k, _ in r["tags"]])), (3, _list([word(v) for _, v in r["tags"]])), (8, _list(_steps(r["refs"]), True))])) for r in ways]
    return _message([(1, _message([(1, t.encode()) for t in texts])), (2, _message(groups)), (17, 100)])


def write_osm(elements: DataFrame, path: str) -> None:
    """Nodes and ways as an extract, by one task: the format is one file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "wb") as f:
            for b in batches:
                rows = b.to_pylist()
                for low in range(0, len(rows), BLOCK):
                    some = [r | {"tags": r["tags"] or [], "refs": r["refs"] or []} for r in rows[low : low + BLOCK]]
                    raw = block_of(some)
                    blob = _message([(2, len(raw)), (3, zlib.compress(raw))])
                    header = _message([(1, b"OSMData"), (3, len(blob))])
                    f.write(struct.pack(">I", len(header)) + header + blob)
                    n += len(some)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    written = elements.select("kind", "id", "lat", "lon", "tags", "refs").coalesce(1).mapInArrow(write, "n long").agg(F.sum("n")).collect()[0][0]
    if written is None:  # no rows, no task
        next(write(iter(())))
