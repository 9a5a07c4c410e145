"""GeoPackage files (SQLite databases with geometries), read in ranges of row numbers and written by one task."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows read by one task.
CHUNK = 50_000
#: Fixed values of the file format: its application id, and the head of a geometry (magic, version, flags for little-endian without envelope, system 4326).
APPLICATION_ID, HEAD = 0x47504B47, b"GP\x00\x01" + struct.pack("<i", 4326)
#: Bytes of the envelope by the code in a geometry's flags.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def rings_of(blob: bytes | None) -> tuple[str | None, list[list[tuple[float, float]]]]:
    """Kind (point, line, polygon or another number) and coordinates of a geometry: all its points, lines or rings as lists."""
    if not blob or blob[:2] != b"GP":
        return None, []
    at = 8 + ENVELOPES.get(blob[3] >> 1 & 7, 0)
    kinds, parts = [], []

    def take(fmt: str, order: str):
        nonlocal at
        values = struct.unpack_from(order + fmt, blob, at)
        at += struct.calcsize(order + fmt)
        return values

    def points(n: int, order: str, size: int) -> list[tuple[float, float]]:
        flat = take(f"{n * size}d", order)
        return [(flat[i], flat[i + 1]) for i in range(0, n * size, size)]

    def geometry() -> None:
        order = "<" if take("B", "<")[0] else ">"
        code = take("I", order)[0]
        size = {0: 2, 1: 3, 2: 3, 3: 4}[code // 1000 % 10]
        kind = code % 1000
        kinds.append(kind)
        if kind == 1:
            parts.append(points(1, order, size))
        elif kind == 2:
            parts.append(points(take("I", order)[0], order, size))
        elif kind == 3:
            for _ in range(take("I", order)[0]):
                parts.append(points(take("I", order)[0], order, size))
        else:
            for _ in range(take("I", order)[0]):
                geometry()

    geometry()
    return {1: "point", 2: "line", 3: "polygon"}.get(kinds[-1], str(kinds[-1])), parts


def geometry_blob(kind: str, ring: Sequence[tuple[float, float]]) -> bytes:
    """A point, line or polygon of one ring as the format stores it."""
    flat = [v for p in ring for v in p]
    head = HEAD + b"\x01" + struct.pack("<I", {"point": 1, "line": 2, "polygon": 3}[kind])
    counts = {"point": b"", "line": struct.pack("<I", len(ring)), "polygon": struct.pack("<II", 1, len(ring))}[kind]
    return head + counts + struct.pack(f"<{len(flat)}d", *flat)


def read_geopackage(spark: SparkSession, path: str, layer: str, columns: dict[str, str], geometry: str | None = None, skip: int = 0, most: int | None = None, box: tuple[float, float, float, float] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows of a layer: ``columns`` (name to Spark type), and with ``geometry`` its ``kind`` and ``parts``.

    The file must be in a folder all executors see. Row numbers are cut into ranges of ``chunk``; each task opens the file
    read-only and reads its range by the primary key, so a row is read once and nothing goes through the driver but the
    greatest row number. ``skip`` and ``most`` cut by row number, ``box`` (west, south, east, north) keeps geometries with a
    point in it. Without ``geometry`` that column isn't read.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        last = db.execute(f"select max(rowid) from {_quoted(layer)}").fetchone()[0] or 0
    stop = last if most is None else min(last, skip + most)
    fields = ", ".join(f"{n} {t}" for n, t in columns.items()) + (", kind string, parts array<array<struct<x: double, y: double>>>" if geometry else "")
    schema = spark.createDataFrame([], fields).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    wanted = ", ".join(_quoted(c) for c in [*columns, *([geometry] if geometry else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for b in batches:
                for start in b.column("id").to_pylist():
                    rows = db.execute(f"select {wanted} from {_quoted(layer)} where rowid > ? and rowid <= ? order by rowid", (start, min(start + chunk, stop))).fetchall()
                    out = []
                    for r in rows:
                        if geometry:
                            kind, parts = rings_of(r[-1])
                            if box and not any(box[0] <= x <= box[2] and box[1] <= y <= box[3] for p in parts for x, y in p):
                                continue
                            r = (*r[:-1], kind, [[{"x": x, "y": y} for x, y in p] for p in parts])
                        out.append(dict(zip(arrow.names, r, strict=True)))
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ranges = spark.range(skip, max(stop, skip), chunk, numPartitions=max(1, -(-(max(stop, skip) - skip) // chunk)))
    return ranges.mapInArrow(read, schema)


def write_geopackage(df: DataFrame, path: str, layer: str, geometry: str = "ring", kind: str = "kind") -> None:
    """``df`` as a layer of a new file, by one task: the format is a single database file.

    ``kind`` and ``geometry`` (array of (x, y)) give the geometry; the other columns are numbers or text. Rows come in
    batches, in no set order.
    """
    names = [c for c in df.columns if c not in (geometry, kind)]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        if os.path.exists(path):  # a task that is tried again starts anew
            os.remove(path)
        n = 0
        with sqlite3.connect(path) as db:
            db.execute(f"pragma application_id = {APPLICATION_ID}")
            db.execute("create table gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer)")
            db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
            db.execute(f"create table {_quoted(layer)} (fid integer primary key, geom blob, {', '.join(_quoted(c) for c in names)})")
            db.execute("insert into gpkg_contents values (?, 'features', ?, 4326)", (layer, layer))
            db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', 4326, 0, 0)", (layer,))
            for b in batches:
                rows = [(geometry_blob(r[kind], [(p["x"], p["y"]) for p in r[geometry]]) if r[kind] and r[geometry] else None, *[r[c] for c in names]) for r in b.to_pylist()]
                db.executemany(f"insert into {_quoted(layer)} (geom, {', '.join(_quoted(c) for c in names)}) values (?{', ?' * len(names)})", rows)
                n += len(rows)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    written = df.coalesce(1).mapInArrow(write, "n long").agg(F.sum("n")).collect()[0][0]
    if written is None:  # no rows, no task
        next(write(iter(())))
