"""Vertices of PLY scans, read in ranges.

A header is read once a file. Binary vertices have one size, so a range of them
is a range of bytes; lines of ASCII files are counted by ranges first. Faces and
other elements are skipped, and what stands before the vertices must have no
lists in binary files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a file that one task reads, and that it holds at once.
RANGE_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
#: Types of the format, in their long and short names (fixed values).
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
ORDERS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
HEAD = "path string, kind string, n_vertices long, skipped_lines long, first_byte long, record_bytes int, n_bytes long, names array<string>, types array<string>"
VERTICES = "path string, vertex long, x double, y double, z double, red int, green int, blue int"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def header(path: str) -> dict:
    """Kind, vertex count, where the vertices begin, and their properties."""
    system, name = _opened(path)
    with system.open_input_file(name) as file:
        n_bytes, data = file.size(), b""
        while (end := data.find(b"end_header")) < 0 or b"\n" not in data[end:]:
            if not (more := file.read(4096)):
                raise ValueError(f"{path} has no whole PLY header")
            data += more
    body = data.index(b"\n", end) + 1
    lines = [x.split() for x in data[:end].decode("ascii", "replace").splitlines()]
    if lines[0] != ["ply"]:
        raise ValueError(f"{path} is no PLY file")
    kind = next((x[1] for x in lines if x[:1] == ["format"]), "")
    elements: list[tuple[str, int, list[list[str]]]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"]:
            elements[-1][2].append(x[1:])
    at = next((k for k, e in enumerate(elements) if e[0] == "vertex"), None)
    before = elements[: at or 0]
    if kind not in ORDERS or at is None or any(p[0] not in TYPES for _, _, props in [elements[at], *(before if kind != "ascii" else [])] for p in props):
        raise ValueError(f"{path}: a PLY of this kind is not read")
    size = lambda props: sum(np.dtype(TYPES[p[0]]).itemsize for p in props)
    _, n, props = elements[at]
    skipped = sum(e[1] for e in before)
    if kind != "ascii":
        body += sum(e[1] * size(e[2]) for e in before)
        if body + n * size(props) > n_bytes:
            raise ValueError(f"{path} ends before its {n} vertices")
    return {"path": path, "kind": kind, "n_vertices": n, "skipped_lines": skipped, "first_byte": body, "record_bytes": size(props), "n_bytes": n_bytes, "names": [p[1] for p in props], "types": [TYPES[p[0]] for p in props]}


def _table(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each file; only headers are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([header(p) for p in batch.column("path").to_pylist()], _HEAD)

    return _table(spark, paths).mapInArrow(run, HEAD)


_HEAD = pa.schema([("path", pa.string()), ("kind", pa.string()), *((c, pa.int64()) for c in ("n_vertices", "skipped_lines", "first_byte")), ("record_bytes", pa.int32()), ("n_bytes", pa.int64()), ("names", pa.list_(pa.string())), ("types", pa.list_(pa.string()))])


def candidates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """pref (place in the list), path and n_vertices, as annotations.mesh_matching takes them."""
    order = spark.createDataFrame(list(enumerate(paths)), "pref int, path string")
    return order.join(headers(spark, list(dict.fromkeys(paths))).select("path", "n_vertices"), "path").select("pref", "path", "n_vertices")


def _rows(path: str, first: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    if missing := {"x", "y", "z"} - columns.keys():
        raise ValueError(f"{path} has no {', '.join(sorted(missing))} of vertices")
    n = len(columns["x"])
    colours = [pa.array(columns[c].astype(np.int32)) if c in columns else pa.nulls(n, pa.int32()) for c in ("red", "green", "blue")]
    places = [pa.array(columns[c].astype(np.float64)) for c in ("x", "y", "z")]
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n)), *places, *colours], ["path", "vertex", "x", "y", "z", "red", "green", "blue"])


def _binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in (r for b in batches for r in b.to_pylist()):
        kind = np.dtype([(c, ORDERS[r["kind"]] + t) for c, t in zip(r["names"], r["types"], strict=True)])
        system, name = _opened(r["path"])
        with system.open_input_file(name) as file:
            at, end, step = r["at"], min(r["at"] + r["each"], r["n_vertices"]), max(1, r["chunk"] // kind.itemsize)
            while at < end:
                n = min(step, end - at)
                got = np.frombuffer(file.read_at(n * kind.itemsize, r["first_byte"] + at * kind.itemsize), kind)
                yield _rows(r["path"], at, {c: got[c] for c in r["names"]})
                at += n


def _lines(row: dict) -> Iterator[bytes]:
    """The whole lines that begin in a range of bytes, in chunks."""
    system, name = _opened(row["path"])
    end = min(row["at"] + row["each"], row["n_bytes"])
    # a line begins where the byte before is a line's end, so a later range looks one byte back
    inside = row["at"] > row["first_byte"]
    at, held = row["at"] - inside, b""
    with system.open_input_file(name) as file:
        while at < row["n_bytes"]:
            data, start = file.read_at(min(row["chunk"], row["n_bytes"] - at), at), 0
            last = at + len(data) >= end
            if inside:
                start = data.find(b"\n") + 1
                inside = not start
                if (inside and last) or (start and at + start >= end):
                    return
                if inside:
                    at += len(data)
                    continue
            # the last line is the one that ends at or behind the range's last byte
            stop = (data.find(b"\n", max(start, end - 1 - at)) if last else data.rfind(b"\n", start)) + 1
            if stop:
                yield held + data[start:stop]
                held = data[stop:]
                if last:
                    return
            else:
                held += data[start:]
            at += len(data)
    if held:
        yield held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in (r for b in batches for r in b.to_pylist()):
        n = sum(len(x.splitlines()) for x in _lines(r))
        yield pa.RecordBatch.from_pylist([{"path": r["path"], "at": r["at"], "n_lines": n}], pa.schema([("path", pa.string()), ("at", pa.int64()), ("n_lines", pa.int64())]))


def _ascii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r in (r for b in batches for r in b.to_pylist()):
        vertex = r["line"] - r["skipped_lines"]
        for chunk in _lines(r):
            lines = chunk.splitlines()
            mine = [x.split() for x in lines[max(0, -vertex) : max(0, r["n_vertices"] - vertex)]]
            if mine:
                if any(len(x) != len(r["names"]) for x in mine):
                    raise ValueError(f"{r['path']}: a vertex has another number of values than properties")
                values = np.array(mine, dtype=object).astype(str).astype(np.float64)
                yield _rows(r["path"], max(0, vertex), {c: values[:, k] for k, c in enumerate(r["names"])})
            vertex += len(lines)


def vertices(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path, vertex (its number in the file), x, y, z and red, green, blue (null without) of all vertices.

    The number of partitions follows the files' bytes. Files that end early, or
    are of another kind, are errors that name them.
    """
    n_bytes = sum(max(0, system.get_file_info(name).size or 0) for system, name in map(_opened, paths))
    parts = max(spark.sparkContext.defaultParallelism, -(-n_bytes // range_bytes))
    heads = headers(spark, paths).withColumn("chunk", F.lit(chunk_bytes))
    each = F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / F.greatest("record_bytes", F.lit(1))))
    records = heads.filter("kind <> 'ascii' and n_vertices > 0").withColumn("each", each).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_vertices") - 1, F.col("each"))))
    out = records.repartition(parts, "path", "at").mapInArrow(_binary, VERTICES)
    texts = heads.filter("kind = 'ascii' and n_vertices > 0 and n_bytes > first_byte").withColumn("each", F.lit(range_bytes).cast("long")).withColumn("at", F.explode(F.sequence("first_byte", F.col("n_bytes") - 1, F.col("each"))))
    texts = texts.repartition(parts, "path", "at")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("path")
    counts = texts.mapInArrow(_counted, "path string, at long, n_lines long").withColumn("line", F.coalesce(F.sum("n_lines").over(before), F.lit(0).cast("long"))).withColumn("all", F.sum("n_lines").over(along))
    found = texts.join(counts, ["path", "at"])
    short = F.raise_error(F.concat("path", F.lit(" ends before its vertices"))).cast("long")
    found = found.withColumn("line", F.when(F.col("all") >= F.col("skipped_lines") + F.col("n_vertices"), F.col("line")).otherwise(short))
    return out.unionByName(found.repartition(parts, "path", "at").mapInArrow(_ascii, VERTICES))
