"""TFRecord files of tf.train.Example as a Spark data source: spark.read.format("tfrecord").

Options: `features` (comma-separated names; the schema's by default), `path` and
`compression` (gzip or none; told by the first bytes by default). The source reads files that
every executor sees; `read_shards` takes them from any file system Spark knows. One input
partition per file, gzipped or not by its first bytes. Checksums are not verified. Integers
are decoded as signed, unlike a plain varint reader. A file that ends within a record raises
EOFError; an absent feature is null; an empty file has no rows.
"""

from __future__ import annotations

import contextlib
import glob
import gzip
import io
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

KINDS = {1: "bytes", 2: "float", 3: "int"}


def records_in(file: BinaryIO, name: str) -> Iterator[memoryview]:
    """Payloads of an open file's records, one at a time."""
    while head := file.read(12):
        if len(head) < 12:
            raise EOFError(f"{name} ends within a header")
        (size,) = struct.unpack("<Q", head[:8])
        body = file.read(size + 4)
        # the last checksum may be short unnoticed
        if len(body) < size:
            raise EOFError(f"{name} ends within a record")
        yield memoryview(body)[:size]


def frames(path: str | bytes, name: str = "file", zipped: bool | None = None) -> Iterator[memoryview]:
    """Payloads of the records of a file (its path, or its bytes); gzipped or not by its first two bytes unless told."""
    with io.BytesIO(path) if isinstance(path, bytes) else open(path, "rb") as raw:
        if zipped is None:
            zipped = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
        with gzip.GzipFile(fileobj=raw) if zipped else contextlib.nullcontext(raw) as file:
            yield from records_in(file, name if isinstance(path, bytes) else path)


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a message's fields."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire in (1, 5):
            value, at = data[at : at + (8 if wire == 1 else 4)], at + (8 if wire == 1 else 4)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, wire, value


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def values(data: memoryview) -> list:
    """The list of a Feature: bytes, floats or integers, packed or not."""
    for number, _, inner in fields(data):
        kind, out = KINDS.get(number), []
        for n, wire, v in fields(inner) if kind else ():
            if n != 1:
                continue
            if kind == "bytes":
                out.append(bytes(v))
            elif kind == "float":
                out += [x for (x,) in struct.iter_unpack("<f", v)]
            elif wire == 0:
                out.append(signed(v))
            else:
                at = 0
                while at < len(v):
                    one, at = varint(v, at)
                    out.append(signed(one))
        if kind:
            return out
    return []


def example(data: memoryview, wanted: set[str] | None = None) -> dict[str, list]:
    """Features of an Example; stops when all wanted ones are found. Key and value may come in either order."""
    out: dict[str, list] = {}
    for number, _, features in fields(data):
        if number != 1:
            continue
        for n, _, entry in fields(features):
            if n != 1:
                continue
            key = value = None
            for part, _, v in fields(entry):
                if part == 1:
                    key = bytes(v).decode("utf-8", "replace")
                elif part == 2:
                    value = v
            if key is not None and value is not None and (wanted is None or key in wanted):
                out[key] = values(value)
                if wanted is not None and len(out) == len(wanted):
                    return out
    return out


def as_row(got: dict[str, list], names: list[str], scalar: dict[str, bool], text: dict[str, bool]) -> tuple:
    row = []
    for name in names:
        value = got.get(name)
        if value is not None and text[name]:
            value = [v.decode("utf-8", "replace") for v in value]
        row.append((value[0] if value else None) if scalar[name] and value is not None else value)
    return tuple(row)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class TFRecordReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        files = sorted(p for p in (glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
        if not files:
            raise FileNotFoundError(path)
        return [_File(p) for p in files]

    def read(self, partition: _File) -> Iterator[tuple]:
        names = [x for x in (self.options.get("features") or "").split(",") if x] or self.schema.fieldNames()
        wanted = set(names)
        scalar = {f.name: not isinstance(f.dataType, ArrayType) for f in self.schema.fields}
        text = {f.name: isinstance(f.dataType if scalar[f.name] else f.dataType.elementType, StringType) for f in self.schema.fields}
        zipped = {"gzip": True, "none": False}.get(self.options.get("compression", "").lower())
        for frame in frames(partition.path, zipped=zipped):
            yield as_row(example(frame, wanted), self.schema.fieldNames(), scalar, text)


class TFRecordSource(DataSource):
    """Needs a schema; types: arrays or scalars of binary, string, bigint, int, float, double."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> StructType:
        raise ValueError("give the features' types with .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        for f in schema.fields:
            kind = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
            if not isinstance(kind, (BinaryType, StringType, LongType, IntegerType, FloatType, DoubleType)):
                raise ValueError(f"{f.name}: {f.dataType.simpleString()} is no feature type")
        return TFRecordReader(schema, dict(self.options))


def encode(features: dict[str, list]) -> bytes:
    """An Example's bytes, for small files and tests."""

    def number(v: int) -> bytes:
        v &= (1 << 64) - 1
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    def field(no: int, body: bytes) -> bytes:
        return number(no << 3 | 2) + number(len(body)) + body

    entries = b""
    for key, items in features.items():
        if items and isinstance(items[0], (bytes, str)):
            feature = field(1, b"".join(field(1, x.encode() if isinstance(x, str) else x) for x in items))
        elif items and isinstance(items[0], float):
            feature = field(2, field(1, struct.pack(f"<{len(items)}f", *items)))
        else:
            feature = field(3, field(1, b"".join(map(number, items))))
        entries += field(1, field(1, key.encode()) + field(2, feature))
    return field(1, entries)


def write_file(path: str, records: list[dict[str, list]], zipped: bool = False) -> None:
    """Records with checksums of zero, which this reader doesn't verify."""
    with gzip.open(path, "wb") if zipped else open(path, "wb") as file:
        for r in records:
            body = encode(r)
            file.write(struct.pack("<Q", len(body)) + bytes(4) + body + bytes(4))


def read_shards(spark: SparkSession, path: str, schema: str, glob_filter: str = "*", compression: str | None = None) -> DataFrame:
    """Records of all files of a folder on any file system, with the columns of a schema, `shard` (the file's name) and `place` (from 0 within it).

    A file is read as a whole, so that shards should be some hundred MB at most (2 GB is the
    limit of a value); only the features of the schema are decoded.
    """
    types = StructType.fromDDL(schema)
    names = types.fieldNames()
    scalar = {f.name: not isinstance(f.dataType, ArrayType) for f in types.fields}
    text = {f.name: isinstance(f.dataType if scalar[f.name] else f.dataType.elementType, StringType) for f in types.fields}
    zipped = None if compression is None else compression == "gzip"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, content in zip(b.shard, b.content):
                rows: list[tuple] = []
                for place, frame in enumerate(frames(bytes(content), shard, zipped)):
                    rows.append((shard, place, *as_row(example(frame, set(names)), names, scalar, text)))
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=["shard", "place", *names], dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=["shard", "place", *names], dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob_filter).load(path).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    return files.mapInPandas(run, f"shard string, place bigint, {schema}")


def scan(spark: SparkSession, path: str, schema: str, splits: DataFrame | None = None, split: str | None = None, ids: DataFrame | None = None, key: str = "episode_id", **options) -> DataFrame:
    """Records with a key, of a split (splits: key, split) and of a table of ids, in any order; records without the key are left out."""
    rows = read_shards(spark, path, schema, **options).where(F.col(key).isNotNull())
    if splits is not None:
        rows = rows.join(splits, key, "left")
        rows = rows if split is None else rows.where(F.col("split") == split)
    return rows if ids is None else rows.join(ids.select(key).distinct(), key, "left_semi")


def lookup(spark: SparkSession, path: str, schema: str, wanted, key: str = "episode_id", **options) -> DataFrame:
    """The record of one key: the first by shard and place; KeyError if no shard has it."""
    found = read_shards(spark, path, schema, **options).where(F.col(key) == wanted).orderBy("shard", "place").limit(1)
    if found.isEmpty():
        raise KeyError(wanted)
    return found


def with_late(core: DataFrame, spark: SparkSession, path: str, key: str, heavy: str, **options) -> DataFrame:
    """core with heavy features (a schema), decoded only for the records that core still holds."""
    shards = core.select("shard", "place")
    late = read_shards(spark, path, heavy, **options).join(shards, ["shard", "place"], "left_semi")
    return core.join(late, ["shard", "place"])
