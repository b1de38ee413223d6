"""Avro object container files, where Spark's own Avro connector isn't on the class path.

A file is one task's work, read whole through Spark's binary reader, so it may be in any store that Spark reaches; for very large files use the
connector, which splits them.
"""

from __future__ import annotations

import bz2
import datetime
import decimal
import json
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of the format.
MAGIC, SYNC = b"Obj\x01", 16
#: Bytes of a file's beginning in which its schema has to be.
HEAD = 1 << 20
#: Rows of a batch.
BATCH = 10_000

PLAIN = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        """A number in zigzag form, seven bits a byte."""
        value = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value >> 1 ^ -(value & 1)

    def sized(self) -> bytes:
        return self.take(self.long())

    def blocks(self) -> Iterator[int]:
        """The numbers of items in the blocks of an array or a map."""
        while n := self.long():
            if n < 0:  # followed by the block's size
                n = -n
                self.long()
            yield n


def _named(schema, names: dict):
    """A schema with names looked up; definitions are remembered."""
    if isinstance(schema, str) and schema in names:
        return names[schema]
    if isinstance(schema, dict) and "name" in schema and schema["type"] in ("record", "enum", "fixed"):
        names[schema["name"]] = names[f"{schema.get('namespace', '')}.{schema['name']}".strip(".")] = schema
    return schema


def spark_type(schema, names: dict | None = None) -> T.DataType:
    names = {} if names is None else names
    schema = _named(schema, names)
    if isinstance(schema, list):
        some = [s for s in schema if s != "null"]
        kinds = {s if isinstance(s, str) else s["type"] for s in some}
        if len(some) == 1:
            return spark_type(some[0], names)
        if kinds <= {"int", "long"}:
            return T.LongType()
        if kinds <= {"int", "long", "float", "double"}:
            return T.DoubleType()
        raise ValueError(f"a union of {kinds} has no column type")
    if isinstance(schema, str):
        return PLAIN[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if logical == "date":
        return T.DateType()
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"], names)) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"], names))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"], names))
    return T.StringType() if kind == "enum" else T.BinaryType() if kind == "fixed" else spark_type(kind, names)


def decoder(schema, names: dict | None = None) -> Callable[[Cursor], object]:
    """A function that reads a value of the schema."""
    names = {} if names is None else names
    schema = _named(schema, names)
    if isinstance(schema, list):
        options = [decoder(s, names) for s in schema]
        return lambda c: options[c.long()](c)
    kind = schema if isinstance(schema, str) else schema["type"]
    logical = None if isinstance(schema, str) else schema.get("logicalType")
    plain: dict[str, Callable[[Cursor], object]] = {
        "null": lambda c: None, "boolean": lambda c: c.take(1) == b"\x01", "int": Cursor.long, "long": Cursor.long, "bytes": Cursor.sized, "string": lambda c: c.sized().decode(),
        "float": lambda c: struct.unpack("<f", c.take(4))[0], "double": lambda c: struct.unpack("<d", c.take(8))[0],
    }
    if kind == "record":
        fields = [(f["name"], decoder(f["type"], names)) for f in schema["fields"]]
        return lambda c: {name: read(c) for name, read in fields}
    if kind == "array":
        item = decoder(schema["items"], names)
        return lambda c: [item(c) for n in c.blocks() for _ in range(n)]
    if kind == "map":
        value = decoder(schema["values"], names)
        return lambda c: [(c.sized().decode(), value(c)) for n in c.blocks() for _ in range(n)]
    if kind == "enum":
        return lambda c: schema["symbols"][c.long()]
    read = (lambda c: c.take(schema["size"])) if kind == "fixed" else plain[kind] if kind in plain else decoder(kind, names)
    if logical == "date":
        return lambda c: EPOCH.date() + datetime.timedelta(days=read(c))
    if logical in ("timestamp-millis", "timestamp-micros"):
        step = 1000 if logical == "timestamp-millis" else 1
        return lambda c: EPOCH + datetime.timedelta(microseconds=read(c) * step)
    if logical == "decimal":
        scale = schema.get("scale", 0)
        return lambda c: decimal.Decimal(int.from_bytes(read(c), "big", signed=True)).scaleb(-scale)
    return read


def header(data: bytes) -> tuple[dict, str, int]:
    """(schema, codec, where the blocks begin) of a file."""
    if data[:4] != MAGIC:
        raise ValueError("no Avro container file")
    c = Cursor(data, 4)
    about = {}
    for n in c.blocks():
        for _ in range(n):
            key = c.sized().decode()
            about[key] = c.sized()
    return json.loads(about["avro.schema"]), about.get("avro.codec", b"null").decode(), c.at + SYNC


def _unpacked(block: bytes, codec: str) -> bytes:
    if codec == "null":
        return block
    if codec == "deflate":
        return zlib.decompress(block, -15)
    if codec == "bzip2":
        return bz2.decompress(block)
    if codec == "xz":
        return lzma.decompress(block)
    if codec == "snappy":  # its length comes first, seven bits a byte; a checksum last
        size = shift = 0
        for b in block:
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        return pa.decompress(block[:-4], size, "snappy").to_pybytes()
    if codec == "zstandard":
        return pa.CompressedInputStream(pa.BufferReader(block), "zstd").read()
    raise ValueError(f"unknown codec {codec}")


def records(data: bytes) -> Iterator[object]:
    """The values of a container file."""
    schema, codec, at = header(data)
    read, c = decoder(schema), Cursor(data, at)
    while c.at < len(data):
        n, size = c.long(), c.long()
        block = Cursor(_unpacked(c.take(size), codec))
        for _ in range(n):
            yield read(block)
        c.take(SYNC)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """The records of files whose schema is the first file's."""
    files = spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").limit(1).select(F.substring("content", 1, HEAD).alias("head")).collect()
    schema = spark_type(header(bytes(first[0].head))[0])
    if not isinstance(schema, T.StructType):
        raise ValueError("the schema is no record")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held = []
                for r in records(content.as_py()):
                    held.append(r)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return files.select("content").mapInArrow(run, schema)


def _zigzag(n: int) -> bytes:
    n, out = n << 1 ^ n >> 63, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(value, schema) -> bytes:
    """A value of a schema of plain types, records, arrays, maps and unions with null."""
    if isinstance(schema, list):
        at = next(k for k, s in enumerate(schema) if (s == "null") == (value is None))
        return _zigzag(at) + encode(value, schema[at])
    kind = schema if isinstance(schema, str) else schema["type"]
    if kind == "record":
        return b"".join(encode(value[f["name"]], f["type"]) for f in schema["fields"])
    if kind in ("array", "map"):
        items = list(value.items()) if kind == "map" else value
        body = b"".join(encode(k, "string") + encode(v, schema["values"]) for k, v in items) if kind == "map" else b"".join(encode(v, schema["items"]) for v in items)
        return (_zigzag(len(items)) + body if items else b"") + b"\0"
    if kind in ("string", "bytes"):
        data = value.encode() if kind == "string" else value
        return _zigzag(len(data)) + data
    if kind in ("int", "long"):
        return _zigzag(value)
    return {"null": lambda: b"", "boolean": lambda: bytes([value]), "float": lambda: struct.pack("<f", value), "double": lambda: struct.pack("<d", value)}[kind]()


def container(rows: list[dict], schema: dict, codec: str = "deflate", block: int = 1000) -> bytes:
    """A container file of few rows (codec: null or deflate)."""
    sync = b"millrace-sync-16"
    out = [MAGIC, _zigzag(2), encode("avro.schema", "string"), encode(json.dumps(schema), "string"), encode("avro.codec", "string"), encode(codec, "string"), b"\0", sync]
    for a in range(0, len(rows), block):
        body = b"".join(encode(r, schema) for r in rows[a : a + block])
        if codec == "deflate":
            body = zlib.compress(body)[2:-4]
        out += [_zigzag(len(rows[a : a + block])), _zigzag(len(body)), body, sync]
    return b"".join(out)
