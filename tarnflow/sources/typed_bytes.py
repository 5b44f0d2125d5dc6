"""Typed bytes: a self-describing binary stream of nested values.

A value is a type code and its content, numbers big-endian; vectors have a count,
lists end with a marker. Files of concatenated (key, value) pairs are read whole
(they are not splittable) and decoded in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Type codes of the format.
BYTES, BYTE, BOOL, INT, LONG, FLOAT, DOUBLE, STRING, VECTOR, LIST, MAP, MARKER = 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 255

NUMBERS = {BYTE: ">b", BOOL: ">?", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}


def encode(value) -> bytes:
    """A Python value; tuples are vectors, ints are int or long by size."""
    if isinstance(value, bool):
        return bytes([BOOL]) + struct.pack(">?", value)
    if isinstance(value, int):
        small = -(1 << 31) <= value < 1 << 31
        return bytes([INT if small else LONG]) + struct.pack(">i" if small else ">q", value)
    if isinstance(value, float):
        return bytes([DOUBLE]) + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode("utf-8")
        return bytes([STRING]) + struct.pack(">i", len(raw)) + raw
    if isinstance(value, (bytes, bytearray)):
        return bytes([BYTES]) + struct.pack(">i", len(value)) + bytes(value)
    if isinstance(value, tuple):
        return bytes([VECTOR]) + struct.pack(">i", len(value)) + b"".join(map(encode, value))
    if isinstance(value, list):
        return bytes([LIST]) + b"".join(map(encode, value)) + bytes([MARKER])
    if isinstance(value, dict):
        return bytes([MAP]) + struct.pack(">i", len(value)) + b"".join(encode(x) for pair in value.items() for x in pair)
    raise TypeError(f"no typed bytes for {type(value).__name__}")


def decode(stream: BytesIO):
    """The next value; EOFError at the end of the stream."""
    code = stream.read(1)
    if not code:
        raise EOFError
    return _content(code[0], stream)


def _number(kind: str, stream: BytesIO):
    return struct.unpack(kind, stream.read(struct.calcsize(kind)))[0]


def _content(code: int, stream: BytesIO):
    if code in NUMBERS:
        return _number(NUMBERS[code], stream)
    if code == LIST:
        found = []
        while (code := stream.read(1)[0]) != MARKER:
            found.append(_content(code, stream))
        return found
    size = _number(">i", stream)
    if code == STRING:
        return stream.read(size).decode("utf-8")
    if code == VECTOR:
        return tuple(decode(stream) for _ in range(size))
    if code == MAP:
        return {decode(stream): decode(stream) for _ in range(size)}
    if code == BYTES or 50 <= code <= 200:  # codes of applications hold plain bytes
        return stream.read(size)
    raise ValueError(f"unknown type code {code}")


def pairs(raw: bytes) -> Iterator[tuple]:
    """The (key, value) pairs of a file's bytes."""
    stream = BytesIO(raw)
    while True:
        try:
            key = decode(stream)
        except EOFError:
            return
        yield key, decode(stream)


def decode_pairs(df: DataFrame, schema: str) -> DataFrame:
    """The pairs in each row of a binary column, as ``schema`` (two columns)."""
    from tarnflow.sources.arrow import arrow_schema

    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pair for raw in batch.column(0).to_pylist() for pair in pairs(raw)]
            if rows:
                columns = [pa.array([list(x) if isinstance(x, tuple) else x for x in c], type=f.type) for c, f in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return df.mapInArrow(run, schema)


def read_typed_bytes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The pairs of every file under ``path``, as ``schema`` (two columns)."""
    return decode_pairs(spark.read.format("binaryFile").load(path).select("content"), schema)


def encode_pairs(df: DataFrame) -> DataFrame:
    """``content``: each row's two columns as one binary value, for a binary sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([encode(k) + encode(v) for k, v in rows], type=pa.binary())], names=["content"])

    return df.mapInArrow(run, "content binary")
