"""Key-value stores in the public LevelDB format, and values as browsers serialise them.

A store is a folder of logs and tables. Each file becomes rows (key, sequence, gone, value); the last write of a key by sequence holds. Files are read by Spark as bytes, one to a
row, so a store of many files spreads over tasks; a file is at most a few megabytes in this format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentis.session import ship
from momentis.sources.tables import last_writes

BLOCK = 32768
MAGIC = 0xDB4775248B80FB57


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def unsnapped(data: bytes) -> bytes:
    """Decompress a block in the Snappy format."""
    size, at = varint(data, 0)
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        kind = tag & 3
        if kind == 0:
            n = tag >> 2
            if n >= 60:
                extra = n - 59
                n = int.from_bytes(data[at : at + extra], "little")
                at += extra
            out += data[at : at + n + 1]
            at += n + 1
            continue
        if kind == 1:
            n, back = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | data[at]
            at += 1
        else:
            width = 2 if kind == 2 else 4
            n, back = (tag >> 2) + 1, int.from_bytes(data[at : at + width], "little")
            at += width
        if not 0 < back <= len(out):
            raise ValueError("a copy reaches before the start")
        for _ in range(n):
            out.append(out[-back])
    if len(out) != size:
        raise ValueError("the block has another size than it says")
    return bytes(out)


def log_records(data: bytes) -> Iterator[bytes]:
    """Records of a log; a torn one at its end is left out."""
    parts: list[bytes] = []
    for start in range(0, len(data), BLOCK):
        block, at = data[start : start + BLOCK], 0
        while at + 7 <= len(block):
            n, kind = struct.unpack_from("<HB", block, at + 4)
            body = block[at + 7 : at + 7 + n]
            if kind == 0 or len(body) < n:
                break
            at += 7 + n
            if kind in (1, 2):
                parts = []
            parts.append(body)
            if kind in (1, 4):
                yield b"".join(parts)
                parts = []


def log_writes(data: bytes) -> Iterator[tuple[bytes, int, bool, bytes | None]]:
    for record in log_records(data):
        if len(record) < 12:
            continue
        sequence, count = struct.unpack_from("<QI", record)
        at = 12
        for k in range(count):
            kind = record[at]
            n, at = varint(record, at + 1)
            key, at = record[at : at + n], at + n
            value = None
            if kind == 1:
                n, at = varint(record, at)
                value, at = record[at : at + n], at + n
            yield key, sequence + k, kind == 0, value


def table_entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries of a block, whose keys share the start of the one before."""
    restarts = struct.unpack_from("<I", block, len(block) - 4)[0]
    end, at, key = len(block) - 4 - 4 * restarts, 0, b""
    while at < end:
        shared, at = varint(block, at)
        fresh, at = varint(block, at)
        n, at = varint(block, at)
        key = key[:shared] + block[at : at + fresh]
        at += fresh
        yield key, block[at : at + n]
        at += n


def table_writes(data: bytes) -> Iterator[tuple[bytes, int, bool, bytes | None]]:
    if len(data) < 48 or struct.unpack_from("<Q", data, len(data) - 8)[0] != MAGIC:
        raise ValueError("no table of this format")

    def block(at: int, n: int) -> bytes:
        body = data[at : at + n]
        return unsnapped(body) if data[at + n] == 1 else body

    at = len(data) - 48
    for _ in range(2):
        _, at = varint(data, at)
    offset, at = varint(data, at)
    size, _ = varint(data, at)
    for _, handle in table_entries(block(offset, size)):
        a, k = varint(handle, 0)
        n, _ = varint(handle, k)
        for key, value in table_entries(block(a, n)):
            trailer = struct.unpack_from("<Q", key, len(key) - 8)[0]
            yield key[:-8], trailer >> 8, trailer & 0xFF == 0, None if trailer & 0xFF == 0 else value


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a store's folder: the last write of each key, without those that were deleted."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content").where(F.col("path").rlike(r"\.(log|ldb|sst)$"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame.path, frame.content, strict=True):
                yield pd.DataFrame(list((log_writes if name.endswith(".log") else table_writes)(bytes(data))), columns=["key", "sequence", "gone", "value"])

    return last_writes(files.mapInPandas(run, "key binary, sequence long, gone boolean, value binary"), ["key"], "sequence", "gone").select("key", "value")


class Serialised:
    """A value in the structured-clone format of a browser's engine: objects, arrays, texts, numbers, dates and references."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.objects: list = []
        while self.at < len(data) and data[self.at] == 0xFF:
            _, self.at = varint(data, self.at + 1)

    def number(self) -> int:
        value, self.at = varint(self.data, self.at)
        return value

    def double(self) -> float:
        self.at += 8
        return struct.unpack_from("<d", self.data, self.at - 8)[0]

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def tag(self) -> str:
        while self.data[self.at] == 0:  # padding before two-byte texts
            self.at += 1
        self.at += 1
        return chr(self.data[self.at - 1])

    def value(self):
        tag = self.tag()
        plain = {"_": None, "0": None, "-": None, "T": True, "F": False, "y": True, "x": False}
        if tag in plain:
            return plain[tag]
        if tag == "I":
            n = self.number()
            return n >> 1 ^ -(n & 1)
        if tag == "U":
            return self.number()
        if tag in "Nn":
            return self.remember(self.double()) if tag == "n" else self.double()
        if tag == "D":
            return self.remember(self.double())
        if tag == '"':
            return self.take(self.number()).decode("latin-1")
        if tag == "c":
            return self.take(self.number()).decode("utf-16-le")
        if tag == "S":
            return self.take(self.number()).decode("utf-8")
        if tag == "s":
            return self.remember(self.value())
        if tag == "^":
            return self.objects[self.number()]
        if tag == "o":
            return self.members(self.remember({}), "{")
        if tag == "a":
            size = self.number()
            own = self.members(self.remember({}), "@")
            self.number()
            return [own.get(k, own.get(str(k))) for k in range(size)]
        if tag == "A":
            place = len(self.objects)
            self.objects.append(None)
            out = self.objects[place] = []
            for _ in range(self.number()):
                if self.data[self.at] == ord("-"):
                    self.at += 1
                    out.append(None)
                else:
                    out.append(self.value())
            self.members({}, "$")
            self.number()
            return out
        if tag in ";'":
            close = ":" if tag == ";" else ","
            out = self.remember([])
            while self.data[self.at] != ord(close):
                out.append(self.value())
            self.at += 1
            self.number()
            return dict(zip(map(str, out[::2]), out[1::2], strict=True)) if tag == ";" else out
        raise ValueError(f"a value of the unknown kind {tag!r}")

    def remember(self, value):
        self.objects.append(value)
        return value

    def members(self, own: dict, close: str) -> dict:
        while self.data[self.at] != ord(close):
            key = self.value()
            own[key] = self.value()
        self.at += 1
        self.number()
        return own


def holding(value, name: str) -> Iterator[dict]:
    """Objects within a value, itself included, that have a member of the name."""
    if isinstance(value, dict):
        if name in value:
            yield value
        for x in value.values():
            yield from holding(x, name)
    elif isinstance(value, list):
        for x in value:
            yield from holding(x, name)
