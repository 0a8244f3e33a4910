"""Helpers shared by the operators: tables in the shared folder, text blocks, packing of arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: Characters of text that one task holds at a time in operators that work on blocks of documents.
BLOCK_CHARS = 4_000_000


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which the driver and every executor can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    It cuts lineage, survives lost executors and, unlike ``checkpoint()``, lets each reader take the columns it needs.
    """
    path = shared_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Number of hash buckets that packed tables are dealt to: that of shuffle partitions, which grows with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def block_base() -> int:
    """First block number of this task; a task may use 2**31 of them."""
    return TaskContext.get().partitionId() << 31


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_CHARS) -> Iterator[tuple[int, pa.Table, list[str]]]:
    """(block number, rows, texts) of consecutive rows with about ``most`` characters; one longer text is a block of its own.

    A null text counts as empty.
    """
    number, held, texts, chars = block_base(), [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch, start = whole.slice(at, 256), 0
            values = batch.column(column).to_pylist()
            for i, value in enumerate(values):
                value = value or ""
                if texts and chars + len(value) > most:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield number, pa.Table.from_batches(held), texts
                    number, held, texts, chars, start = number + 1, [], [], 0, i
                texts.append(value)
                chars += len(value)
            if len(values) > start:
                held.append(batch.slice(start))
    if texts:
        yield number, pa.Table.from_batches(held), texts


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit values (shift, multiply), in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of every run, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Forest:
    """Union of linked places; edges are added in bulk, only new ones cost a step."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def sha_of(column) -> F.Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)
