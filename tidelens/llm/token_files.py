"""Token ids in Arrow stream files of equal-length sequences (operator 5).

Documents are dealt to range partitions by id and sorted inside them; each task encodes its share and writes one file.
A file is an Arrow IPC stream whose batches hold ``tokens`` and ``mask`` as fixed-size lists, so sequence *k* lies at a
known place of the memory-mapped file and is read without a copy.  The last sequence of a file is padded, mask 0.  An index
table keeps the file, first token and length of every document; numbers over all files come from the files' totals.

Text is cut where a blank follows another character and where a sign follows a letter, borders that the pre-tokenizer never
crosses; a bounded table per worker keeps the ids of chunks seen before.  The tokenizers library encodes the rest: its model alone where a
chunk is a word, all of it otherwise.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .common import shared_folder, staged, text_blocks

#: White space as the pre-tokenizer's pattern understands it (fixed values).
BLANKS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word of plain letters that ends before an ASCII sign or blank is a pre-token by itself; anything else runs to the next blank.
CHUNK = re.compile(f"[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ -/:-@\\[-`{{-~\\n]|\\Z)|[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
#: A chunk that is one pre-token, which the model can be given without the library's search for special tokens and borders.
WORD = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Signs that stand for bytes in the model's alphabet (fixed values): printable ones for themselves, the others from 256 on.
PRINTED = (*range(33, 127), *range(161, 173), *range(174, 256))
SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Entries of a worker's table of known chunks before it becomes the older one.
KNOWN = 400_000
#: Characters of text whose ids are held at a time.
HELD = 1_000_000


class Chunks(dict):
    """Ids of chunks as bytes; an unknown chunk is taken from the older table or encoded."""

    def __init__(self, library: Tokenizer, size: int, older: dict[str, bytes]):
        super().__init__()
        self.library, self.model, self.size, self.older = library, library.model, size, older

    def __missing__(self, chunk: str) -> bytes:
        data = self.older.get(chunk)
        if data is None:
            if WORD.fullmatch(chunk):
                ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(SIGNS))]
            else:
                ids = self.library.encode(chunk, add_special_tokens=False).ids
            data = b"".join([i.to_bytes(self.size, "little") for i in ids])
        self[chunk] = data
        return data


class Encoder:
    """The library's ids, as bytes of ``dtype``, with a bounded table of chunks in two generations.

    When the younger table is full it becomes the older one, so chunks in use move on and the others go.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Chunks(self.library, self.dtype.itemsize, {})

    def __call__(self, text: str) -> bytes:
        if len(self.known) > KNOWN:
            older, self.known.older = self.known, {}
            self.known = Chunks(self.library, self.dtype.itemsize, older)
        return b"".join(map(self.known.__getitem__, CHUNK.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class SequenceWriter:
    """Writes a stream of ids as batches of ``batch`` sequences of ``length`` ids; memory is one batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.dtype, self.length, self.most = pa.ipc.new_stream(sink, self.schema), dtype, length, batch * length
        self.held, self.n, self.total = [], 0, 0

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.n += len(data) // self.dtype.itemsize
        if self.n >= self.most:
            self._flush(self.n // self.most * self.most)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        for i in range(0, n, self.most):
            part = ids[i : min(i + self.most, n)]
            size = -(-len(part) // self.length) * self.length
            tokens, mask = np.zeros(size, self.dtype), np.arange(size) < len(part)
            tokens[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (tokens, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.total += n
        self.held, self.n = [ids[n:].tobytes()], self.n - n

    def close(self) -> None:
        if self.n:
            self._flush(self.n)
        self.out.close()


class SequenceFile:
    """Zero-copy random access to a file written above."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.tokens = [b.column(0).flatten().to_numpy(zero_copy_only=True) for b in self.batches]
        self.masks = [b.column(1).flatten() for b in self.batches]
        self.length = self.batches[0].schema.field(0).type.list_size if self.batches else 1
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Views of the tokens and the mask (one bit each) of sequence ``k``."""
        batch, row = divmod(k, self.rows)
        cut = slice(row * self.length, (row + 1) * self.length)
        return self.tokens[batch][cut], self.masks[batch][cut]

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file; a view if they lie in one batch."""
        size, parts = self.rows * self.length, []
        while n > 0:
            batch, at = divmod(start, size)
            part = self.tokens[batch][at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _write(folder: str, path: str, end: int, length: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, fs_root = encoder(path), filesystem(folder)
        fs, root = fs_root
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}.arrows"
        ends = np.array([end], code.dtype).tobytes()
        writer = sink = None
        at = 0
        temporary = f"{name}.{uuid.uuid4().hex}"
        for _, rows, texts in text_blocks(batches, "text", HELD):
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(temporary)
                writer = SequenceWriter(sink, code.dtype, length, batch)
            starts, sizes = [], []
            for data in map(code, texts):
                writer.add(data + ends)
                starts.append(at)
                sizes.append(len(data) // code.dtype.itemsize + 1)
                at += sizes[-1]
            n = rows.num_rows
            yield pa.record_batch({"file": pa.array([part] * n, pa.int32()), "row": rows.column("row").combine_chunks(), "first": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(temporary, name)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 0, text: str = "text", key: str = "doc_id", length: int = 2048, batch: int = 64) -> tuple[str, DataFrame]:
    """(folder, index): files of all ids in ascending order of ``key``, ``end`` after each document, and the index table.

    The index has file, key, first (in its file), start (over all files) and n_tokens.  Null texts count as empty, null keys
    come first, rows with equal keys stand side by side in order of their text's hash, an empty table writes no file; other
    columns are not read.  A retried task writes its file anew under its final name.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    rows = docs.select(F.struct(F.col(f"`{key}`").alias("key")).alias("row"), F.col(f"`{text}`").alias("text"))
    order = [F.col("row.key").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["row"].dataType.simpleString()
    index = staged(dealt.mapInArrow(_write(folder, tokenizer, end, length, batch), f"file int, row {kind}, first long, n_tokens long"), "token-index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return folder, index.join(before, "file").select("file", F.col("row.key").alias(key), "first", (F.col("before") + F.col("first")).alias("start"), "n_tokens")


def _read(folder: str):
    def run(rows: pa.Table) -> pa.Table:
        file = SequenceFile(f"{folder}/part-{rows.column('file')[0].as_py():06d}.arrows")
        spans = zip(rows.column("first").to_pylist(), rows.column("n_tokens").to_pylist())
        crc = [zlib.crc32(file.ids(first, n).astype("<u4").tobytes()) for first, n in spans]
        return rows.drop_columns(["first"]).append_column("ids_crc32", pa.array(crc, pa.int64()))

    return run


def read_crc(folder: str, index: DataFrame) -> DataFrame:
    """The index with ``ids_crc32`` of each document's ids as read back from its file."""
    kept = [c for c in index.schema if c.name != "first"]
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in kept) + ", ids_crc32 long"
    return index.groupBy("file").applyInArrow(_read(folder), schema)
