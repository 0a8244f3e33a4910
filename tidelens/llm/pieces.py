"""SentencePiece encoding and decoding by a table of distinct chunks (operator 1).

A BPE piece of the models handled here never holds a whitespace marker after another character, nor a line break beside
other characters.  Merges therefore stay inside a *chunk*: a run of markers with the characters up to the next marker or
line break.  The job is

1. split: every task cuts its texts into blocks, numbers the distinct chunks of a block and turns each text into the
   positions of its chunks in that list; lists and positions are made by one rule in two passes over the input, whose
   fingerprints must agree, so that neither has to be stored;
2. segment: the block lists meet by hash of the chunk, each distinct chunk is segmented once by the library;
3. join back: ids return to their block and replace the positions.

Hot words cost one entry per block, so no hash bucket is hot, and a block has a bounded number of characters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import BLOCK_CHARS, pack, ragged, text_blocks, unpack, width

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@lru_cache(maxsize=4)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def require_marked_pieces(model: str) -> None:
    """Refuse a model whose pieces cross markers or line breaks, or that rewrites text before it segments it."""
    sp = processor(model)
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if re.search(f"[^{MARK}]{MARK}", piece) or (len(piece) > 1 and "\n" in piece):
            raise ValueError(f"piece {i} crosses a boundary between chunks")
    probe = "\n  ﬁ½ 　A\t."
    if sp.decode(sp.encode(probe)) != probe or sp.encode("") != [] or len(sp.encode("\n")) != 2:
        raise ValueError("the model normalises text or adds no marker; chunks would not be exact")


def chunks(text: str) -> list[str]:
    """Chunks of the text as the model sees it: a marker first, markers for blanks.  An empty text has none."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(sp, words: Sequence[str]) -> list[list[int]]:
    """Ids of each chunk.  A line break in front keeps the library's own marker apart: its two ids are cut off again."""
    return [ids[2:] for ids in sp.encode(["\n" + w for w in words], num_threads=1)]


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = out = len(self)
        return out


def _numbered_blocks(batches: Iterator[pa.RecordBatch], block_chars: int):
    """(block, fingerprint of its chunk list, rows, chunk list, positions of every text's chunks in the list)."""
    for block, rows, texts in text_blocks(batches, "text", block_chars):
        table = _Numbered({"\n": 0})
        look = table.__getitem__
        places = [np.fromiter(map(look, parts), np.uint32, len(parts)) for parts in map(chunks, texts)]
        words = list(table)[1:]
        yield block, zlib.crc32("\n".join(words).encode()), rows, words, places


def _planes(values: np.ndarray) -> bytes:
    """Numbers packed byte plane by byte plane: the high planes are nearly constant and vanish."""
    return pack(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _positions(block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, mark, rows, _, places in _numbered_blocks(batches, block_chars):
            rows, n = rows.column("row").combine_chunks(), len(places)
            for i in range(0, n, 256):
                part = places[i : i + 256]
                yield pa.record_batch({"block": pa.array([block], pa.int64()), "mark": pa.array([mark], pa.int64()), "rows": pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), rows.slice(i, len(part))),
                                       "n": pa.array([[len(p) for p in part]], pa.list_(pa.int32())), "payload": pa.array([_planes(np.concatenate(part))], pa.binary())})

    return run


def _chunk_lists(buckets: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, mark, _, words, _ in _numbered_blocks(batches, block_chars):
            home = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
            out = {"bucket": [], "at": [], "payload": []}
            for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                mine = order[lo:hi]
                out["bucket"].append(int(home[mine[0]]))
                out["at"].append(_planes(np.diff(mine + 1, prepend=0)))
                out["payload"].append(zstandard.ZstdCompressor(level=3).compress("\n".join([words[i] for i in mine]).encode()))
            m = len(out["bucket"])
            if m:
                yield pa.record_batch({"block": pa.array([block] * m, pa.int64()), "mark": pa.array([mark] * m, pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()),
                                       "at": pa.array(out["at"], pa.binary()), "payload": pa.array(out["payload"], pa.binary())})

    return run


def _segment_bucket(model: str):
    def run(rows: pa.Table) -> pa.Table:
        lists = [zstandard.ZstdDecompressor().decompress(p.as_py()).decode().split("\n") for p in rows.column("payload")]
        table = _Numbered()
        look = table.__getitem__
        where = [np.fromiter(map(look, words), np.int64, len(words)) for words in lists]
        sp, known, ids = processor(model), list(table), []
        for i in range(0, len(known), 20_000):
            ids.extend(np.array(x, np.uint32) for x in segment(sp, known[i : i + 20_000]))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids)
        first = np.cumsum(size) - size
        return pa.table({"block": rows.column("block"), "mark": rows.column("mark"), "at": rows.column("at"),
                         "n": pa.array([_planes(size[w]) for w in where], pa.binary()),
                         "ids": pa.array([_planes(flat[ragged(first[w], size[w])]) for w in where], pa.binary())})

    return run


def _join_back(model: str):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if set(docs.column("mark").to_pylist()) | set(found.column("mark").to_pylist()) != {docs.column("mark")[0].as_py()}:
            raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
        parts = [np.array(processor(model).encode("\n")[1:], np.uint32)]
        at, n = [np.zeros(1, np.int64)], [np.ones(1, np.int64) * len(parts[0])]
        for row in found.select(["at", "n", "ids"]).to_pylist():
            at.append(np.cumsum(_from_planes(row["at"]), dtype=np.int64))
            n.append(_from_planes(row["n"]).astype(np.int64))
            parts.append(_from_planes(row["ids"]))
        at, n, flat = np.concatenate(at), np.concatenate(n), np.concatenate(parts).astype(np.int32)
        size, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        size[at], first[at] = n, np.cumsum(n) - n
        out = []
        for row, counts, payload in zip(docs.column("rows"), docs.column("n"), docs.column("payload")):
            place = _from_planes(payload.as_py())
            lengths = size[place]
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts.values.to_numpy())]).astype(np.int64)]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[ragged(first[place], lengths)], pa.int32()))
            out.append(pa.record_batch({"row": row.values, "ids": ids}))
        return pa.Table.from_batches(out)

    return run


def encode(docs: DataFrame, model: str, text: str = "text", keep: Sequence[str] = ("doc_id",), block_chars: int = 2 * BLOCK_CHARS) -> DataFrame:
    """Columns ``keep`` of every row with ``ids``: what the library's ``encode`` gives for the whole text.

    Null and empty texts have an empty array; repeated rows and null keys stay as they are; an empty table gives an empty
    one; other columns of ``docs``, whatever their names, are not read.  ``ids`` may not be among ``keep``.
    """
    require_marked_pieces(model)
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    words = rows.mapInArrow(_chunk_lists(width(spark), block_chars), "block long, mark long, bucket int, at binary, payload binary")
    found = words.groupBy("bucket").applyInArrow(_segment_bucket(model), "block long, mark long, at binary, n binary, ids binary")
    texts = rows.mapInArrow(_positions(block_chars), f"block long, mark long, rows array<{kind}>, n array<int>, payload binary")
    out = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_join_back(model), f"row {kind}, ids array<int>")
    return out.select("row.*", "ids")


def decode(frame: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` with the library's ``decode`` of each id array; null ids give null."""

    @F.pandas_udf("string")
    def texts(arrays):
        sp = processor(model)
        return arrays.map(lambda a: None if a is None else sp.decode(a.tolist()))

    return frame.withColumn(out, texts(F.col(f"`{ids}`")))
