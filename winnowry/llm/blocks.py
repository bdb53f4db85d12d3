"""Bags of terms shuffled in packed form.

A map task turns a block of documents (bounded by text size) into one row per
hash bucket: the block's distinct terms of that bucket, each once, with the
documents and counts they occur in.  All uses of a term meet in one bucket, so
per-term work is done once, yet neither texts nor (document, term) rows are
shuffled one by one.  A bucket answers each block with one vector over its
documents; the vectors of a block are added up at its end.

Blocks are named by partition and order, so the input must come in the same
order when a task is run again: a scan or a sorted frame, not a bare shuffle.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

BLOCK_BYTES = 6 << 20
BLOCK_DOCS = 60_000
ZSTD = pa.Codec("zstd", compression_level=1)
PACKED = "bucket int, block string, kind int, payload binary"


def pack(x) -> bytes:
    raw = pickle.dumps(x, protocol=5)
    return len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def unpack(x: bytes):
    return pickle.loads(ZSTD.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True))


def compact(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the smallest type that holds them."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def planes(x: np.ndarray) -> tuple[int, bytes]:
    """Numbers from 0 on byte by byte, all low bytes first: small numbers then pack well."""
    x = compact(x)
    return x.dtype.itemsize, x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unplanes(x: tuple[int, bytes]) -> np.ndarray:
    size, raw = x
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(f"<u{size}").ravel()


def release() -> None:
    """Hand freed memory back to the system, so that workers kept for later tasks stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[str, list[dict], list[str]]]:
    """Documents in blocks of bounded text: (name, other columns, texts)."""
    part, n = TaskContext.get().partitionId(), 0
    rows: list[dict] = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for at in range(0, batch.num_rows, 256):
            some = rest.slice(at, 256).to_pylist() if rest.num_columns else [{}] * min(256, batch.num_rows - at)
            for row, text in zip(some, batch.column("text").slice(at, 256).to_pylist(), strict=True):
                rows.append(row)
                texts.append(text or "")
                held += len(texts[-1]) + 100
                if held >= size or len(texts) >= BLOCK_DOCS:
                    yield f"{part}-{n}", rows, texts
                    rows, texts, held, n = [], [], 0, n + 1
    if texts:
        yield f"{part}-{n}", rows, texts


class Numbers(dict):
    """Numbers terms in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def packed(block: str, tokens: list[list], meta: dict, n_buckets: int) -> Iterator[tuple]:
    """The rows of one block: its bags by bucket, and one row with ``meta``.

    ``tokens`` has bytes or str terms; bags hold (terms, starts, docs, counts).
    """
    ids = Numbers()
    flat = [np.fromiter(map(ids.__getitem__, t), np.int64, len(t)) for t in tokens]
    doc = np.repeat(np.arange(len(flat), dtype=np.int64), [len(x) for x in flat])
    n = max(1, len(tokens))
    pair, count = np.unique((np.concatenate(flat) if flat else np.zeros(0, np.int64)) * n + doc, return_counts=True)
    term, doc = pair // n, (pair % n).astype(np.uint16)
    terms = list(ids)
    bucket = np.fromiter((zlib.crc32(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")) % n_buckets for t in terms), np.int64, len(terms))
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else []
    small = count.max(initial=0) < 256
    for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True) if len(order) else ():
        own = order[a:z]
        sizes = (starts[own + 1] - starts[own]).astype(np.uint16 if n < 65_000 else np.int64)
        n_own = starts[own + 1] - starts[own]
        rows = np.repeat(starts[own] - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())
        yield int(bucket[own[0]]), block, 0, pack(([terms[k] for k in own], sizes, doc[rows], count[rows].astype(np.uint8 if small else np.int32), n))
    yield zlib.crc32(block.encode()) % n_buckets, block, 1, pack(meta)


def packed_batches(rows: Iterable[tuple], size: int = 512) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("payload", pa.binary())])
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def spread(value: Callable[[list], np.ndarray], payload: bytes) -> np.ndarray:
    """Per document of the block: the sum of count x value(term) over a bag."""
    terms, sizes, docs, counts, n = unpack(payload)
    weights = np.repeat(value(terms), sizes)
    return np.bincount(docs, weights=weights * counts, minlength=n)
