"""Documents in durable chunks, and exchanges of packed, sorted keys between chunks and hash ranges.

A row per window or n-gram would multiply the input. So documents are kept in chunks of bounded bytes; a chunk
sends each distinct key once, as sorted arrays per range of keys; a range merges those runs and
replies to each chunk in the order of what it sent. A key of a third of all rows is one entry per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Symbols whose rolling values are computed at once.
SEGMENT = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
NO_ID = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, each with its own type."""
    parts = [f"{a.dtype.str}{len(a)}".encode() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b",".join(parts) + b"\n" + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def planes(a: np.ndarray) -> np.ndarray:
    """An array's bytes by significance, which compresses numbers far below their type's range; numbers() undoes it."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.ravel()


def numbers(data: np.ndarray, kind=np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(width, -1).T).view(kind).ravel()


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at = raw.index(b"\n")
    out, pos = [], at + 1
    for part in raw[:at].decode().split(","):
        kind, n = np.dtype(part[:3]), int(part[3:])
        out.append(np.frombuffer(raw, kind, n, pos))
        pos += n * kind.itemsize
    return out


def gathered(batches, chunk_bytes: int):
    """(number, ids, texts) of a partition's rows (id, text), dealt to chunks of at most chunk_bytes or one longer text."""
    part, number = TaskContext.get().partitionId() << 32, 0
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and (held + len(text or b"") > chunk_bytes or len(texts) >= 65_536):
                yield part + number, ids, texts
                number += 1
                ids, texts, held = [], [], 0
            ids.append(NO_ID if doc is None else doc)
            texts.append(text or b"")
            held += len(texts[-1])
    if texts:
        yield part + number, ids, texts


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, first: int = 0, form=None) -> DataFrame:
    """(chunk, data): all documents in the shared folder, compressed, numbered from `first`. Null texts are empty; a null id is kept as NO_ID.

    form: what is kept of a text's bytes, if not all of them.
    """

    def run(batches):
        for number, ids, texts in gathered(batches, chunk_bytes):
            texts = texts if form is None else list(map(form, texts))
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            data = pack(np.array(ids, np.int64), lengths, np.frombuffer(b"".join(texts), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([data])], ["chunk", "data"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return stored(rows.mapInArrow(run, "chunk long, data binary"), "chunks")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of equal width over 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for the ranges that sorted keys fall into."""
    own = bucket_of(sorted_keys, buckets)
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    return [(int(own[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(own)])]


def with_replies(chunks: DataFrame, replies: DataFrame, *names: str) -> DataFrame:
    """chunks with the list of each reply column; a chunk's replies are bounded by what it sent."""
    listed = replies.groupBy("chunk").agg(F.collect_list(F.struct(*names)).alias("replies"))
    return chunks.join(listed, "chunk", "left").select("chunk", "data", *[F.col(f"replies.{n}").alias(n) for n in names])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if SEGMENT not in _POWERS or len(_POWERS[SEGMENT][0]) < n:
        up, down = np.full(max(n, 1), _BASE, np.uint64), np.full(max(n, 1), pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[SEGMENT] = np.cumprod(up), np.cumprod(down)
    return _POWERS[SEGMENT]


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit value of each k consecutive symbols (random 64-bit numbers), from differences of one running sum."""
    out = np.empty(max(0, len(symbols) - k + 1), np.uint64)
    for a in range(0, len(out), SEGMENT):
        b = min(len(out), a + SEGMENT)
        up, down = _powers(SEGMENT + k if len(out) > SEGMENT else max(len(symbols), 1))
        n = b - a + k - 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols[a : a + n] * down[:n], out=total[1:])
        out[a:b] = mix64((total[k:] - total[:-k]) * up[: b - a])
    return out


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values, from running minima within blocks of that width."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(symbols: np.ndarray, lengths: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, its value) of the runs of windows that share an anchor.

    symbols holds documents one after another; a window is `length` symbols of one document; its anchor is
    the k symbols of the least value within it, the leftmost of equals. So the anchor depends on the
    window's content alone: equal windows have equal anchors at equal places.
    """
    none = np.zeros(0, np.int64)
    windows = len(symbols) - length + 1
    if windows <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    valid = np.zeros(windows + 1, np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    long = lengths >= length
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long] + lengths[long] - length + 1, -1)
    valid = np.cumsum(valid)[:windows] > 0
    values = rolling(symbols, k)
    anchor = np.empty(windows, np.int64)
    low = np.uint64((1 << 22) - 1)
    for a in range(0, windows, SEGMENT):
        b = min(windows, a + SEGMENT)
        part = values[a : b + length - k]
        ranked = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        anchor[a:b] = (least_of(ranked, length - k + 1) & low).astype(np.int64) + a
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    own = anchor[starts]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return starts[first], starts[last], own[first], values[own[first]]


def merged_repeats(runs: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """For each sorted run of distinct keys: which keys are in another run too."""
    if not runs:
        return []
    keys = np.concatenate([r for _, r in runs])
    ordered = np.sort(keys, kind="stable")
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return [np.zeros(len(r), bool) for _, r in runs]
    return [twice[np.minimum(np.searchsorted(twice, r), len(twice) - 1)] == r for _, r in runs]
