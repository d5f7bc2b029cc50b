"""Packing documents into token sequences: cutting-stock column generation over the histogram of piece lengths."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, stored

#: Code points for which Python's splitting below equals the tokenizer's own; other texts go to the tokenizer whole.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNSAFE = re.compile(rf"[^\t\n\r\x20-\x7e¡¿–—‘-„…{_LETTER}]")
_SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^ \t\n\r{_LETTER}0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: Entries of a worker's memory of split pieces; it is emptied when full.
CACHE_ENTRIES = 300_000
#: Pieces of one length that are ranked together, on average at most: a length has as many parts as it needs.
RANK_ROWS = 50_000
_LOADED: dict[str, Pieces] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """Split piece -> its ids as little-endian 32-bit bytes, by the tokenizer's model; merges never cross pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        mapped = piece.encode().decode("latin-1").translate(self.alphabet)
        self[piece] = ids = np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if _UNSAFE.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): a document cut into full sequences and one rest."""

    def run(batches):
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = Pieces(tokenizer)
        pieces, last = _LOADED[tokenizer], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = pieces.encode(text or "") + last
                n = len(ids) // 4
                out += [(doc, s, min(sequence, n - s), zlib.crc32(ids[4 * s : 4 * (s + sequence)]), n) for s in range(0, n, sequence)]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(dual: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of item sizes 1..capacity of the largest dual value."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1][:c] + dual[1 : c + 1]
        k = int(gain.argmax())
        best[c], choice[c] = (gain[k], k + 1) if gain[k] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c]] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def first_basis(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis by first fit over fractional demand: each pattern is used until a size runs out.

    A pattern holds no size that ran out before, so the patterns are triangular in the order of running out;
    sizes that run out together get a pattern of their own, used 0 times.
    """
    left, sizes = demand.astype(float), np.flatnonzero(demand)
    place = {int(k): i for i, k in enumerate(sizes)}
    basis, x = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    while left.any():
        pattern, room, rest = np.zeros(capacity + 1), capacity, left.copy()
        while room and (fits := np.flatnonzero(rest[: room + 1])).size:
            k = int(fits[-1])
            pattern[k] = min(room // k, max(1, int(left[k])))
            room -= int(pattern[k]) * k
            rest[k] = 0
        used = np.flatnonzero(pattern)
        n = (left[used] / pattern[used]).min()
        left -= n * pattern
        gone = [int(k) for k in used if left[k] <= 1e-9 * max(1, demand[k])]
        left[gone] = 0
        for j, k in enumerate(gone):
            basis[:, place[k]] = pattern[sizes] if j == 0 else (sizes == k) * (capacity // k)
            x[place[k]] = n if j == 0 else 0.0
    return basis, x


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. No LAPACK or threaded BLAS in the driver: its threads can stall beside the JVM."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        r = k + int(np.abs(both[k:, k]).argmax())
        both[[k, r]] = both[[r, k]]
        both[k] /= both[k, k]
        others = np.flatnonzero(both[:, k])
        others = others[others != k]
        both[others] -= both[others, k][:, None] * both[k]
    return both[:, m:]


def column_generation(demand: np.ndarray, capacity: int, max_rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Patterns over sizes 1..capacity with multiplicities that use up demand (index = size) exactly.

    The linear program minimises the number of sequences; a revised simplex keeps its basis, the
    knapsack prices the next column. Solutions are rounded down and what is left is filled greedily,
    largest size first.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    m = len(sizes)
    basis, _ = first_basis(demand, capacity)
    inverse = inverse_of(basis)
    x = np.maximum(0.0, np.einsum("ij,j->i", inverse, demand[sizes].astype(float)))
    for _ in range(max_rounds):
        dual = np.zeros(capacity + 1)
        dual[sizes] = np.maximum(0.0, inverse.sum(0))
        value, pattern = price(dual, capacity)
        if value <= 1 + 1e-7:
            break
        column = pattern[sizes].astype(float)
        direction = np.einsum("ij,j->i", inverse, column)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1.0), np.inf)
        r = int(ratio.argmin())
        step = max(0.0, float(ratio[r]))
        x = x - step * direction
        x[r] = step
        basis[:, r] = column
        inverse[r] /= direction[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(direction[others], inverse[r])
    counts = np.floor(np.maximum(x, 0.0) + 1e-6).astype(np.int64)
    out, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-counts, kind="stable"):
        pattern = np.zeros(capacity + 1, np.int64)
        pattern[sizes] = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        n = int(min(counts[j], (left[used] // pattern[used]).min()))
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    while left.any():
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        while room and (fits := np.flatnonzero(left[: room + 1] > pattern[: room + 1])).size:
            k = int(fits[-1])
            n = min(room // k, int(left[k] - pattern[k]))
            pattern[k] += n
            room -= n * k
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


def pack(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = 2048, end_id: int = 1, grain: int = 8, rank_rows: int = RANK_ROWS
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of a document.

    Lengths are planned in classes of grain tokens (never above the sequence), so the program's size is bounded;
    pieces get a rank within their class from two-level counts, and a class's ranks are dealt to the rounded
    patterns. Null and empty texts are the end id alone; repeated rows and null doc_ids are documents of
    their own; an empty table gives an empty result.
    """
    if sequence % grain:
        raise ValueError("sequence must be a multiple of grain")
    pieces = stored(token_pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, sequence, end_id), "pieces")
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int"))
    # A row per length: at most `sequence` of them, so they are broadcast.
    lengths = stored(pieces.groupBy("length").agg(F.ceil(F.count("*") / rank_rows).alias("bins")), "lengths")
    pieces = pieces.join(F.broadcast(lengths), "length").withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("bins"))).drop("bins")
    counts = stored(pieces.groupBy("size", "length", "bin").count(), "lengths")
    capacity = sequence // grain
    demand = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect():  # at most sequence / grain rows
        demand[r["size"]] = r["n"]
    plan, base = [], 0
    filled = np.zeros(capacity + 1, np.int64)
    for pattern, n in column_generation(demand, capacity):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            plan.append((int(k), int(filled[k]), int(pattern[k]), base, slot))
            filled[k] += n * pattern[k]
            slot += int(pattern[k])
        base += n
    plan.sort()
    table = np.array(plan, np.int64).reshape(-1, 5)
    first = {int(k): (int(a), int(b)) for k, a, b in zip(*(lambda u, i, c: (u, i, i + c))(*np.unique(table[:, 0], return_index=True, return_counts=True)))}

    def deal(batches):
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            seq, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for k in np.unique(size):
                own, (a, b) = size == k, first[int(k)]
                part = table[a:b]
                row = part[np.searchsorted(part[:, 1], rank[own], "right") - 1]
                seq[own] = row[:, 3] + (rank[own] - row[:, 1]) // row[:, 2]
                slot[own] = row[:, 4] + (rank[own] - row[:, 1]) % row[:, 2]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(slot)], [*names, "sequence_id", "slot"])

    # Running counts in two steps: over the few lengths of a class, then over the parts of one length.
    by_size = Window.partitionBy("size").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    by_length = Window.partitionBy("size", "length").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    longer = counts.groupBy("size", "length").agg(F.sum("count").alias("n")).select("size", "length", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("longer"))
    earlier = F.coalesce(F.sum("count").over(by_length), F.lit(0))
    before = counts.withColumn("earlier", earlier).join(longer, ["size", "length"]).select("size", "length", "bin", (F.col("longer") + F.col("earlier")).alias("before"))
    within = Window.partitionBy("size", "length", "bin").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(within)).join(checked_broadcast(stored(before, "before")), ["size", "length", "bin"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("before") + F.col("place") - 1).alias("rank"))
    dealt = ranked.mapInArrow(deal, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("slot")
