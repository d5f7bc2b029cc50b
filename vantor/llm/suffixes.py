"""Exact removal of repeated byte strings: blockwise suffix sorting with difference-cover sample ranks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ranges, stored
from .exchange import NO_ID, anchor_runs, chunked, cuts, merged_repeats, mix64, pack, unpack, with_replies

#: Period of the difference cover, and the cover: every difference modulo the period is one of two members.
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
#: Bytes of an anchor within a string; bytes of contexts sorted at once; contexts of a group that is not split further.
ANCHOR = 128
BLOCK_BYTES = 2 << 20
BLOCK_SUFFIXES = 1 << 20
GROUP_ROWS = 2_000
#: Larger groups are split by what strings that start within so many bytes of one another have in common, at last by whole strings.
WIDTHS = (32, 4)
#: Smaller than elsewhere: each byte is a symbol with several 64-bit values.
CHUNK_BYTES = 2 << 20

_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shift_table() -> np.ndarray:
    """For residues (i, j): the least d with i + d and j + d both in the cover."""
    member = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[next(d for d in range(PERIOD) if member[i + d] and member[j + d]) for j in range(PERIOD)] for i in range(PERIOD)])


SHIFT = _shift_table()


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def cover_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each cover position's suffix by its first `depth` bytes at least, by doubling within the sample; 0 elsewhere.

    Adding a multiple of the period stays within the cover, so the sample is closed under doubling.
    """
    n = len(words)
    rank = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    second = words[np.minimum(at + 8, n - 1)] * (at + 8 < n)
    order = np.lexsort((second, words[at]))
    a, b = words[at][order], second[order]
    rank[at[order]] = np.concatenate(([1], 1 + np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    width = PERIOD
    while width < depth:
        high, low = rank[at], rank[np.minimum(at + width, n)]
        key = high * (n + 2) + low
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[at[order]] = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1])))
        width *= 2
    return rank


def sorted_blocks(text: np.ndarray, suffixes: np.ndarray, depth: int, block: int = BLOCK_SUFFIXES):
    """Yield the given suffixes of text in order of their first `depth` bytes, one bucket at a time.

    Buckets are ranges of the first eight bytes, so their concatenation is sorted and only one bucket's keys are in memory.
    Within one, suffixes are sorted by their first PERIOD bytes; longer ties fall to the sample: both
    suffixes, moved on by one shift, are cover positions with known ranks. Ties of one residue share their shift and are
    sorted at once; ties across residues compare pairwise.
    """
    words = _words(text)
    rank = cover_ranks(words, depth)
    n = len(words)
    heads = words[suffixes]
    parts = max(1, -(-len(suffixes) // block))
    borders = np.unique(np.quantile(heads, np.arange(1, parts) / parts, method="lower")) if parts > 1 else np.zeros(0, np.uint64)
    bucket = np.searchsorted(borders, heads, "right")
    for b in range(len(borders) + 1):
        own = suffixes[bucket == b]
        if not len(own):
            continue
        residue = own % PERIOD
        tail = words[np.minimum(own + 8, n - 1)] * (own + 8 < n)
        by_rank = rank[np.minimum(own + SHIFT[residue, residue], n)]
        order = np.lexsort((by_rank, residue, tail, words[own]))
        own, residue, tail, head = own[order], residue[order], tail[order], words[own[order]]
        tie = np.concatenate(([False], (head[1:] == head[:-1]) & (tail[1:] == tail[:-1])))
        mixed = np.flatnonzero(tie & np.concatenate(([False], residue[1:] != residue[:-1])))
        if len(mixed):
            own = _merge_residues(own, tie, mixed, rank, n)
        yield own


def _merge_residues(own: np.ndarray, tie: np.ndarray, mixed: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Sort the tie groups that hold several residues by pairwise shifts."""
    from functools import cmp_to_key

    starts = np.flatnonzero(~tie)
    group = np.unique(np.searchsorted(starts, mixed, "right") - 1)
    ends = np.concatenate((starts[1:], [len(own)]))

    def compare(i, j):
        d = SHIFT[i % PERIOD, j % PERIOD]
        return int(rank[min(i + d, n)]) - int(rank[min(j + d, n)])

    own = own.copy()
    for g in group:
        a, b = starts[g], ends[g]
        own[a:b] = sorted(own[a:b].tolist(), key=cmp_to_key(compare))
    return own


def repeated(text: np.ndarray, suffixes: np.ndarray, length: int, block: int = BLOCK_SUFFIXES) -> np.ndarray:
    """Which of the suffixes share their first `length` bytes with another of them; all have that many bytes."""
    words = _words(text)
    found = np.zeros(len(text), bool)
    last = None
    for part in sorted_blocks(text, suffixes, length + PERIOD, block):
        if last is not None:
            part = np.concatenate(([last], part))
        last = part[-1]
        pair = np.stack([part[:-1], part[1:]])
        for at in [*range(0, length - 7, 8), length - 8]:
            pair = pair[:, words[pair[0] + at] == words[pair[1] + at]]
        found[pair.ravel()] = True
    return found[suffixes]


def _layout(contexts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (place of the anchor, bytes) one after another, anchors at multiples of the period, and their starts.

    Equal strings hold their anchor at equal places, so they have equal residues and their ties need no pairwise merging.
    """
    starts, at = [], 0
    for lead, data in contexts:
        at += -(at + lead) % PERIOD
        starts.append(at)
        at += len(data)
    text = np.zeros(at + PERIOD, np.uint8)
    for s, (_, data) in zip(starts, contexts):
        text[s : s + len(data)] = np.frombuffer(data, np.uint8)
    return text, np.array(starts)


def _spans(flags: np.ndarray) -> list[int]:
    """Runs of set flags as from, to, from, to, ..."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.tolist()


def _chunk_runs(data: bytes, length: int):
    ids, lengths, text = unpack(data)
    first, last, anchor, value = anchor_runs(_SYMBOLS[text], lengths, min(ANCHOR, length), length)
    return ids, lengths, text, first, last, anchor, value


def _context_key(raw: bytes, lead: int) -> int:
    return xxhash.xxh3_64_intdigest(raw, lead) - (1 << 63)


def pieces(data: bytes, lead: int, length: int, width: int) -> list[tuple[int, int, int, int]]:
    """(from, strings, key, key) of a context's strings in blocks of `width` distances to the anchor.

    All strings of a block hold the bytes from its last start to its first end, wherever the context itself ends; equal strings
    have equal distances to their anchor, so their blocks have equal keys.
    """
    out, n = [], len(data) - length + 1
    for block in range((lead - n + 1) // width, lead // width + 1):
        a, b = lead - (block * width + width - 1), lead - block * width
        common = data[b : a + length]
        key = [xxhash.xxh3_64_intdigest(common, 2 * block + k) - (1 << 63) for k in range(2)]
        out.append((max(a, 0), min(b, n - 1) - max(a, 0) + 1, *key))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, group_rows: int = GROUP_ROWS, block_suffixes: int = BLOCK_SUFFIXES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in any document. Each such
    string has an anchor that depends on its content alone; only anchors seen twice can hold a repeat. Their contexts (all bytes of the
    strings over one anchor's place) meet in a group per anchor, equal contexts once, and their suffixes are
    sorted block by block. A group of over group_rows different contexts is split: its contexts are cut into pieces of a few
    strings, and pieces meet that agree on all bytes which their strings have in common, at last strings that are equal altogether.
    Null texts are empty; repeated rows repeat each other; an empty table gives an empty result.
    """
    if length < 16:
        raise ValueError("length must be at least 16")
    spark = docs.sparkSession
    buckets = partitions(spark)
    chunks = chunked(docs, id_col, text_col, CHUNK_BYTES)

    def send(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.unique(_chunk_runs(data, length)[-1])
                parts = cuts(keys, buckets)
                arrays = [[b for b, _, _ in parts], [chunk] * len(parts), [pack(keys[s:e]) for _, s, e in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.int32()), pa.array(arrays[1], pa.int64()), pa.array(arrays[2], pa.binary())], ["bucket", "chunk", "keys"])

    def merge(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_pylist()
        runs = [(c, unpack(k)[0]) for c, k in zip(chunk, table.column("keys").to_pylist())]
        flags = [pack(f.view(np.uint8)) for f in merged_repeats(runs)]
        return pa.table({"chunk": chunk, "bucket": table.column("bucket"), "flags": pa.array(flags, pa.binary())})

    replies = chunks.mapInArrow(send, "bucket int, chunk long, keys binary").groupBy("bucket").applyInArrow(merge, "chunk long, bucket int, flags binary")

    def contexts(batches):
        for batch in batches:
            for chunk, data, bucket, flags in zip(*(batch.column(i).to_pylist() for i in range(4))):
                _, _, text, first, last, anchor, value = _chunk_runs(data, length)
                if not len(value):
                    continue
                keys, inverse, counts = np.unique(value, return_inverse=True, return_counts=True)
                elsewhere = np.concatenate([unpack(f)[0] for _, f in sorted(zip(bucket, flags))]).view(bool)
                take = np.flatnonzero((elsewhere | (counts > 1))[inverse])
                raw = text.tobytes()
                rows: dict[tuple, list] = {}
                for v, a, b, p in zip(value[take].view(np.int64).tolist(), first[take].tolist(), last[take].tolist(), anchor[take].tolist()):
                    part = raw[a : b + length]
                    key = (v, _context_key(part, p - a))
                    if key in rows:
                        rows[key][0] += 1
                    else:
                        rows[key] = [1, p - a, part]
                items = list(rows.items())
                for at in range(0, len(items), 4096):
                    part = items[at : at + 4096]
                    cols = [[k[0] for k, _ in part], [k[1] for k, _ in part], [chunk] * len(part), *[[r[i] for _, r in part] for i in range(3)]]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "context", "chunk", "n", "lead", "bytes"])

    asked = with_replies(chunks, replies, "bucket", "flags")
    met = stored(asked.mapInArrow(contexts, "anchor long, context long, chunk long, n long, lead int, bytes binary"), "contexts", tidy=True)
    each = met.groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    each = stored(each, "distinct", tidy=True)

    def sort_groups(batches):
        def flush(held):
            text, starts = _layout([(lead, data) for *_, lead, data in held])
            counts = np.array([len(data) - length + 1 for *_, data in held])
            ends = np.cumsum(counts)
            suffixes = np.repeat(starts - np.concatenate(([0], ends[:-1])), counts) + np.arange(ends[-1])
            flags = repeated(text, suffixes, length, block_suffixes)
            out = [(a, c, [x + at for x in ([0, int(k)] if n > 1 else _spans(flags[e - k : e]))]) for (_, a, c, at, n, _, _), k, e in zip(held, counts, ends)]
            out = [r for r in out if r[2]]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["anchor", "context", "spans"])

        held, size = [], 0
        for batch in batches:
            for *group, anchor, context, at, n, lead, data in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if held and size > BLOCK_BYTES and group != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append((group, anchor, context, at, n, lead, data))
                size += len(data)
        if held:
            yield flush(held)

    columns = ["one", "two", "anchor", "context", "at", "n", "lead", "bytes"]
    schema = "one long, two long, anchor long, context long, at int, n long, lead int, bytes binary"
    names = "anchor long, context long, spans array<int>"

    def cut(width: int):
        def run(batches):
            for batch in batches:
                for anchor, context, at, n, lead, data in zip(*(batch.column(c).to_pylist() for c in columns[2:])):
                    parts = pieces(data, lead, length, width)
                    cols = [[p[2] for p in parts], [p[3] for p in parts], [anchor] * len(parts), [context] * len(parts), [at + p[0] for p in parts], [n] * len(parts), [lead - p[0] for p in parts], [data[p[0] : p[0] + p[1] - 1 + length] for p in parts]]
                    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], columns)

        return run

    met_groups, found = each.select(F.col("anchor").alias("one"), F.lit(0).cast("long").alias("two"), "anchor", "context", F.lit(0).alias("at"), "n", "lead", "bytes"), []
    for width in (*WIDTHS, 1):
        sizes = stored(met_groups.groupBy("one", "two").agg(F.count("*").alias("rows"), F.sum("n").alias("all")), "sizes", tidy=True)
        small = met_groups.join(sizes.where((F.col("rows") <= group_rows) & (F.col("all") > 1)).select("one", "two"), ["one", "two"])
        small = small.repartition(buckets, "one", "two").sortWithinPartitions("one", "two", "anchor", "context", "at").select(*columns)
        found.append(stored(small.mapInArrow(sort_groups, names), "spans", tidy=True))
        wide = sizes.where(F.col("rows") > group_rows).select("one", "two")
        if wide.isEmpty():
            break
        met_groups = stored(met_groups.join(wide, ["one", "two"]).mapInArrow(cut(width), schema), "pieces", tidy=True)
    else:
        # Each row is one string now, and the keys are digests of all of it.
        twice = met_groups.groupBy("one", "two").agg(F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
        found.append(met_groups.join(twice, ["one", "two"]).select("anchor", "context", F.array("at", F.col("at") + 1).alias("spans")))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = spans.groupBy("anchor", "context").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = stored(spans, "spans", tidy=True)
    back = met.select("chunk", "anchor", "context").join(spans, ["anchor", "context"])

    def finish(batches):
        for batch in batches:
            for _, data, anchors, keys, spans in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids, lengths, text, first, last, anchor, value = _chunk_runs(data, length)
                known = {(a, k): s for a, k, s in zip(anchors or (), keys or (), spans or ())}
                raw, lo, hi = text.tobytes(), [], []
                held = np.isin(value.view(np.int64), np.array(list({a for a, _ in known}), np.int64)) if known else np.zeros(len(value), bool)
                take = np.flatnonzero(held)
                for v, a, b, p in zip(value[take].view(np.int64).tolist(), first[take].tolist(), last[take].tolist(), anchor[take].tolist()):
                    s = known.get((v, _context_key(raw[a : b + length], p - a)))
                    if s:
                        lo += [a + x for x in s[::2]]
                        hi += [a + x - 1 + length for x in s[1::2]]
                # Strings stay within documents, but those of neighbours may touch: runs are cut at the borders.
                ends = np.cumsum(lengths)
                starts = ends - lengths
                lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
                owner = np.searchsorted(ends, lo, "right")
                by = np.argsort(owner, kind="stable")
                at = np.searchsorted(owner[by], np.arange(len(ids) + 1))
                out = []
                for i, (doc, s, e) in enumerate(zip(ids.tolist(), starts.tolist(), ends.tolist())):
                    mine = by[at[i] : at[i + 1]]
                    cut = ranges(lo[mine], hi[mine])
                    kept, done = hashlib.sha256(), s
                    for a, b in cut:
                        kept.update(raw[done:a])
                        done = b
                    kept.update(raw[done:e])
                    out.append((None if doc == NO_ID else doc, e - s, sum(b - a for a, b in cut), len(cut), kept.hexdigest()))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_replies(chunks, back, "anchor", "context", "spans").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Strings are compared by their MD5 here.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800),
strings AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS s FROM starts),
repeats AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
marked AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM strings SEMI JOIN repeats USING (s)),
counts AS (SELECT r, sum(least(400, coalesce(next - i, 400))) AS n_removed, count(*) FILTER (prev IS NULL OR i - prev > 400) AS n_spans FROM marked GROUP BY r),
borders AS (SELECT r, i + 400 AS a, coalesce(next, -1) AS b FROM marked WHERE next IS NULL OR next - i > 400 UNION ALL SELECT r, 0, i FROM marked WHERE prev IS NULL),
pieces AS (SELECT x.r, x.a, CASE WHEN x.b < 0 THEN substr(d.h, 2 * x.a + 1) ELSE substr(d.h, 2 * x.a + 1, 2 * (x.b - x.a)) END AS piece FROM borders x JOIN d ON d.r = x.r),
kept AS (SELECT r, string_agg(piece, '' ORDER BY a) AS kept FROM pieces GROUP BY r)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN counts c ON c.r = d.r LEFT JOIN kept k ON k.r = d.r
"""
