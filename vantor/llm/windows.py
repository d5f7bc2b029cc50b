"""Incremental removal of repeated word windows by a log-structured fingerprint index."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, partitions, stored
from .exchange import NO_ID, anchor_runs, bucket_of, chunked, cuts, numbers, pack, planes, rolling, unpack, with_replies
from .seating import within

#: Words of an anchor within a window.
ANCHOR_WORDS = 6
#: Keys of a run in one cell of its table.
CELL_KEYS = 1 << 22
#: Bytes of a word, and of a window, that are taken eight at a time for all words or windows at once; longer ones are finished one by one.
WORD_BYTES, WINDOW_BYTES = 64, 512
#: Bytes of contexts whose words are in memory at once when windows meet.
PART_BYTES = 1 << 20

#: The first k bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_bounds(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after another, and the number of words of each text."""
    blank = (text == 32) | (text - np.uint8(9) < 5)
    borders = np.cumsum(lengths)
    edge = np.zeros(len(text) + 1, bool)
    edge[0] = True
    edge[borders] = True
    begin, end = edge[:-1].copy(), edge[1:].copy()
    begin[1:] |= blank[:-1]
    end[:-1] |= blank[1:]
    begin &= ~blank
    end &= ~blank
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, borders), prepend=0)


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))


def word_symbols(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit value of each word, which follows from its bytes alone. Values lead words together; only bytes tell that words are equal."""
    eight = _eights(text)
    value = mix64((eight[starts] & _MASKS[np.minimum(sizes, 8)]) ^ sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    done, at = 8, np.flatnonzero(sizes > 8)
    while len(at) and done < WORD_BYTES:
        value[at] = mix64(value[at] ^ (eight[starts[at] + done] & _MASKS[np.minimum(sizes[at] - done, 8)]))
        done += 8
        at = at[sizes[at] > done]
    for i, s, n in zip(at.tolist(), starts[at].tolist(), sizes[at].tolist()):
        value[i] = xxhash.xxh64_intdigest(text[s : s + n], 7)
    return value


def same_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the `sizes` bytes from a and those from b are equal."""
    eight, same = _eights(text), np.ones(len(a), bool)
    done, at = 0, np.flatnonzero(sizes > 0)
    while len(at) and done < WINDOW_BYTES:
        same[at] = ((eight[a[at] + done] ^ eight[b[at] + done]) & _MASKS[np.minimum(sizes[at] - done, 8)]) == 0
        done += 8
        at = at[same[at] & (sizes[at] > done)]
    for i, x, y, n in zip(at.tolist(), a[at].tolist(), b[at].tolist(), sizes[at].tolist()):
        same[i] = np.array_equal(text[x + done : x + n], text[y + done : y + n])
    return same


def places(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A number of each window (its bytes from starts to ends), the same for equal bytes and only for those; equal windows have equal values."""
    order = np.argsort(value)
    alike = value[order[1:]] == value[order[:-1]]
    a, b = order[:-1][alike], order[1:][alike]
    sizes = ends - starts
    equal = sizes[a] == sizes[b]
    if equal.all() and same_bytes(text, starts[a], starts[b], sizes[a]).all():
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(np.concatenate(([False], ~alike))) if len(order) else 0
        return place
    # Different windows share a value: their bytes are looked up.
    memo, raw = _Places(), text.tobytes()
    return np.fromiter((memo[raw[s:e]] for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))


def spaced(text: bytes) -> bytes:
    """A text's words, joined by one space."""
    return b" ".join(text.split())


class _Places(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class _Chunk:
    """Words and anchored windows of a chunk of spaced() texts, the same each time they are computed."""

    def __init__(self, data: bytes, length: int):
        self.ids, lengths, self.text = unpack(data)
        self.starts, self.ends, self.counts = word_bounds(self.text, lengths)
        self.symbols = word_symbols(self.text, self.starts, self.ends - self.starts)
        self.length = length
        self.first, self.last, _, self.value = anchor_runs(self.symbols, self.counts, min(ANCHOR_WORDS, length), length)
        self.keys, self.inverse, self.times = np.unique(self.value, return_inverse=True, return_counts=True)

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words to keep, each with one space after it, and their starts and ends there."""
        starts, ends = self.starts[keep], self.ends[keep]
        mark = np.zeros(len(self.text) + 1, np.int8)
        mark[starts] = 1
        mark[ends] -= 1
        own = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
        after = np.cumsum(ends - starts + 1)
        word = np.ones(int(after[-1]) if len(after) else 0, bool)
        word[after - 1] = False
        out = np.full(len(word), 32, np.uint8)
        out[word] = self.text[own]
        return out, after - (ends - starts + 1), after - 1

    def contexts(self, flags: np.ndarray, local: bool, ranges: int) -> _Contexts:
        """Runs of windows that share an anchor which is seen elsewhere, or twice here if local."""
        met = flags | (self.times > 1) if local else flags
        take = np.flatnonzero(met[self.inverse]) if len(met) else np.zeros(0, np.int64)
        return _Contexts(self, take, ranges)


class _Contexts:
    """A chunk's distinct contexts (the words of a run of windows of one anchor) in the order in which they are sent: by range."""

    def __init__(self, chunk: _Chunk, take: np.ndarray, ranges: int):
        self.first, self.count = chunk.first[take], chunk.last[take] - chunk.first[take] + 1
        self.docs = chunk.ids[np.searchsorted(np.cumsum(chunk.counts), self.first, "right")]
        text, memo = chunk.text.tobytes(), _Places()
        cut = zip(chunk.starts[self.first].tolist(), chunk.ends[self.first + self.count + chunk.length - 2].tolist())
        place = np.fromiter((memo[text[a:b]] for a, b in cut), np.int64, len(take))
        head = np.unique(place, return_index=True)[1]
        owner = bucket_of(chunk.value[take][head], ranges)
        order = np.argsort(owner, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        known = list(memo)
        self.place, self.range, self.windows = rank[place], owner[order], self.count[head][order]
        self.words = [known[k] for k in order.tolist()]
        self.least = np.full(len(order), NO_ID)
        np.minimum.at(self.least, self.place, self.docs)

    def messages(self):
        edge = np.flatnonzero(np.concatenate(([True], self.range[1:] != self.range[:-1], [True]))) if len(self.range) else np.zeros(1, np.int64)
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            words = self.words[s:e]
            sizes = np.fromiter(map(len, words), np.uint32, e - s)
            yield int(self.range[s]), pack(sizes, self.windows[s:e].astype(np.uint32), planes(self.least[s:e]), np.frombuffer(b"".join(words), np.uint8))

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that also start in a smaller document: as the ranges say, or in one of this chunk."""
        at = np.repeat((np.cumsum(self.windows) - self.windows)[self.place], self.count) + within(self.count)
        here = np.repeat(self.docs > self.least[self.place], self.count)
        return (np.repeat(self.first, self.count) + within(self.count))[repeated[at] | here] if len(at) else at


class WindowIndex:
    """A log of sorted, immutable runs of window fingerprints, with the batches' chunks.

    A run holds, per range of fingerprints, the sorted anchors of a batch's windows and the chunks they are in.
    add() merge-joins a new batch's run with the runs so far; what meets is verified word by word: the words around the anchors of
    both sides meet in a range, where windows are equal if their words are. The batch's run joins the log. Once there are `fanout`
    runs, the next batch finds them compacted into one. Batches come in the order of document ids, so that an earlier batch never changes.
    """

    def __init__(self, length: int = 13, fanout: int = 2):
        self.length, self.fanout = length, fanout
        self.runs: list[DataFrame] = []
        self.chunks: list[DataFrame] = []
        self.batches = self.compactions = 0

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of the new batch's documents; the index then holds them."""
        length = self.length
        number = self.batches
        ranges = self.buckets = getattr(self, "buckets", None) or partitions(docs.sparkSession)
        new = chunked(docs, id_col, text_col, first=number << 55, form=spaced)

        def send(batches):
            for batch in batches:
                for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys = _Chunk(data, length).keys
                    parts = cuts(keys, ranges)
                    packed = [pack(keys[s:e], np.full(e - s, chunk, np.int64)) for _, s, e in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "run"])

        def compact(table: pa.Table) -> pa.Table:
            keys, owners = (np.concatenate(c) for c in zip(*(unpack(r) for r in table.column("run").to_pylist())))
            order = np.lexsort((owners, keys))
            cells = [pack(keys[order[s : s + CELL_KEYS]], owners[order[s : s + CELL_KEYS]]) for s in range(0, len(order), CELL_KEYS)]
            return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(cells), pa.int32()), "run": pa.array(cells, pa.binary())})

        if len(self.runs) >= self.fanout:
            merged = self.runs[0]
            for later in self.runs[1:]:
                merged = merged.unionByName(later)
            old_runs, self.runs = self.runs, [stored(merged.groupBy("bucket").applyInArrow(compact, "bucket int, run binary"), "run", tidy=True)]
            discard(*old_runs)
            self.compactions += 1
        run = stored(new.mapInArrow(send, "bucket int, run binary").groupBy("bucket").applyInArrow(compact, "bucket int, run binary"), "run", tidy=True)

        def merge_join(table: pa.Table) -> pa.Table:
            runs = [unpack(r) for r in table.column("run").to_pylist()]
            keys, owners = (np.concatenate(c) for c in zip(*runs))
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.concatenate((start, [len(keys)])))
            fresh = np.maximum.reduceat(owners >> 55, start) == number
            flag = np.repeat((size > 1) & fresh, size)
            by = np.argsort(owners, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], owners[by][1:] != owners[by][:-1])))
            parts = np.split(flag[by], edge[1:])
            chunk = owners[by][edge]
            told = [(c, pack(f.view(np.uint8))) for c, f in zip(chunk.tolist(), parts) if c >> 55 == number or f.any()]
            n = len(told)
            return pa.table({"chunk": pa.array([c for c, _ in told], pa.int64()), "kind": pa.array(["anchor"] * n, pa.string()), "bucket": pa.array([table.column("bucket")[0].as_py()] * n, pa.int32()), "flags": pa.array([f for _, f in told], pa.binary())})

        log = run
        for old in self.runs:
            log = log.unionByName(old)
        reply = "chunk long, kind string, bucket int, flags binary"
        met = stored(log.groupBy("bucket").applyInArrow(merge_join, reply), "met", tidy=True)

        def sparse(chunk: _Chunk, buckets, flags) -> np.ndarray:
            # An old chunk hears only from ranges with a match; the others' keys are unset.
            out = np.zeros(len(chunk.keys), bool)
            told = dict(zip(buckets or (), flags or ()))
            for b, s, e in cuts(chunk.keys, ranges):
                if b in told:
                    out[s:e] = unpack(told[b])[0].view(bool)
            return out

        def windows(batches):
            for batch in batches:
                for chunk, data, buckets, flags in zip(*(batch.column(c).to_pylist() for c in ("chunk", "data", "bucket", "flags"))):
                    own = _Chunk(data, length)
                    told = list(own.contexts(sparse(own, buckets, flags), chunk >> 55 == number, ranges).messages())
                    cols = [pa.array([b for b, _ in told], pa.int32()), pa.array([chunk] * len(told), pa.int64()), pa.array([m for _, m in told], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["bucket", "chunk", "sent"])

        asked = with_replies(new, met, "bucket", "flags")
        told = met.where(F.shiftright("chunk", 55) != number).select("chunk").distinct()
        for old in self.chunks:
            asked = asked.unionByName(with_replies(old.join(told, "chunk", "left_semi"), met, "bucket", "flags"))

        def verify(table: pa.Table) -> pa.Table:
            chunk = table.column("chunk").to_pylist()
            text, found, docs, held, size = bytearray(), [], [], [], 0
            for i, data in enumerate(table.column("sent")):
                sizes, counts, least, words = unpack(data.as_buffer())
                docs.append(np.repeat(numbers(least), counts))
                held.append((sizes.astype(np.int64), counts.astype(np.int64), words))
                size += len(words)
                if size >= PART_BYTES or i == len(chunk) - 1:
                    sizes, counts, words = (np.concatenate(c) for c in zip(*held))
                    first, last, own = word_bounds(words, sizes)
                    at = np.repeat(np.cumsum(own) - own, counts) + within(counts)
                    value = rolling(word_symbols(words, first, last - first), length)[at]
                    found.append((first[at] + len(text), last[at + length - 1] + len(text), value))
                    text += words.data
                    held, size = [], 0
            ends, docs = np.cumsum([len(d) for d in docs]), np.concatenate(docs)
            place = places(np.frombuffer(text, np.uint8), *(np.concatenate(c) for c in zip(*found)))
            least = np.full(int(place.max()) + 1, NO_ID)
            np.minimum.at(least, place, docs)
            parts = np.split(least[place] < docs, ends[:-1])
            told = [(c, pack(f.view(np.uint8))) for c, f in zip(chunk, parts) if c >> 55 == number]
            n = len(told)
            return pa.table({"chunk": pa.array([c for c, _ in told], pa.int64()), "kind": pa.array(["window"] * n, pa.string()), "bucket": pa.array([table.column("bucket")[0].as_py()] * n, pa.int32()), "flags": pa.array([f for _, f in told], pa.binary())})

        verified = stored(asked.mapInArrow(windows, "bucket int, chunk long, sent binary").groupBy("bucket").applyInArrow(verify, reply), "verified", tidy=True)

        def finish(batches):
            for batch in batches:
                for chunk, data, kinds, buckets, flags in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    own = _Chunk(data, length)
                    told = {k: [(b, f) for kind, b, f in zip(kinds or (), buckets or (), flags or ()) if kind == k] for k in ("anchor", "window")}
                    found = own.contexts(sparse(own, *zip(*told["anchor"])) if told["anchor"] else np.zeros(len(own.keys), bool), True, ranges)
                    repeated = np.concatenate([unpack(f)[0] for _, f in sorted(told["window"])]).view(bool) if told["window"] else np.zeros(0, bool)
                    covered = found.covered(repeated)
                    mark = np.zeros(len(own.symbols) + 1, np.int64)
                    np.add.at(mark, covered, 1)
                    np.add.at(mark, covered + length, -1)
                    keep = np.cumsum(mark)[:-1] == 0
                    flat, starts, ends = own.joined(keep)
                    flat, last = flat.tobytes(), np.cumsum(own.counts)
                    kept = np.concatenate(([0], np.cumsum(keep)))
                    kept = np.stack([kept[last - own.counts], kept[last]], axis=1)
                    out = []
                    for doc, n, (a, b) in zip(own.ids.tolist(), own.counts.tolist(), kept.tolist()):
                        left = flat[starts[a] : ends[b - 1]] if b > a else b""
                        out.append((None if doc == NO_ID else doc, n, n - (b - a), hashlib.sha256(left).hexdigest()))
                    kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

        replies = met.where(F.shiftright("chunk", 55) == number).unionByName(verified)
        result = with_replies(new, replies, "kind", "bucket", "flags").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
        self.runs.append(run)
        self.chunks.append(new)
        self.batches += 1
        return result


def remove_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, batches: int = 3, fanout: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of all documents, taken into a new index in `batches` of ascending ids.

    A word goes if a window of `length` words over it also starts in a document of a smaller id, as the texts came in.
    Null texts have no words; documents without id come last and are smaller than none; rows of one id don't remove each other's words; an empty
    table gives an empty result.
    """
    index = WindowIndex(length, fanout)
    key = F.col(id_col).cast("long")
    # Borders only deal documents to batches; any borders give the same result.
    borders = docs.select(key.alias("k")).approxQuantile("k", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    borders = sorted({int(b) for b in borders})
    out = None
    for i in range(len(borders) + 1):
        part = docs
        if i:
            part = part.where(key.isNull() | (key >= borders[i - 1])) if i == len(borders) else part.where(key >= borders[i - 1])
        if i < len(borders):
            part = part.where(key < borders[i])
        rows = index.add(part, id_col, text_col)
        out = rows if out is None else out.unionByName(rows)
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
windows AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM starts),
least AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
removed AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM windows w JOIN least l ON l.win = w.win WHERE l.least < w.doc_id),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.p) FILTER (x.p IS NULL) AS kept, count(x.p) AS n_removed FROM words w LEFT JOIN removed x ON x.r = w.r AND x.p = w.p GROUP BY w.r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.r = d.r
"""
