"""Hierarchical Pitman-Yor language model: seatings of context restaurants sampled by Gibbs, sharing parents."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, mix64, stored
from .exchange import NO_ID, cuts, gathered, numbers, pack, planes, unpack
from .seating import drawn, uniform

#: Bytes of text in a chunk, and on average in a hash range of words.
CHUNK_BYTES = 2 << 20
RANGE_BYTES = 12 << 20
#: A word's dishes are split by their contexts into one part more for each so many training tokens of it.
HOT = 1 << 19
#: Sweeps whose predictive probabilities are averaged; each seats every customer of every dish again.
SAMPLES = 2
#: Contexts share parents by the last byte of their word: the end, a letter, digit, other sign, byte beyond ASCII.
CLASSES = 30
_U64 = np.uint64
#: The end of a text; it is also the context of a first word.
END = _U64(xxhash.xxh64_intdigest(b"\n", 11))
_CLASS_OF = np.array([27 + (c > 127) if not (48 <= c < 58 or 97 <= c < 123) else 29 if c < 58 else c - 96 for c in range(256)], np.uint8)
_MESSAGE = "bucket int, chunk long, src int, kind string, data binary, stat array<double>"
_FIELDS = [("bucket", pa.int32()), ("chunk", pa.int64()), ("src", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("stat", pa.list_(pa.float64()))]


class _Numbers(dict):
    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        return n


def _fold(doc: int, folds: int) -> int:
    return zlib.crc32(b"" if doc == NO_ID else str(doc).encode()) % folds


def tokenized(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(kind, chunk, bytes, meta, data): documents as places among their chunk's sorted types, each with the end last; and the types, in a folder of their own."""

    def run(batches):
        for number, ids, texts in gathered(batches, chunk_bytes):
            memo, parts = _Numbers({None: 0}), []
            for text in texts:
                words = lower_ascii(text).split()
                parts.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
                parts.append(np.zeros(1, np.int64))
            known = list(memo)[1:]
            hashes = np.array([int(END), *(xxhash.xxh64_intdigest(w, 11) for w in known)], _U64)
            kinds = np.concatenate(([0], _CLASS_OF[[w[-1] for w in known]])).astype(np.uint8)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            tokens = place[np.concatenate(parts)]
            counts = np.array([len(p) + 1 for p in parts[::2]], np.int64)
            out = np.array([_fold(d, folds) == held for d in ids], np.uint8)
            train = np.bincount(tokens[np.repeat(out, counts) == 0], minlength=len(order)).astype(np.uint32)
            meta = pack(np.array(ids, np.int64), counts, out, kinds[order], place[:1])
            cols = [["tokens", "types"], [number] * 2, [sum(map(len, texts)), 0], [meta, None], [pack(planes(tokens)), pack(hashes[order], planes(train))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "chunk", "bytes", "meta", "data"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return stored(rows.mapInArrow(run, "kind string, chunk long, bytes long, meta binary, data binary"), "tokens", ("kind",), True)


def parts_of(count: np.ndarray, hot: int) -> np.ndarray:
    return 1 + count.astype(np.int64) // hot


def part_range(word: np.ndarray, part: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a word's part: part 0 is at home, the others are anywhere."""
    guest = mix64(word + part.astype(_U64) * _U64(0xD1342543DE82EF95)) % _U64(ranges)
    return np.where(part == 0, home(word), guest.astype(np.int64))


def home(word: np.ndarray) -> np.ndarray:
    return ((word >> _U64(32)) & _U64((1 << 24) - 1)).astype(np.int64)


class _Pairs:
    """Distinct (word, context) of a chunk, in the order in which they are sent: by range, word and context.

    A word's number holds its class, home range and place there, so equal words have equal numbers in all chunks.
    """

    def __init__(self, meta: bytes, tokens: bytes, sources, replies, ranges: int, hot: int):
        self.ids, self.counts, self.out, kinds, end = unpack(meta)
        word, total = [], []
        for b, reply in sorted(zip(sources, replies)):
            step, n = unpack(reply)
            word.append((_U64(b) << _U64(32)) | np.cumsum(numbers(step, np.uint32)).astype(_U64))
            total.append(numbers(n))
        word = np.concatenate(word) | kinds.astype(_U64) << _U64(56)
        order = np.argsort(word, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.total = np.concatenate(total)[order]
        self.word, end = word[order], int(place[end[0]])
        self.token = place[numbers(unpack(tokens)[0], np.uint32)]
        before = np.append(end, self.token[:-1])  # a document's last token is the end, so its follower starts after one
        pair, self.pair = np.unique(self.token * len(order) + before, return_inverse=True)
        w, u = np.divmod(pair, len(order))
        train = np.repeat(self.out, self.counts) == 0
        self.seen = np.bincount(self.pair[train], minlength=len(pair))
        parts = parts_of(self.total, hot)[w]
        part = np.where(parts > 1, mix64(self.word[u]) % parts.astype(_U64), _U64(0)).astype(np.int64)
        self.range = part_range(self.word[w], part, ranges)
        self.order = np.argsort(self.range, kind="stable")
        self.w, self.u = w, u

    def messages(self):
        own = self.range[self.order]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        for s, e in zip(edge[:-1], edge[1:]):
            at = self.order[s:e]
            w, degree = np.unique(self.w[at], return_counts=True)
            yield int(own[s]), pack(planes(self.word[w]), planes(degree), planes(self.word[self.u[at]]), planes(self.seen[at].astype(np.uint32)))


def _rows(messages) -> pa.Table:
    cols = list(zip(*[(*m, None)[:6] for m in messages])) if messages else [()] * 6
    return pa.table([pa.array(c, k) for c, (_, k) in zip(cols, _FIELDS)], names=[n for n, _ in _FIELDS])


def _step(messages: DataFrame, act) -> DataFrame:
    """One round: each range handles the messages for it."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "src", "data"))), key=lambda r: r[:3])
        return _rows(act(table.column("bucket")[0].as_py(), rows))

    return messages.groupBy("bucket").applyInArrow(run, _MESSAGE)


def _sums(said: DataFrame, n: int) -> np.ndarray:
    """The ranges' statistics, summed by Spark: one row."""
    row = said.where("kind = 'stat'").agg(*[F.sum(F.col("stat")[i]) for i in range(n)]).first()
    return np.array([x or 0.0 for x in row])


def _kind(rows, kind: str) -> list[tuple[int, list[np.ndarray]]]:
    return [(r[2], unpack(r[3])) for r in rows if r[0] == kind]


def _digamma(x):
    return np.log(x) - 1 / (2 * x) - 1 / (12 * x * x)


def strength_terms(customers: np.ndarray, tables: np.ndarray, strength, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Per restaurant, the expected auxiliary variables that a strength's Gamma posterior is made of."""
    opened = strength / discount * np.log((strength + discount * np.maximum(tables - 0.5, 0.5)) / (strength + 0.5 * discount))
    return opened, np.where(customers > 1, _digamma(strength + np.maximum(customers, 2)) - _digamma(strength + 1), 0.0)


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(1.0, ones + 2 * twos), 0.05, 0.95))


class _Range:
    """A range's dishes: rows (word, context) in the order of word, class and number, and their parents (word, class)."""

    def __init__(self, data: list[np.ndarray] | None, bucket: int):
        word, degree, place, count, asked = data or [np.zeros(0, np.uint8)] * 5
        self.word, self.place = numbers(word, _U64), numbers(place, np.uint32)
        self.count, self.asked = numbers(count), numbers(asked, _U64)
        self.w = np.repeat(np.arange(len(self.word)), numbers(degree))
        kind = (self.asked >> _U64(56)).astype(np.int64)[self.place]
        key = self.w * CLASSES + kind
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        self.parent = np.cumsum(first) - 1
        self.parent_w, self.parent_kind = np.divmod(key[first], CLASSES)
        self.own = home(self.word) == bucket
        self.dish = self.count > 1  # the others have one table or none
        by = np.argsort(home(self.asked), kind="stable")
        self.by_home = by
        owner = home(self.asked)[by]
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(1, np.int64)
        self.homes = [(int(owner[s]), int(s), int(e)) for s, e in zip(edge[:-1], edge[1:])]

    def asks(self, bucket: int, tables: np.ndarray):
        """This range's tables of each context, for the contexts' homes."""
        n = np.bincount(self.place, tables, len(self.asked)).astype(np.int64)[self.by_home]
        at = (self.asked & _U64(0xFFFFFFFF)).astype(np.uint32)[self.by_home]
        return [(h, -1, bucket, "asks", pack(planes(at[s:e]), planes(n[s:e]))) for h, s, e in self.homes]

    def told(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """(customers, tables) of each context, as its home has summed them."""
        out = np.zeros((2, len(self.asked)), np.int64)
        got = _kind(rows, "told")
        if got:
            out[:, self.by_home] = [np.concatenate([numbers(g[i]) for _, g in got]) for i in range(2)]
        return out[0], out[1]

    def by_class(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.parent, tables, len(self.parent_w)).astype(np.int64)

    def ups(self, bucket: int, tables: np.ndarray):
        """A guest word's tables by class, for its home."""
        guest = ~self.own[self.parent_w]
        if not guest.any():
            return []
        n, w, k = self.by_class(tables)[guest], self.word[self.parent_w[guest]], self.parent_kind[guest]
        order = np.lexsort((k, w, home(w)))
        n, w, k = n[order], w[order], k[order]
        owner = home(w)
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        return [(int(owner[s]), -1, bucket, "up", pack(planes(w[s:e]), k[s:e].astype(np.uint8), planes(n[s:e]))) for s, e in zip(edge[:-1], edge[1:])]


class _Parents:
    """The seating of a range's own words in the class restaurants and in the root."""

    def __init__(self, one: _Range, rows, state):
        mine = np.flatnonzero(one.own[one.parent_w])
        words, kinds = [one.word[one.parent_w[mine]]], [one.parent_kind[mine]]
        ups = [(numbers(w, _U64), k.astype(np.int64), numbers(n)) for _, (w, k, n) in _kind(rows, "up")]
        # A word whose dishes are all in guest parts is seated here too. Guests tell all their (word, class) each time.
        self.word, w = np.unique(np.concatenate(words + [u[0] for u in ups]), return_inverse=True)
        key, place = np.unique(w * CLASSES + np.concatenate(kinds + [u[1] for u in ups]), return_inverse=True)
        self.w, self.kind = np.divmod(key, CLASSES)
        self.mine, self.place = mine, place[: len(mine)]
        self.up = np.bincount(place[len(mine) :], np.concatenate([u[2] for u in ups]) if ups else None, len(key)).astype(np.int64)
        if state:
            self.customers, self.count, self.root_customers, self.root_count = map(numbers, state)
        else:
            # At first every dish has one table, as in the first totals.
            self.customers = self.wanted(one.by_class(np.minimum(one.count, 1)))
            self.count = np.minimum(self.customers, 1)
            self.root_customers = self.below_root()
            self.root_count = np.minimum(self.root_customers, 1)

    def wanted(self, tables: np.ndarray) -> np.ndarray:
        """Customers of each class's dishes: the tables below, those of the range and those that guests told."""
        out = self.up.copy()
        np.add.at(out, self.place, tables[self.mine])
        return out

    def below_root(self) -> np.ndarray:
        return np.bincount(self.w, self.count, len(self.word)).astype(np.int64)

    def values(self, g: dict) -> np.ndarray:
        return class_value(self.customers, self.count, self.kind, root_value(self.root_customers, self.root_count, g)[self.w], g)

    def sweep(self, tables: np.ndarray, g: dict, sample: int) -> None:
        """Tables below are customers of the classes, whose tables are customers of the root; each dish is seated anew."""
        below = root_value(self.root_customers, self.root_count, g)[self.w]
        chance = uniform(mix64(self.word[self.w] + self.kind.astype(_U64)), sample)
        self.customers = self.wanted(tables)
        self.count = drawn(self.customers, others(g["a"][1][self.kind], g["d"][1], g["t2"][self.kind], self.count), below, g["d"][1], chance)
        self.root_customers, base = self.below_root(), np.full(len(self.word), 1 / (g["V"] + 1))
        self.root_count = drawn(self.root_customers, others(g["a"][0], g["d"][0], g["t1"], self.root_count), base, g["d"][0], uniform(mix64(self.word), sample))

    def told(self, words: np.ndarray, bucket: int, ranges: int, hot: int):
        """Hot words' seats in the root and by class, for the ranges of their other parts."""
        out: dict[int, list] = {}
        c, root_c = self.customers, self.root_customers
        parts = parts_of(words, hot)[(self.word & _U64(0xFFFFFFFF)).astype(np.int64)] if len(self.word) else np.zeros(0, np.int64)
        for w in np.flatnonzero(parts > 1):
            row, at = np.zeros((2, 1 + CLASSES)), np.flatnonzero(self.w == w)
            row[:, 0] = root_c[w], self.root_count[w]
            row[:, 1 + self.kind[at]] = c[at], self.count[at]
            for b in set(part_range(np.repeat(self.word[w], parts[w] - 1), np.arange(1, parts[w]), ranges).tolist()):
                out.setdefault(b, []).append((self.word[w], row.ravel()))
        return [(b, -1, bucket, "down", pack(planes(np.array([x for x, _ in r], _U64)), np.concatenate([y for _, y in r]))) for b, r in sorted(out.items())]


def others(strength, discount: float, total, own) -> np.ndarray:
    """A restaurant's strength and the discounts of its tables that are not the dish's own."""
    return strength + discount * np.maximum(total - own, 0)


def root_value(c, t, g):
    return (np.maximum(c - g["d"][0] * t, 0.0) + (g["a"][0] + g["d"][0] * g["t1"]) / (g["V"] + 1)) / (g["a"][0] + g["c1"])


def class_value(c, t, kind, below, g):
    a = g["a"][1][kind]
    return (np.maximum(c - g["d"][1] * t, 0.0) + (a + g["d"][1] * g["t2"][kind]) * below) / (a + g["c2"][kind])


def language_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, per_token: bool = False, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score[, token_scores]) per document.

    Tokens are lower-cased words and an end. Each previous word is a restaurant whose customers are the words that followed it in
    training texts; its parent is the restaurant of the word's ending, the parent of those is the root, and the root's base is
    uniform over the known words and one unknown. From one table a dish, each sweep seats all customers of every dish again (blocked
    Gibbs: the number of tables is drawn from its exact conditional), given the parents and totals of the sweep before; tables
    are customers of the parent. Predictive probabilities of the sweeps are averaged; discounts follow the counts of counts,
    strengths the expectation of their Gamma posterior.

    A dish lives in the range of its word, as do its parents, so only totals of contexts travel: each range tells them once per distinct
    context to that word's range, which answers. Dishes of a word of `hot` and more training tokens are split by context over ranges. Words
    are named by 64-bit hashes. Null texts are just an end; a null doc_id counts as the empty text in the fold; repeated rows
    count and are scored each; without training texts every token has probability 1; an empty table gives an empty result.
    """
    chunks = tokenized(docs, id_col, text_col, folds, held, chunk_bytes)
    # Ranges follow the volume of text, not the session's partitions: what a range holds is bounded, whatever the cluster's settings.
    ranges = max(8, -(-int(chunks.agg(F.sum("bytes")).first()[0] or 0) // range_bytes))

    def send_types(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, train = unpack(data)
                train = numbers(train, np.uint32)
                yield from _rows([(b, chunk, -1, "types", pack(hashes[s:e], planes(train[s:e]))) for b, s, e in cuts(hashes, ranges)]).to_batches()

    def vocabulary(bucket, rows):
        sent = [(r[1], *unpack(r[3])) for r in rows]
        words = np.unique(np.concatenate([s[1] for s in sent]))
        total, at = np.zeros(len(words), np.int64), []
        for _, own, train in sent:
            at.append(np.searchsorted(words, own))
            total[at[-1]] += numbers(train, np.uint32)
        out = [(-1, s[0], bucket, "types", pack(planes(np.diff(a, prepend=0).astype(np.uint32)), planes(total[a]))) for s, a in zip(sent, at)]
        return [*out, (bucket, -1, bucket, "words", pack(planes(total))), (-1, -1, bucket, "stat", None, [total.sum(), (total > 0).sum()])]

    types = chunks.where("kind = 'types'").select("chunk", "data")
    vocab = stored(_step(types.mapInArrow(send_types, _MESSAGE), vocabulary), "vocabulary", ("kind",), True)
    discard(chunks, part="/kind=types")
    n, v = _sums(vocab, 2)
    told_types = vocab.where("kind = 'types'").groupBy("chunk").agg(F.collect_list(F.struct("src", "data")).alias("told"))
    named = chunks.where("kind = 'tokens'").join(told_types, "chunk").select("chunk", "meta", "data", F.col("told.src").alias("src"), F.col("told.data").alias("told"))

    def send_pairs(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one chunk at a time
                chunk, *data = (batch.column(c)[row].as_py() for c in range(5))
                for b, message in _Pairs(*data, ranges, hot).messages():
                    yield from _rows([(b, chunk, -1, "pairs", message)]).to_batches()

    def count(bucket, rows):
        sent = []
        for _, chunk, _, data in rows:
            w, degree, u, c = unpack(data)
            sent.append((chunk, np.repeat(numbers(w, _U64), numbers(degree)), numbers(u, _U64), numbers(c, np.uint32)))
        w, u, c = (np.concatenate(x) for x in zip(*[s[1:] for s in sent]))
        words, w = np.unique(w, return_inverse=True)
        asked, u = np.unique(u, return_inverse=True)
        order = np.argsort(w * len(asked) + u, kind="stable")
        new = np.concatenate(([True], (w[order][1:] != w[order][:-1]) | (u[order][1:] != u[order][:-1])))
        back = np.empty(len(w), np.int64)
        back[order] = np.cumsum(new) - 1
        total = np.bincount(back, c, int(new.sum())).astype(np.int64)
        w, u = w[order][new], u[order][new]
        out, at = [], 0
        for chunk, own, *_ in sent:
            out.append((bucket, chunk, bucket, "members", pack(planes(np.diff(back[at : at + len(own)], prepend=0).astype(np.uint32)))))
            at += len(own)
        data = [planes(words), planes(np.bincount(w, minlength=len(words))), planes(u.astype(np.uint32)), planes(total), planes(asked)]
        one = _Range(data, bucket)
        tables = np.minimum(total, 1)
        by_class = one.by_class(tables)
        stat = [len(total), (total == 1).sum(), (total == 2).sum(), (by_class == 1).sum(), (by_class == 2).sum()]
        classes = np.bincount(one.parent_w, by_class > 0, len(words))
        stat += [(classes == 1).sum(), (classes == 2).sum(), classes.sum(), (classes > 0).sum()]
        stat += [*np.bincount(one.parent_kind, by_class, CLASSES), *np.bincount(one.parent_kind, by_class > 0, CLASSES)]
        out += [(bucket, -1, bucket, "dishes", pack(*data)), (-1, -1, bucket, "stat", None, [float(x) for x in stat])]
        return [*out, *one.asks(bucket, tables), *one.ups(bucket, tables)]

    met = stored(_step(named.mapInArrow(send_pairs, _MESSAGE), count), "counts", ("kind",), True)
    sums = _sums(met, 9 + 2 * CLASSES)
    g = {"N": int(n), "V": int(v), "d": [_discount(sums[5], sums[6]), _discount(sums[3], sums[4]), _discount(sums[1], sums[2])], "a": [1.0, np.ones(CLASSES), 1.0]}
    g |= {"c1": sums[7], "t1": sums[8], "c2": sums[9 : 9 + CLASSES], "t2": sums[9 + CLASSES :]}

    def totals(g: dict):
        def act(bucket, rows):
            words = _kind(rows, "words")
            customers = numbers(words[0][1][0])
            tables, asks = np.zeros(len(customers), np.int64), []
            for src, (at, n) in _kind(rows, "asks"):
                at = numbers(at, np.uint32)
                tables[at] += numbers(n)
                asks.append((src, at))
            opened, closed = strength_terms(customers[tables > 0], tables[tables > 0], g["a"][2], g["d"][2])
            out = [(src, -1, bucket, "told", pack(planes(customers[at]), planes(tables[at]))) for src, at in asks]
            return [*out, (-1, -1, bucket, "stat", None, [float(opened.sum()), float(closed.sum())])]

        return act

    def values(one: _Range, parents: _Parents, rows, g: dict) -> np.ndarray:
        """The predictive probability of each parent (word, class) of the range's dishes: its own words' and, as their homes say, guests'."""
        out = np.zeros(len(one.parent_w))
        out[parents.mine] = parents.values(g)[parents.place]
        guest = np.flatnonzero(~one.own[one.parent_w])
        if len(guest):
            w, data = (np.concatenate(x) for x in zip(*[(numbers(d[0], _U64), d[1].reshape(-1, 2, 1 + CLASSES)) for _, d in _kind(rows, "down")]))
            by = np.argsort(w, kind="stable")
            row = data[by][np.searchsorted(w[by], one.word[one.parent_w[guest]])]
            kind, each = one.parent_kind[guest], np.arange(len(guest))
            out[guest] = class_value(row[each, 0, 1 + kind], row[each, 1, 1 + kind], kind, root_value(row[:, 0, 0], row[:, 1, 0], g), g)
        return out

    def seat(sample: int, g: dict):
        """Adds the predictive probabilities of the sweep before, with its totals, and sweeps again; after the last one, answers."""

        def act(bucket, rows):
            dishes, state, counts = (_kind(rows, k) for k in ("dishes", "state", "words"))
            one = _Range(dishes[0][1] if dishes else None, bucket)
            customers, tables = one.told(rows)
            state = state[0][1] if state else None
            parents = _Parents(one, rows, state[1:5] if state else None)
            (d, a), total, t, on = (g["d"][2], g["a"][2]), tables[one.place], np.minimum(one.count, 1), one.dish
            if state is None:
                c = one.by_class(t)
                classes = np.bincount(one.parent_w, c > 0, len(one.word))
                base = class_value(c, c > 0, one.parent_kind, root_value(classes, classes > 0, g)[one.parent_w], g)[one.parent]
                sums = np.zeros(len(one.count))
            else:
                t[on] = numbers(state[0])
                base = values(one, parents, rows, g)[one.parent]
                sums = numbers(state[5], np.float32) + (np.maximum(one.count - d * t, 0.0) + (a + d * total) * base) / (a + customers[one.place])
            if sample > SAMPLES:
                p = (sums / SAMPLES).astype(np.float32)
                asked = [(r[1], np.cumsum(numbers(unpack(r[3])[0], np.uint32).astype(np.int64))) for r in rows if r[0] == "members"]
                return [(-1, chunk, bucket, "answer", pack(planes(p[at]))) for chunk, at in asked]
            chance = uniform(mix64(mix64(one.word[one.w[on]]) ^ one.asked[one.place[on]]), sample)
            t[on] = drawn(one.count[on], others(a, d, total[on], t[on]), base[on], d, chance)
            parents.sweep(one.by_class(t), g, sample)
            seats = [t[on], parents.customers, parents.count, parents.root_customers, parents.root_count]
            stat = [parents.root_customers.sum(), parents.root_count.sum(), *np.bincount(parents.kind, parents.customers, CLASSES), *np.bincount(parents.kind, parents.count, CLASSES)]
            out = [(bucket, -1, bucket, "state", pack(*map(planes, seats), planes(sums.astype(np.float32)))), (-1, -1, bucket, "stat", None, [float(x) for x in stat])]
            down = parents.told(numbers(counts[0][1][0]), bucket, ranges, hot) if counts else []
            return [*out, *one.asks(bucket, t), *one.ups(bucket, t), *down]

        return act

    words = vocab.where("kind = 'words'")
    static, said = met.where("kind = 'dishes'"), met
    for sample in range(1, SAMPLES + 2):
        told = stored(_step(words.unionByName(said.where("kind = 'asks'")), totals(g)), "totals", ("kind",), True)
        heard = static.unionByName(words).unionByName(told.where("kind = 'told'")).unionByName(said.where("kind IN ('state', 'up', 'down')"))
        if sample > SAMPLES:
            answers = stored(_step(heard.unionByName(met.where("kind = 'members'")), seat(sample, g)).select("chunk", "src", "data"), "answers", tidy=True)
            discard(met, said, told)
            break
        before, said = said, stored(_step(heard, seat(sample, g)), "seats", ("kind",), True)
        s = _sums(said, 2 + 2 * CLASSES)
        g = g | {"c1": s[0], "t1": s[1], "c2": s[2 : 2 + CLASSES], "t2": s[2 + CLASSES :]}
        terms = strength_terms(s[:1], s[1:2], g["a"][0], g["d"][0]), strength_terms(g["c2"], g["t2"], g["a"][1], g["d"][1]), _sums(told, 2)
        g["a"] = [(1 + opened) / (1 + closed) for opened, closed in terms]
        discard(told, *([] if before is met else [before]))

    def finish(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                _, *data, sources, replies = (batch.column(c)[row].as_py() for c in range(7))
                p = _Pairs(*data, ranges, hot)
                value = np.empty(len(p.order))
                value[p.order] = np.concatenate([numbers(unpack(a)[0], np.float32) for _, a in sorted(zip(sources, replies))])
                score, edge = np.log10(value)[p.pair], np.cumsum(p.counts) - p.counts
                base = np.log10((p.total + 1.0) / (int(n) + int(v) + 1))[p.token]
                ids = pa.array([None if d == NO_ID else d for d in p.ids.tolist()], pa.int64())
                known = np.add.reduceat((p.total > 0)[p.token].astype(np.int64), edge)
                cols = [ids, pa.array(p.out.astype(bool)), pa.array(p.counts), pa.array(known), pa.array(np.full(len(p.ids), int(n))), pa.array(np.add.reduceat(base, edge)), pa.array(np.add.reduceat(score, edge))]
                if per_token:
                    cols.append(pa.array(np.split(score, edge[1:]), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double" + ", token_scores array<double>" * per_token
    names = [c.split()[0] for c in schema.split(", ")]
    listed = answers.groupBy("chunk").agg(F.collect_list(F.struct("src", "data")).alias("answers"))
    asked = named.join(listed, "chunk").select(*named.columns, F.col("answers.src").alias("by"), F.col("answers.data").alias("answer"))
    return asked.mapInArrow(finish, schema)

