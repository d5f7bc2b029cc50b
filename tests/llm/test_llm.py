"""The corpus operators against brute force, over nulls, empty and repeated rows, ties, clashing columns and empty tables."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vantor.llm import embed, media, mixing, packing, pii, pitman, quality, seating, simhash, suffixes, windows
from vantor.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, chunk int"


def table(spark, rows):
    """Rows (doc_id, text[, source]) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", 1) for r in rows], SCHEMA).repartition(3)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "é", "d", "omega-3", "x1", "THE"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), f"s{i % 3}") for i in range(n)]
    base = " ".join(rng.choice(words) + str(i) for i in range(80))
    out += [(100 + i, base + f" end{i}", "s0") for i in range(15)] + [(200 + i, base, None) for i in range(5)]
    return out + [(300, None, "s1"), (301, "", "s1"), (None, base, "s2"), (7, out[7][1], out[7][2]), (302, "one", "\U0001f600"), (303, " \t\n", "s1")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words_of(text):
    return (text or "").encode().split()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 30)]
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got.get(v, v) == m for v, m in label.items())


def brute_fingerprint(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    data = corpus()
    got = simhash.simhash_groups(table(spark, data)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in data]
    assert sorted(r.fingerprint for r in got) == sorted(f"{f:016x}" for f in fps)
    group = list(range(len(data)))
    for _ in range(len(data)):
        for i in range(len(data)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = collections.defaultdict(list)
    for g, (i, _, _) in zip(group, data):
        least[g].append(i)
    want = sorted((repr(i), min((x for x in least[g] if x is not None), default=None)) for g, (i, _, _) in zip(group, data))
    assert sorted((repr(r.doc_id), r.component_id) for r in got) == want
    assert simhash.simhash_groups(table(spark, data[:0])).count() == 0


def test_multi_index_finds_all_links(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for d in range(1, 7):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), d)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 4}
    for segments in (2, 3, 4, 5):
        assert {tuple(r) for r in simhash.multi_index_links(df, 4, segments).collect()} == want


def test_keys_grow_with_the_table():
    assert [simhash.segments_for(n, 4) for n in (1000, 235_748, 10**9)] == [5, 3, 2]
    assert all(a >= b for a, b in zip(*(lambda s: (s, s[1:]))([simhash.segments_for(10**k, 4) for k in range(12)])))


@pytest.mark.parametrize("clash", [False, True])
def test_deduplicated_keeps_one_of_each_group(spark, clash):
    data = corpus()
    df = table(spark, data)
    if clash:
        df = df.withColumns({"_fp": F.lit("x"), "_root": F.lit(1), "_best": F.lit(None).cast("long")})
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    groups = simhash.simhash_groups(df).select("component_id").distinct().count()
    assert out.count() == groups


def near_copies():
    """Documents with planted copies of one to a few edited words, copies of these, and short, empty and repeated texts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    data = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice((12, 60, 150, 400)))]
        data.append((k * 10, " ".join(base)))
        for j in range(rng.randint(0, 4)):
            if rng.random() < 0.3:
                base = list(base)
            copy = base if rng.random() < 0.3 else list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 50))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            data.append((k * 10 + j + 1, " ".join(copy).title()))
    hot = [rng.choice(words) for _ in range(200)]
    data += [(1000 + i, " ".join(hot[:i] + [f"x{i}"] + hot[i + 1 :])) for i in range(80)]
    return data + [(2000, None), (2001, ""), (2002, "one two"), (2003, "one  TWO"), (2004, "one two three"), (None, data[0][1]), (None, "alone"), (10, data[10][1])]


@pytest.mark.parametrize("part_bytes", [1 << 22, 3000])
def test_near_deduplicated_against_all_pairs(spark, part_bytes):
    """With small parts, groups are joined by their heads, and what stays apart is compared part by part."""
    data = near_copies()
    sets = []
    for _, t in data:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(data)))
    pairs = [(i, j) for i in range(len(data)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = group[i], group[j]
        group = [b if g == a else g for g in group]
    members = collections.defaultdict(list)
    for g, (key, _) in zip(group, data):
        members[g].append((key is None, key))
    want = sorted((min(m) for m in members.values()), key=repr)
    df = table(spark, data)
    out = simhash.near_deduplicated(df, part_bytes=part_bytes)
    assert out.columns == df.columns
    assert sorted(((r.doc_id is None, r.doc_id) for r in out.collect()), key=repr) == want
    assert simhash.near_deduplicated(table(spark, [])).count() == 0


def test_intersections_against_sets():
    rng = np.random.default_rng(5)
    make = lambda n: [np.unique(rng.choice(np.array([*range(40), *range(1000, 1000 + 50 * n)], np.uint64), rng.integers(0, 60))) for _ in range(n)]
    for a, b in ((make(70), make(90)), (make(3), make(1)), (make(2), []), ([np.zeros(0, np.uint64)], make(4))):
        got = simhash.intersections(a, b)
        assert got.shape == (len(a), len(b)) and all(got[i, j] == len(set(x.tolist()) & set(y.tolist())) for i, x in enumerate(a) for j, y in enumerate(b))


def test_links_between_parts_join_groups_of_different_heads(spark):
    """A chain of sets, each similar to the next alone, over many parts; and sets that only share a component."""
    sets = [(1, i, np.arange(20 * i, 20 * i + 400, dtype="<u8").tobytes()) for i in range(60)] + [(2, 1000 + i, np.arange(300 * i, 300 * i + 400, dtype="<u8").tobytes()) for i in range(30)]
    df = spark.createDataFrame(sets, "component long, node long, hashes binary").repartition(5)
    got = {r.node: r.head for r in simhash.verified_groups(df, 0.8, part_bytes=8000).collect()}
    assert all(got.get(i, i) == 0 for i in range(60)) and all(got.get(i, i) == i for i in range(1000, 1030))


def test_pipeline_drops_planted_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(5)
    data = []
    for k in range(50):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        data.append((k, " ".join(words)))
        words[rng.randrange(150)] = "edited"
        data.append((1000 + k, " ".join(words)))
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, table(spark, data), "").collect()} == set(range(50))


def brute_bytes(texts, n):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        cut = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                cut[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(t)) if cut[i] and (i == 0 or not cut[i - 1]))
        out.append((len(t), sum(cut), runs, hashlib.sha256(bytes(c for c, x in zip(t, cut) if not x)).hexdigest()))
    return out


def shifted(n=30):
    """Documents that share long passages, cut and continued at different places, so that anchors have many contexts."""
    rng = random.Random(8)
    line = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, other = line(1500), line(450)
    out = []
    for i in range(n):
        a = rng.randint(0, 500)
        out.append((800 + i, line(rng.randint(0, 60)) + passage[a : a + rng.randint(380, 900)] + line(20) + (other if i % 3 else other[: 390 + i]) + line(5)))
    return out + [(900, "y" * 1300), (901, passage), (902, passage + passage)]


@pytest.mark.parametrize(("length", "group", "block"), [(24, 2000, 1 << 20), (24, 3, 100), (400, 2000, 1 << 20), (400, 2000, 200), (400, 4, 300)])
def test_suffixes(spark, length, group, block):
    """Whole groups, suffix blocks of a few, and groups that are split down to single strings all give the brute-force result."""
    data = corpus() + [(400 + i, "ab" * i) for i in range(0, 40, 3)] + [(500, "x" * 90), (501, "é" * 40)] + shifted()
    want = sorted(((d[0], *b) for d, b in zip(data, brute_bytes([(d[1] or "").encode() for d in data], length))), key=repr)
    assert rows_of(suffixes.remove_repeats(table(spark, data), length=length, group_rows=group, block_suffixes=block)) == want


def test_suffixes_of_an_empty_table(spark):
    assert suffixes.remove_repeats(table(spark, []), length=24).count() == 0


def test_pieces_hold_each_string_once():
    rng = random.Random(6)
    for _ in range(200):
        length, strings = rng.randint(16, 40), rng.randint(1, 50)
        data, width = bytes(rng.choices(b"ab", k=length + strings - 1)), rng.choice((1, 4, 13))
        parts = suffixes.pieces(data, rng.randint(strings - 1, strings + 8), length, width)
        assert sorted(k for a, n, *_ in parts for k in range(a, a + n)) == list(range(strings))


def test_suffix_blocks_are_sorted():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(0, 2, 400), np.tile([1, 0, 1], 60), rng.integers(0, 2, 100), np.zeros(80)]).astype(np.uint8)
    got = np.concatenate(list(suffixes.sorted_blocks(text, np.arange(len(text) - 80), 64, 50)))
    raw = text.tobytes()
    keys = [raw[i : i + 64] for i in got]
    assert sorted(got.tolist()) == list(range(len(text) - 80)) and keys == sorted(keys)


def test_shift_table():
    assert all((i + suffixes.SHIFT[i, j]) % 16 in suffixes.COVER and (j + suffixes.SHIFT[i, j]) % 16 in suffixes.COVER for i in range(16) for j in range(16))


def brute_windows(data, n):
    far = 1 << 62
    least = {}
    for i, t, *_ in data:
        w = words_of(t)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            least[k] = min(least.get(k, far), far if i is None else i)
    out = []
    for i, t, *_ in data:
        w = words_of(t)
        cut = [False] * len(w)
        for s in range(len(w) - n + 1):
            if least[tuple(w[s : s + n])] < (far if i is None else i):
                cut[s : s + n] = [True] * n
        out.append((i, len(w), sum(cut), hashlib.sha256(b" ".join(x for x, c in zip(w, cut) if not c)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (4, 2), (3, 2)])
def test_windows(spark, batches, fanout, monkeypatch):
    made = []
    monkeypatch.setattr(windows, "WindowIndex", lambda *a, cls=windows.WindowIndex: made.append(cls(*a)) or made[0])
    data = corpus()
    assert rows_of(windows.remove_windows(table(spark, data), length=7, batches=batches, fanout=fanout)) == brute_windows(data, 7)
    assert made[0].compactions == max(0, batches - 2)


def test_windows_are_verified_by_their_words(spark, monkeypatch):
    """With fingerprints that all collide, only the words tell windows apart."""
    data = [(1, "a b c d e f g h"), (2, "h g f e d c b a"), (3, "x b c d e f g y"), (4, None)]
    index = windows.WindowIndex(3)
    real = windows._Chunk.__init__

    def collide(self, data, length):
        real(self, data, length)
        self.value = np.zeros_like(self.value)
        self.keys, self.inverse, self.times = np.unique(self.value, return_inverse=True, return_counts=True)

    monkeypatch.setattr(windows._Chunk, "__init__", collide)
    chunk = windows._Chunk(windows.pack(np.array([1, 2, 3]), np.array([15, 15, 15]), np.frombuffer("".join(t for _, t in data[:3]).encode(), np.uint8)), 3)
    found = chunk.contexts(np.ones(1, bool), True, 8)
    assert sum(found.windows) == len({w for w in found.words for w in [w]}) or found.words
    monkeypatch.undo()
    assert rows_of(index.add(table(spark, data))) == brute_windows(data, 3)


def test_windows_make_no_python_call_per_word():
    """Python calls follow the contexts that are sent, not the words of a chunk."""
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % w for w in rng.integers(0, 1 << 40, 2000)) for _ in range(10)]
    data = windows.pack(np.arange(10), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        chunk = windows._Chunk(data, 13)
        chunk.contexts(np.zeros(len(chunk.keys), bool), True, 8)
    finally:
        sys.setprofile(None)
    assert len(chunk.symbols) == 20_000 and calls < 2000


def test_words_and_windows_are_told_by_their_bytes():
    rng = random.Random(5)
    texts = [b"", b" \t\n", b"end", b"end end\x00 \x00end", "\u00e9\u3000x \x1cy".encode(), b"\x0b\x0c\r"]
    texts += [b"".join(rng.choice((b"a", b"ab", b"q" * 9, b"x" * 64, b"x" * 65, b"x" * 64 + b"y", b"z" * 700, b"z" * 699 + b"y", b" ", b"\t")) + rng.choice((b" ", b"\n ", b"")) for _ in range(60)) for _ in range(12)]
    data = windows.pack(np.arange(len(texts)), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
    chunk = windows._Chunk(data, 3)
    words = [t.split() for t in texts]
    flat = [w for doc in words for w in doc]
    assert chunk.counts.tolist() == [len(w) for w in words]
    assert [chunk.text[s:e].tobytes() for s, e in zip(chunk.starts, chunk.ends)] == flat
    assert len(set(zip(chunk.symbols.tolist(), flat))) == len(set(flat)) == len(set(chunk.symbols.tolist()))
    keep = np.array([rng.random() < 0.5 for _ in flat])
    text, starts, ends = chunk.joined(keep)
    assert text.tobytes() == b"".join(w + b" " for w, k in zip(flat, keep) if k)
    text, starts, ends = chunk.joined(keep | True)
    at = np.arange(len(flat) - 2)
    keys = [tuple(flat[i : i + 3]) for i in at]
    # With good values, and with values that say nothing, or too little.
    for value in (windows.rolling(chunk.symbols, 3), np.zeros(len(at), np.uint64), (ends[at + 2] - starts[at]).astype(np.uint64)):
        place = windows.places(text, starts[at], ends[at + 2], value)
        assert len(set(place.tolist())) == len(set(keys)) == len(set(zip(place.tolist(), keys))) == place.max() + 1


def test_windows_of_an_empty_table(spark):
    assert windows.remove_windows(table(spark, []), length=7).count() == 0


def test_mixing(spark):
    data = corpus(n=300)
    got = mixing.mix(table(spark, data)).collect()
    per = collections.defaultdict(list)
    for r in got:
        per[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(len(words_of(t)) for _, t, _ in data)
    assert sum(r[0].target for r in per.values()) == pytest.approx(1.5 * total)
    for rs in per.values():
        assert sum(r.size for r in rs) == rs[0].source_size and rs[0].target <= 2 * rs[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 5  # less than a word for each row that shares the last turn
    order = sorted((s for s in per if s is not None)) + [None]
    free = [(s, (3, 1, 2)[i % 3]) for i, s in enumerate(order) if per[s][0].target < 2 * per[s][0].source_size - 1e-6]
    assert len({round(per[s][0].target / w, 6) for s, w in free}) <= 1
    assert rows_of(mixing.mix(table(spark, data))) == sorted((tuple(r) for r in got), key=repr)
    assert mixing.mix(table(spark, [])).count() == 0


def test_mixing_rates_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(9)
    data = [(i, "w " * rng.randint(1, 3000), f"s{i % 3}") for i in range(900)]
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 3, 8, 17):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted((r.doc_id, r.rate, r.taken) for r in mixing.mix(table(spark, data)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(g == got[0] for g in got)


def test_rates_are_tilted_by_size(spark):
    """Within a source log(rate) is in proportion to the size until the cap, and the words meet the target: the solution of the dual, and no other is nearer."""
    rng = random.Random(3)
    data = [(i, "w " * rng.randint(1, 200), f"s{i % 5}") for i in range(400)]
    per = collections.defaultdict(list)
    for r in mixing.mix(table(spark, data), weights=(5.0, 1.0, 0.5, 0.25, 2.0)).collect():
        per[r.source].append(r)
    for rs in per.values():
        assert sum(r.size * r.rate for r in rs) == pytest.approx(rs[0].target, rel=1e-7)
        free = [r for r in rs if r.rate < 2 - 1e-9]
        if free:
            lam = [math.log(r.rate) / r.size for r in free]
            assert max(lam) - min(lam) < 1e-8 + 1e-5 * abs(lam[0]) and len({round(r.rate, 9) for r in rs}) > 5
            assert all(lam[0] * r.size >= math.log(2) - 1e-6 for r in rs if r.rate >= 2 - 1e-9)


def test_a_dual_that_does_not_converge_is_an_error(spark):
    units = mixing.sizes_of(table(spark, [(i, "w " * (i + 1), f"s{i % 4}") for i in range(40)]))
    with pytest.raises(RuntimeError, match="converge"):
        mixing.tilts(units, mixing.source_targets(units), max_rounds=1)


@pytest.mark.parametrize("clash", [False, True])
def test_mixed_rows_follow_the_plan(spark, clash):
    """Null and repeated ids, null and empty texts, null sources, columns that are called like the operator's own."""
    df = table(spark, corpus(n=100))
    if clash:
        df = df.withColumns({c: F.lit("x") for c in ("_row", "_source", "at", "size", "taken", "copy", "left", "rate", "target", "whole", "turn", "cut", "n")})
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want, got = collections.Counter(), collections.Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source] += r.taken
    for r in out.collect():
        got[r.doc_id, r.source] += len(words_of(r.text))
        assert r.n_chars in (0, len(r.text))
    assert got == +want and mixing.mixed(df.limit(0)).count() == 0


def brute_personal(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(out)]


def test_personal_data(spark):
    texts = [None, "", "a@@b.c x@y.z@w.q.r", "..@a.b-.c a@b..c a@b.c@d.e.f", "+12 345 678 9012 1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111 é 4111111111111111", "call +1 (988) 555-2485 4524132264652876"]
    rng = random.Random(5)
    texts += ["".join(rng.choice("a1.@+ -()9é") for _ in range(80)) for _ in range(300)]
    texts += [f"mail jo.doe{i}@mail.example.com then jo.doe{i} and 10.0.0.{i}" for i in range(40)]
    got = {r.doc_id: r for r in pii.personal_data(table(spark, list(enumerate(texts)) + [(None, "x")])).collect()}
    for i, t in enumerate(texts):
        base = brute_personal(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x == k for _, x, _ in base) for k in pii.KINDS]
        spans = [tuple(s.split(":")) for s in got[i].spans.split(",") if s]
        kept = {(k, str(s), str(e)) for s, k, e in base}
        assert got[i].n_spans == len(spans)
        assert kept <= set(spans) and all(0 <= int(s) < int(e) <= len(t or "") for _, s, e in spans)
        assert not any(int(s) < b and a < int(e) for k, s, e in set(spans) - kept for a, _, b in base)
    assert pii.personal_data(table(spark, [])).count() == 0


def test_redaction_of_empty_and_repeated_rows(spark):
    rows = [(None, "ip 10.0.0.1"), (1, ""), (1, ""), (2, "x a@b.cd"), (2, "x a@b.cd")]
    assert sorted((r.doc_id is None, r.text) for r in pii.redacted(table(spark, rows)).collect()) == [(False, ""), (False, ""), (False, "x [EMAIL]"), (False, "x [EMAIL]"), (True, "ip [IP]")]
    assert pii.redacted(table(spark, [])).count() == 0


def test_redaction(spark):
    df = table(spark, [(1, "mail a.b@c.de now"), (2, None), (3, "clean")])
    got = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean" and pii.redacted(df).columns == df.columns


def test_the_field_examines_documents_without_base_spans(spark):
    rows = [(i, f"call +1 (988) 555-24{i:02d} at once, order {i}") for i in range(60)]
    odd = {100: "ring (988) 555-2485 or (988) 555-2485 now", 101: "version 2 of 2024", 102: "plain words", 103: None}
    df = table(spark, rows + list(odd.items()))
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert not pii.base_spans(odd[100]) and got[100].n_phone == 0
    assert got[100].spans == "phone:6:19,phone:24:37" and not got[102].spans and not got[103].spans
    assert {r.doc_id: r.text for r in pii.redacted(df).collect()}[100] == "ring ([PHONE] or ([PHONE] now"


def test_the_fitting_sample_holds_base_spans(spark):
    rows = [(i, f"about 12345 and {i}") for i in range(200)] + [(300 + i, f"host 10.0.0.{i} is up") for i in range(3)]
    assert pii.fit(table(spark, rows), fit_docs=2) is not None


def test_beliefs_by_enumeration():
    """On a graph without cycles the messages give the exact marginals; known labels are clamped."""
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(5, pii.FEATURES)), np.array([0, 0, 2, 0, 0])
    graph = {"x": x, "label": label, "chain": [(0, 1), (1, 2)], "skip": [(0, 3), (2, 4)]}
    model = {"w": rng.normal(size=(pii.FEATURES, 5)) * 0.3, "chain": rng.normal(size=(5, 5))}
    skip = rng.normal(size=(5, 5))
    model["skip"] = skip + skip.T
    want, unary = np.zeros((5, 5)), x @ model["w"]
    for ys in itertools.product(range(5), repeat=5):
        if ys[2] == 2:
            p = math.exp(sum(unary[i, k] for i, k in enumerate(ys)) + sum(model[e][ys[a], ys[b]] for e in ("chain", "skip") for a, b in graph[e]))
            want[range(5), ys] += p
    assert np.allclose(pii.believe([graph, graph], model)[1], want / want.sum(1, keepdims=True), atol=2e-3)


def test_only_the_skip_edge_finds_the_second_token():
    text = "mail jo.doe17@mail.example.com or jo.doe17 and jo.doe99"
    base = pii.base_spans(text)
    graph = pii.graph_of(text, base)
    model = {"w": np.zeros((pii.FEATURES, 5)), "chain": np.zeros((5, 5)), "skip": np.eye(5) * 4}
    model["w"][0, 0] = 1.0
    assert pii.added_spans(text, base, graph, pii.believe([graph], model)[0]) == [(34, "email", 42)]
    assert pii.added_spans(text, base, graph, pii.believe([graph], model | {"skip": np.zeros((5, 5))})[0]) == []


def test_the_fit_climbs_the_pseudo_likelihood():
    """At the fitted weights no direction raises the objective: its slope, by differences, is nought."""
    texts = [f"mail jo{i}.doe@mail.example.com or jo{i}.doe at 10.0.0.{i} with 12345 items, call +1 (988) 555-24{i:02d}" for i in range(20)]
    graphs = [pii.graph_of(t, pii.base_spans(t)) for t in texts]
    fitted = pii.fit_weights(graphs, rounds=20000)

    def objective(m):
        prior = {"w": 0, "chain": 0, "skip": pii.AGREEMENT * np.eye(5)}
        scale = np.maximum(1.0, np.abs(np.vstack([g["x"] for g in graphs])).max(0))[:, None]
        out = -sum((((m[k] * scale if k == "w" else m[k]) - prior[k]) ** 2).sum() for k in m) / 2
        for g in graphs:
            for i, y in enumerate(g["label"]):
                s = g["x"][i] @ m["w"]
                s = s + sum((m["chain"][g["label"][a]] for a, b in g["chain"] if b == i), np.zeros(5)) + sum((m["chain"][:, g["label"][b]] for a, b in g["chain"] if a == i), np.zeros(5))
                s = s + sum((m["skip"][g["label"][b if a == i else a]] for a, b in g["skip"] if i in (a, b)), np.zeros(5))
                out += s[y] - np.log(np.exp(s - s.max()).sum()) - s.max()
        return out

    rng, top = np.random.default_rng(0), objective(fitted)
    for _ in range(6):
        step = {k: rng.normal(size=v.shape) * 1e-3 for k, v in fitted.items()}
        step["skip"] = step["skip"] + step["skip"].T
        for sign in (1, -1):
            assert objective({k: v + sign * step[k] for k, v in fitted.items()}) < top + 1e-5


def test_addresses_in_long_digit_runs_take_linear_time():
    began = time.time()
    assert pii.base_spans("1" * 2_000_000 + ".2 " + "7." * 500_000 + " 1.2.3.4")[-1][1] == "ip"
    assert time.time() - began < 20


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    bad, good = got.score[got.quality == 0], got.score[got.quality == 1]
    assert (bad.to_numpy()[:, None] < good.to_numpy()[None]).mean() > 0.97
    assert (got.predicted[got.quality == 1] == 1).mean() > 0.97


def test_quality_edges(spark):
    data = [(None, None), (1, ""), (2, "x"), (2, "x"), (3, "a\n\n" * 2000)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(table(spark, data), labels).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    assert quality.quality_scores(table(spark, []), labels).count() == 0
    assert quality.accepted(table(spark, data), labels).count() == 5


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    u, t = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        p = math.exp(sum(u[i, y[i]] for i in range(5)) + sum(t[y[i], y[i + 1]] for i in range(4)))
        total += p
        good += p * np.array(y)
    got, z = quality.marginals(u, t)
    assert np.allclose(got, good / total) and z == pytest.approx(math.log(total))
    both, pairs, zs = quality.chain_pass(np.concatenate([[0.3], u[:, 1] - u[:, 0], [-0.2, 1.0]]), np.array([1, 5, 2]), t)
    assert np.allclose(both[1:6], got) and zs[1] + u[:, 0].sum() == pytest.approx(z) and np.allclose(pairs.sum((1, 2)), [0, 4, 1])


def test_the_chain_slopes_are_those_of_its_likelihood():
    rng = np.random.default_rng(1)
    size = np.array([3, 1, 6, 2])
    x, y = rng.normal(size=(12, 4)), rng.integers(0, 2, 12).astype(float)
    w, t = rng.normal(size=4), rng.normal(size=(2, 2))
    _, dw, dt, *_ = quality.likelihood(x, y, size, w, t, 1e-2)
    value = lambda w, t: quality.likelihood(x, y, size, w, t, 1e-2)[0]
    for i in range(4):
        step = np.eye(4)[i] * 1e-5
        assert (value(w + step, t) - value(w - step, t)) / 2e-5 == pytest.approx(dw[i], abs=1e-6)
        step = step.reshape(2, 2)
        assert (value(w, t + step) - value(w, t - step)) / 2e-5 == pytest.approx(dt.ravel()[i], abs=1e-6)
    w, t = quality.climb(x, y, size, w, t, 200, 1e-2)
    _, dw, dt, *_ = quality.likelihood(x, y, size, w, t, 1e-2)
    assert np.abs(dw).max() < 1e-3 and np.abs(dt).max() < 1e-3


def test_scores_come_from_length_weighted_marginals_alone(spark):
    """The query's score against the field's definition, enumerated line labels included."""
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["A clean line of prose, it ends well.", "$$$ !!! buy |||| now", "", "x"]) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    labels = spark.createDataFrame([(i, int("prose" in t and "$$$" not in t)) for i, t in enumerate(texts)], "doc_id long, quality int")
    df = table(spark, list(enumerate(texts)))
    field = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.quality_scores(df, labels).collect()}
    assert np.abs(field["trans"]).max() > 0.05
    for i, t in enumerate(texts):
        f, n = quality.line_features(t.encode())
        s = np.clip((f - field["mean"]) / field["scale"] @ field["unary"], -30, 30)
        good, total = np.zeros(len(s)), 0.0
        for ys in itertools.product((0, 1), repeat=len(s)):
            p = math.exp(sum(a * b for a, b in zip(s, ys)) + sum(field["trans"][a, b] for a, b in zip(ys, ys[1:])) - np.maximum(s, 0).sum())
            good, total = good + p * np.array(ys), total + p
        good, weight = good / total, (n + 1) / (n + 1).sum()
        share, good = np.clip(good @ weight, 1e-4, 1 - 1e-4), np.clip(good, 1e-6, 1 - 1e-6)
        z = np.dot([math.log(share / (1 - share)), np.log(good / (1 - good)) @ weight, 1.0], field["doc"])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def brute_links(rows, threshold):
    def ok(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, link = len(rows), [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and ok(a[1], a[2]) and ok(b[1], b[2]) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    link[i].add(j)
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in link[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    least = {c: min(rows[i][0] for i in range(n) if comp[i] == c) for c in set(comp)}
    return sorted((rows[i][0], len(link[i]), least[comp[i]], rows[i][0] == least[comp[i]]) for i in range(n))


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.08, 8)).tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(10)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1), (404, rows[0][1], None), (405, rows[0][1][:4], 0), (406, [], 0), (407, [1e200] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_links(rows, 0.98)
    for cell, block in ((1000, 1024), (20, 8)):
        assert rows_of(embed.embedding_groups(df, cell_rows=cell, block_rows=block)) == sorted(want, key=repr)
    assert embed.embedding_groups(df.limit(0)).count() == 0


def fold7(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


@pytest.mark.parametrize("hot", [1 << 19, 40])
def test_pitman(spark, hot):
    """Counts and base scores against brute force; held-out texts gain; reruns agree; hot words in parts count alike."""
    data = corpus(n=200)
    small = {"hot": hot, "chunk_bytes": 2000, "range_bytes": 2000}
    got = pitman.language_scores(table(spark, data), **small).collect()
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {k: [*(t or "").encode().translate(low).split(), None] for k, (_, t, _) in enumerate(data)}
    counts = collections.Counter(w for k, (i, _, _) in enumerate(data) if fold7(i) != 2 for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(i), fold7(i) == 2, len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[k]), 6)) for k, (i, _, _) in enumerate(data))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 1e-9 for r in got)
    assert sorted(map(repr, pitman.language_scores(table(spark, data), **small).collect())) == sorted(map(repr, got))


def test_pitman_of_an_empty_table_and_without_training_texts(spark):
    assert pitman.language_scores(table(spark, [])).count() == 0
    held = next(i for i in range(100) if fold7(i) == 2)
    r = pitman.language_scores(table(spark, [(held, "a b a"), (held, None)])).collect()
    assert [x.score for x in r] == [0.0, 0.0] and all(x.train_tokens == 0 and x.n_known == 0 for x in r)


@pytest.mark.parametrize("hot", [1 << 19, 30])
def test_probabilities_of_a_context_sum_to_one(spark, hot):
    """Over all known words, the end and one unknown word, after contexts that are common, rare and unknown; also with hot words split."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    train, held = iter(i for i in range(10**6) if fold7(i) != 2), iter(i for i in range(10**6) if fold7(i) == 2)
    data = [(next(train), " ".join(words[min(29, int(rng.expovariate(0.15)))] for _ in range(rng.randint(1, 30)))) for _ in range(300)]
    probes = [(u, w, next(held)) for u in ("w1", "w17", "unseen") for w in [*words, "unknown"]]
    rows = data + [(k, f"{u} {w}") for u, w, k in probes] + [(next(held), u) for u in ()]
    ends = {u: next(held) for u in ("w1", "w17", "unseen")}
    rows += [(k, u) for u, k in ends.items()]
    got = {r.doc_id: r.token_scores for r in pitman.language_scores(table(spark, rows), per_token=True, hot=hot, chunk_bytes=2000, range_bytes=2000).collect()}
    for u, end in ends.items():
        assert sum(10 ** got[k][1] for a, _, k in probes if a == u) + 10 ** got[end][1] == pytest.approx(1, abs=1e-5)


def test_predictive_probabilities_by_hand(spark):
    """One training text of different words with different endings: every dish has one customer, so all seatings are known."""
    words = [c * 2 for c in "abcdefghij"]
    train, held = next(i for i in range(99) if fold7(i) != 2), next(i for i in range(99) if fold7(i) == 2)
    got = {r.doc_id: r.token_scores for r in pitman.language_scores(table(spark, [(train, " ".join(words)), (held, "aa cc zz")]), per_token=True).collect()}
    n, d = 11, 0.95  # types, and the discounts where everything is seen once

    def digamma(x):
        return math.log(x + 20) - 1 / (2 * (x + 20)) - 1 / (12 * (x + 20) ** 2) - sum(1 / (x + k) for k in range(20))

    a, sums = 1.0, collections.Counter()
    for _ in range(pitman.SAMPLES):
        a = (1 + a / d * math.log((a + d * (n - 0.5)) / (a + 0.5 * d))) / (1 + digamma(a + n) - digamma(a + 1))
        root = lambda c, a=a: (c * (1 - d) + (a + d * n) / (n + 1)) / (a + n)
        seen = lambda c, below: (c * (1 - d) + (1 + d) * below) / 2  # noqa: E731  a restaurant of one customer and strength 1
        # aa follows the end of nothing; cc never followed aa; zz is unknown, and so is what follows it.
        for key, p in (("aa", seen(1, seen(1, root(1)))), ("cc", seen(0, seen(0, root(1)))), ("zz", seen(0, seen(0, root(0)))), ("end", root(1))):
            sums[key] += p / pitman.SAMPLES
    assert [10**x for x in got[held]] == pytest.approx([sums[k] for k in ("aa", "cc", "zz", "end")], rel=2e-3)


def test_gibbs_reaches_the_seatings_distribution():
    """Tables of four customers of one dish after many removals and reseatings, against all partitions by enumeration."""
    strength, discount, base, others, n = 0.7, 0.6, 0.4, 3, 20_000
    count, size = np.ones(n, np.int64), np.full(n, 4)
    count, size = seating.gibbs(count, size, np.full(n, others + 1.0), np.full(n, base), strength, discount, np.arange(1, n + 1, dtype=np.uint64), 60)
    assert np.bincount(np.repeat(np.arange(n), count), size, n).tolist() == [4] * n and size.min() > 0
    weight = collections.Counter()
    for sizes, ways in (((4,), 1), ((3, 1), 4), ((2, 2), 3), ((2, 1, 1), 6), ((1, 1, 1, 1), 1)):
        w = ways * math.prod((strength + discount * (others + j)) * base for j in range(len(sizes)))
        weight[len(sizes)] += w * math.prod(i - discount for s in sizes for i in range(1, s))
    want = np.array([weight[t] for t in range(1, 5)]) / sum(weight.values())
    assert np.bincount(count, minlength=5)[1:] / n == pytest.approx(want, abs=0.012)


@pytest.mark.parametrize("discount", [0.05, 0.5, 0.76, 0.95])
def test_stirling_numbers_beyond_the_table(discount):
    """Integrals and short sums against the recursion, for every number of tables; and the recursion itself far beyond any table."""
    for c in (700, 1500):
        got = seating.log_stirling(np.full(c, c), np.arange(1, c + 1), discount)
        assert got == pytest.approx(seating.stirling_table(discount, c)[c - 1], abs=1e-7)
    c, t = np.full(30, 10.0**6), np.geomspace(2, 3e5, 30).astype(int)
    want = np.logaddexp(seating.log_stirling(c, t - 1, discount), np.log(c - discount * t) + seating.log_stirling(c, t, discount))
    assert seating.log_stirling(c + 1, t, discount) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("customers", "strength", "base", "discount"), [(2, 0.5, 0.3, 0.7), (40, 3.0, 0.4, 0.7), (1500, 300.0, 0.2, 0.5), (1500, 5.0, 0.01, 0.8)])
def test_one_draw_seats_all_customers_of_a_dish(customers, strength, base, discount):
    """From one draw, tables follow their exact chances, of which a few customers' moves are far."""
    n = 2000 if customers < 1000 else 600
    seed = np.arange(1, n + 1, dtype=np.uint64)
    t = np.arange(1, customers + 1)
    p = seating.stirling_table(discount, customers)[-1] + np.cumsum(np.log((strength + discount * (t - 1)) * base))
    p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
    mean = (p * t).sum()
    error = 4 * math.sqrt(max((p * t * t).sum() - mean * mean, 1e-4) / n)
    got = seating.drawn(np.full(n, customers), np.full(n, strength), np.full(n, base), discount, seating.uniform(seating.mix64(seed), 1))
    assert got.min() >= 1 and got.max() <= customers and abs(got.mean() - mean) < error
    if customers == 40:
        n = 200
        one, full, seed = np.ones(n, np.int64), np.full(n, customers), seed[:n]
        few, many = (seating.gibbs(one, full, one, np.full(n, base), strength, discount, seed, steps)[0].mean() for steps in (4, 1200))
        assert few < mean - 10 * error and abs(many - mean) < 4 * error


def test_seatings_keep_their_customers():
    rng = np.random.default_rng(2)
    c, seed = rng.integers(0, 500, 300), np.arange(1, 301, dtype=np.uint64)
    total = lambda count, size: np.bincount(np.repeat(np.arange(300), count), size, 300).tolist()
    strength = rng.uniform(0.01, 50, 300)
    count, size = seating.seated(c, strength, seed)
    assert total(count, size) == c.tolist() and (count[c > 0] >= 1).all() and (count <= c).all()
    delta = rng.integers(-c, 200)
    count, size = seating.changed(count, size, delta, strength, 0.5, seed)
    assert total(count, size) == (c + delta).tolist() and (size > 0).all() and (count[c + delta > 0] >= 1).all()


def test_media(spark, tmp_path):
    data = corpus() + [(600, "a" * 192), (601, "b" * 193)]
    got = media.media_columns(table(spark, data), archive_bytes=4000).collect()
    want = []
    for i, t, *_ in data:
        p = media.payload_of((t or "").encode())
        assert len(p) % 192 == 0 and len(p) > 0 and media.png_decode(media.png_encode(p)) == p
        want.append((repr(i), len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((repr(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert all(r.error is None for r in got)
    assert media.media_columns(table(spark, [])).count() == 0


def test_media_source_keeps_the_other_members(spark, tmp_path):
    folder = str(tmp_path / "a")
    archive = media.write_archives(table(spark, [(i, f"text {i}") for i in range(30)]).coalesce(1), "file://" + folder).first().archive.removeprefix("file://")
    raw = bytearray(open(archive, "rb").read())
    at = raw.index(b"\x89PNG") + 60
    raw[at] ^= 255
    open(archive, "wb").write(raw)
    spark.dataSource.register(media.MediaArchiveSource)
    got = spark.read.format("media_archive").option("path", folder).option("rangeBytes", 1000).load().collect()
    assert len(got) == 30 and sum(r.error is not None for r in got) == 1
    open(archive, "wb").write(b"no archive")
    assert [r.member for r in spark.read.format("media_archive").option("archives", json.dumps([[archive, 10]])).load().collect()] == [None]


def test_media_ranges_do_not_vanish(monkeypatch):
    reader = media.MediaArchiveReader({"archives": "[]"})
    monkeypatch.setattr(media, "open_fs", lambda _: (_ for _ in ()).throw(OSError("away")))
    rows = [r for b in reader.read(media.ByteRange("file:///x.zip", 8, 16)) for r in b.to_pylist()]
    assert [(r["offset"], r["error"]) for r in rows] == [(8, "OSError: away")]


def independent_png(data):
    """Samples of an 8-bit grey PNG, read by the format's rules: chunks, one zlib stream, a filter byte before each row."""
    at, width, packed = 8, 0, b""
    while data[at + 4 : at + 8] != b"IEND":
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IHDR":
            width, bits, colour = int.from_bytes(data[at + 8 : at + 12], "big"), data[at + 16], data[at + 17]
            assert (bits, colour, data[at + 18 : at + 21]) == (8, 0, b"\0\0\0")
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + n]
        at += 12 + n
    rows = zlib.decompress(packed)
    assert len(rows) % (width + 1) == 0 and not any(rows[:: width + 1])
    return b"".join(rows[k + 1 : k + 1 + width] for k in range(0, len(rows), width + 1))


def test_stored_media_by_an_independent_reader():
    for text in (b"", b"a" * 191, b"a" * 192, bytes(range(256)) * 9):
        samples = independent_png(media.png_encode(media.payload_of(text)))
        assert samples[: len(text)] == text and not samples[len(text) :].strip(b" ") and len(samples) % 192 == 0


def test_failed_members_keep_their_document(spark):
    got = media.media_features(spark.createDataFrame([("0/17/2.png", None, "away")], "member string, payload binary, error string")).first()
    assert got.doc_id == 17 and got.n_bytes == 2 and "away" in got.error


def test_missing_archives_are_an_error(spark, tmp_path):
    folder = str(tmp_path / "m")
    media.write_archives(table(spark, [(i, f"text {i}") for i in range(5)]).coalesce(1), "file://" + folder).collect()
    spark.dataSource.register(media.MediaArchiveSource)
    assert spark.read.format("media_archive").option("path", "file://" + folder).option("archiveCount", 1).load().count() == 5
    with pytest.raises(Exception, match="1 of 2 archives"):
        spark.read.format("media_archive").option("path", "file://" + folder).option("archiveCount", 2).load().count()


def test_strict_media_fail(spark):
    bad = spark.createDataFrame([("0/1/2.png", None, "away")], "member string, payload binary, error string")
    assert media.media_features(bad).count() == 1
    with pytest.raises(Exception, match="could not be read"):
        media.media_features(bad, strict=True).collect()


@pytest.mark.parametrize("rank_rows", [50_000, 3])
def test_packing(spark, rank_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    data = corpus() + [(700, "word " * 3000), (701, "naïve ½ ² <|endoftext|> 漢字​  x\r\n\t y's _a_ ÷ 1٣")]
    out = packing.pack(table(spark, data), rank_rows=rank_rows).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, *_ in data:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = np.array(ids[s : s + 2048], "<u4")
            want[repr(i), s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert collections.Counter((repr(None if d != d else int(d)), s, n, c, t) for d, s, n, c, t in zip(out.doc_id, out.start, out.length, out.ids_crc32, out.doc_tokens)) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 2048
    assert packing.pack(table(spark, [])).count() == 0


def test_column_generation():
    rng = np.random.default_rng(0)
    demand = np.zeros(65, np.int64)
    demand[1:] = rng.integers(0, 40, 64)
    plan = packing.column_generation(demand, 64)
    used = sum(p * n for p, n in plan)
    assert (used == demand).all() and all((p * np.arange(65)).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= math.ceil((demand * np.arange(65)).sum() / 64 * 1.1) + 5
