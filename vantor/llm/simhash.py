"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import checked_broadcast, connected_components, lower_ascii, stored, unused

#: Shingles whose bits are counted at once, which bounds memory for very long texts.
_BLOCK = 262_144
#: Bands of minima and rows in each: a pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^20 = 0.0004.
BANDS, ROWS = 20, 5
#: Shingle hashes that are compared with one another in one task.
PART_BYTES = 4 << 20
#: Rows of one to three numbers that are broadcast, at most: some 10 MB.
NUMBERS = 1 << 19
#: Sets of them, on average at most: all pairs of a part are one matrix.
PART_SETS = 1024
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FLIP, _ODD = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit is 1 if set in over half of the hashes of the text's word shingles, repeats included; no words: 0."""
    words = lower_ascii(text or b"").split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())],
            "<u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): one row per document, whole text; null and wordless texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def segment_plan(bits: int, radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) per segment: two values within radius agree within one segment's ball.

    With radius = segments * q + a, differences that stay above q in the first a + 1 segments and above
    q - 1 in the others add up to more than radius; so those balls are enough.
    """
    q, a = divmod(radius, segments)
    widths = [bits // segments + (k < bits % segments) for k in range(segments)]
    shifts = [sum(widths[:k]) for k in range(segments)]
    return [(s, w, q if k <= a else q - 1) for k, (s, w) in enumerate(zip(shifts, widths)) if (q if k <= a else q - 1) >= 0]


def segments_for(n: int, radius: int, bits: int = 64) -> int:
    """The number of segments at which n values cause the fewest probes and fetched candidates, if they are spread evenly.

    Fewer segments are wider keys with larger balls: keys grow with the table, so buckets stay small. Any number finds all links.
    """

    def cost(m: int) -> float:
        return sum(math.comb(w, r) * (1 + n / 2.0**w) for _, w, q in segment_plan(bits, radius, m) for r in range(q + 1))

    return min(range(2, radius + 2), key=cost)


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most radius bits in width."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def multi_index_links(values: DataFrame, radius: int = 4, segments: int | None = None, bits: int = 64) -> DataFrame:
    """Pairs (a < b) of distinct values (column fp) at Hamming distance 1 to radius; segments: as many as suit the number of values.

    Each value stands once per segment in the table; each probes the small Hamming ball around its own
    segment; what is fetched is verified over all bits in the join itself, so only links leave it.
    """
    segments = segments or segments_for(values.count(), radius, bits)
    table, probes = [], []
    for k, (shift, width, r) in enumerate(segment_plan(bits, radius, segments)):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        table.append(F.struct(F.lit(k).alias("seg"), part.alias("part")))
        probes += [F.struct(F.lit(k).alias("seg"), part.bitwiseXOR(F.lit(m)).alias("part")) for m in ball(width, r)]
    left = values.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("key")).select("a", "key.seg", "key.part")
    right = values.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("key")).select("b", "key.seg", "key.part")
    near = (left.seg == right.seg) & (left.part == right.part) & (left.a < right.b)
    near &= F.bit_count(left.a.bitwiseXOR(right.b)) <= radius
    return left.join(right, near).select("a", "b").distinct()


def value_components(rows: DataFrame, radius: int, segments: int | None) -> DataFrame:
    """(fp, root, component) of each distinct fingerprint in rows (doc_id, fp): its smallest doc_id, and its group named by a fingerprint."""
    values = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("root")), "values")
    links = stored(multi_index_links(values.select("fp"), radius, segments).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    group = connected_components(links)
    named = values.join(group, values.fp == group.node, "left").select("fp", "root", F.coalesce("component", "fp").alias("component"))
    return stored(named, "named")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, segments: int | None = None
) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept): near-duplicate groups over all documents.

    Equal fingerprints are joined first, so a group of copies is one value of the index; links between
    different fingerprints are complete for the radius. component_id is the smallest doc_id reachable and
    kept marks it. Null and wordless texts have fingerprint zero and link like any other; a null doc_id
    takes part without becoming a component's id unless all its group has none; repeated rows are
    returned as often as they come; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = value_components(rows, radius, segments)
    roots = named.groupBy("component").agg(F.min("root").alias("component_id"))
    found = named.join(roots, "component").select("fp", "component_id")
    out = rows.join(found, "fp")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, segments: int | None = None) -> DataFrame:
    """docs with one document of each near-duplicate group: that of the smallest id, null last; of repeated rows one stays. All columns are kept."""
    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.encode() if t is not None else None, shingle) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(fps, np.uint64).view(np.int64))], [*batch.schema.names, own])

    own, root, chosen = unused(names, "_fp"), unused(names, "_root"), unused(names, "_best")
    schema = StructType([*docs.schema.fields, StructField(own, LongType())])
    rows = stored(docs.mapInArrow(run, schema), "fingerprints")
    named = value_components(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(own).alias("fp")), radius, segments)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("root").isNull().alias("none"), "root", "fp")).alias("best"))
    best = best.select(F.col("best.root").alias(root), F.col("best.fp").alias(chosen))
    kept = rows.join(best, (F.col(own) == F.col(chosen)) & F.col(id_col).cast("long").eqNullSafe(F.col(root)))
    return kept.dropDuplicates([own]).select(*names)


def shingle_hashes(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, no words give none."""
    words = lower_ascii(text or b"").split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of minima; no shingles: no keys."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        low = np.minimum(low, ((hashes[at : at + 512, None] ^ _FLIP) * _ODD).min(0))
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(low.reshape(BANDS, ROWS))]


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common part of each set on the left with each on the right; sets are arrays of distinct numbers.

    A number in few sets adds one to each pair of them; numbers in many sets are columns of two matrices that are multiplied, some thousands at once.
    """
    sides, out = [], np.zeros(len(left) * len(right), np.int64)
    both = np.unique(np.concatenate([*left, *right, np.zeros(0, np.uint64)]), return_inverse=True)[1]
    for sets, place in ((left, both[: sum(map(len, left))]), (right, both[sum(map(len, left)) :])):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(place, kind="stable")
        sides.append((place[order], owner[order], np.bincount(place, minlength=int(both.max(initial=-1)) + 1)))
    (cl, ol, nl), (cr, orr, nr) = sides
    few = nl * nr <= 1024
    take = few[cl] & (nr[cl] > 0)
    times = nr[cl[take]]
    start = (np.cumsum(nr) - nr)[cl[take]]
    at = np.repeat(start - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    out += np.bincount(np.repeat(ol[take], times) * len(right) + orr[at], minlength=len(out))
    out = out.reshape(len(left), len(right))
    many = np.flatnonzero(~few)
    for k in range(0, len(many), 2048):
        part = many[k : k + 2048]
        x = [np.zeros((n, len(part)), np.float32) for n in (len(left), len(right))]
        for m, (c, o, _) in zip(x, sides):
            s, e = np.searchsorted(c, part[0]), np.searchsorted(c, part[-1], "right")
            column = np.minimum(np.searchsorted(part, c[s:e]), len(part) - 1)
            mine = part[column] == c[s:e]
            m[o[s:e][mine], column[mine]] = 1
        out += np.rint(x[0] @ x[1].T).astype(np.int64)
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets have that Jaccard similarity; empty ones have none."""
    both = intersections(left, right)
    sizes = [np.array([len(x) for x in sets]) for sets in (left, right)]
    return (both > 0) & (both >= similarity * (sizes[0][:, None] + sizes[1][None] - both))


def similar_groups(sets: list[np.ndarray], similarity: float) -> list[int]:
    """For each set the place of its group's first one; groups are the components of all pairs at the similarity."""
    near, label = similar(sets, sets, similarity), np.arange(len(sets))
    while len(sets):
        low = np.minimum(label, np.where(near, label[None], len(sets)).min(1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label.tolist()


def _grouped(members: DataFrame, similarity: float) -> DataFrame:
    """(node, head) of members (component, part, node, hashes): groups of similar sets within each part, named by their least node."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        ids = table.column("node").to_pylist()
        first = similar_groups([np.frombuffer(h, "<u8") for h in table.column("hashes").to_pylist()], similarity)
        return pa.table([table.column("component").combine_chunks(), pa.array(ids, pa.int64()), pa.array([ids[k] for k in first], pa.int64())], ["component", "node", "head"])

    return members.groupBy("component", "part").applyInArrow(run, "component long, node long, head long")


def _dealt(sets: DataFrame, part_bytes: int) -> DataFrame:
    """sets (component, node, hashes) with a part of its component: parts hold about part_bytes and PART_SETS each."""
    parts = F.greatest(F.ceil(F.sum(F.length("hashes") + 64) / part_bytes), F.ceil(F.count("*") / PART_SETS))
    sizes = sets.groupBy("component").agg(parts.alias("parts"))
    return sets.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))


def verified_groups(sets: DataFrame, similarity: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """(node, head): groups of sets (component, node, hashes) that are connected by pairs at the similarity; head is a group's least node.

    All pairs of a component that could still join two groups are compared, in parts of bounded size. Each part is grouped
    by itself; then one set of each group meets the others' until that joins no more, which settles groups of near copies
    however large they are. Only what is still apart in a component of several parts is compared part by part.
    """
    dealt = stored(_dealt(sets, part_bytes), "sets", tidy=True)
    links = stored(_grouped(dealt, similarity), "groups", tidy=True)
    wide = dealt.where("parts > 1").select("component").distinct()
    heads = links.join(wide, "component", "left_semi")
    known = links.select(F.col("node").alias("src"), F.col("head").alias("dst"))
    count = heads.where("node = head").count()
    while count:
        met = heads.where("node = head").select("node")
        again = stored(_grouped(_dealt(dealt.join(met, "node", "left_semi").select("component", "node", "hashes"), part_bytes), similarity), "groups", tidy=True)
        known = known.union(again.select(F.col("node").alias("src"), F.col("head").alias("dst")))
        heads, before = again, count
        count = again.where("node = head").count()
        if count == before:
            break
    group = stored(connected_components(known.where("src <> dst")), "groups")
    labelled = dealt.join(group, "node", "left").withColumn("group", F.coalesce(group["component"], "node")).select(dealt["component"], "part", "node", "hashes", "group")
    apart = labelled.groupBy("component").agg(F.countDistinct("group").alias("groups")).where("groups > 1").join(wide, "component", "left_semi").select("component")
    if apart.isEmpty():
        return group.select("node", F.col("component").alias("head"))
    blocks = stored(labelled.join(apart, "component", "left_semi").groupBy("component", "part").agg(F.collect_list(F.struct("node", "group", "hashes")).alias("rows")), "blocks")
    blocks = blocks.select("component", "part", *[F.col(f"rows.{c}").alias(c) for c in ("node", "group", "hashes")])
    others = blocks.select("component", *[F.col(c).alias("other_" + c) for c in ("part", "node", "group", "hashes")])
    pairs = blocks.join(others, "component").where("part < other_part").select("node", "group", "hashes", "other_node", "other_group", "other_hashes")

    def compare(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                found = cross_links(*([(n, g, np.frombuffer(h, "<u8")) for n, g, h in zip(*side)] for side in (row[:3], row[3:])), similarity)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["src", "dst"])

    known = known.where("src <> dst").union(pairs.mapInArrow(compare, "src long, dst long"))
    return connected_components(known).select("node", F.col("component").alias("head"))


def cross_links(left: list, right: list, similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes at the similarity, one for each two groups that have one; left and right hold (node, group, hashes)."""
    a, b = np.nonzero(similar([r[2] for r in left], [r[2] for r in right], similarity))
    groups = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
    apart = np.flatnonzero(groups[0][a] != groups[1][b])
    first = np.unique(np.stack([groups[0][a[apart]], groups[1][b[apart]]]), axis=1, return_index=True)[1] if len(apart) else apart
    return [(left[i][0], right[j][0]) for i, j in zip(a[apart[first]], b[apart[first]])]


def near_deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 4, segments: int | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """docs with one document of each group of near copies: that of the smallest id, null last; of repeated rows one stays.

    Near copies share at least this Jaccard similarity of their sets of word shingles. Candidates are texts that share a band
    of minima or whose fingerprints lie within radius; every candidate pair that could join two groups is verified by whole
    texts. Texts with the same words are one value. All columns are kept.
    """
    names = docs.columns
    place = names.index(text_col)
    added = [unused(names, n) for n in ("_fp", "_value", "_bands", "_row")]

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            fps, values, bands = [], [], []
            numbers = np.arange(row, row := row + batch.num_rows)
            for t in batch.column(place).to_pylist():
                text = t.encode() if t is not None else b""
                fps.append(fingerprint(text, shingle))
                values.append(xxhash.xxh64_intdigest(b" ".join(lower_ascii(text).split())))
                bands.append(band_keys(shingle_hashes(text, shingle)))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, values)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *longs, pa.array(bands, pa.list_(pa.int64())), pa.array(numbers)], [*batch.schema.names, *added])

    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(added, (LongType(), LongType(), ArrayType(LongType()), LongType()))]])
    full = stored(docs.mapInArrow(run, schema), "fingerprints")
    rows = full.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(n).alias(m) for n, m in zip(added, ("_fp", "_value", "_bands", "_row"))])
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("best")
    values = stored(rows.groupBy("_value").agg(best, F.first("_fp").alias("fp"), F.first("_bands").alias("bands")).select("_value", F.col("best.id").alias("root"), F.col("best._row").alias("_row"), "fp", "bands"), "values", tidy=True)

    # Each value is tied to the smallest of its band, and fingerprints within the radius tie their smallest values.
    keys = values.where(F.size("bands") > 0).select("_value", F.posexplode(F.array_append("bands", F.col("fp"))).alias("band", "key"))
    stars = keys.groupBy("band", "key").agg(F.min("_value").alias("dst"), F.max("_value").alias("far")).where("dst < far").drop("far")
    ties = keys.join(stars, ["band", "key"]).where("_value <> dst").select(F.col("_value").alias("src"), "dst")
    fps = stored(values.where(F.size("bands") > 0).groupBy("fp").agg(F.min("_value").alias("v")), "fingerprints")
    near = multi_index_links(fps.select("fp"), radius, segments)
    near = near.join(fps.select(F.col("fp").alias("a"), F.col("v").alias("src")), "a").join(fps.select(F.col("fp").alias("b"), F.col("v").alias("dst")), "b").select("src", "dst")
    found = stored(connected_components(ties.union(near).distinct()), "candidates", tidy=True)
    candidates = found.union(found.select(F.col("component").alias("node"), "component").distinct())

    def hashed(batches):
        for batch in batches:
            sets = [shingle_hashes(t.encode(), shingle).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["component", "node", "hashes"])

    # Lists of row numbers are sent to the texts where they are counted to be short; beyond that Spark joins by shuffling both.
    members = stored(candidates.join(values.select(F.col("_value").alias("node"), "_row"), "node"), "members", tidy=True)
    texts = rows.select("_row", "text").join(checked_broadcast(members, NUMBERS), "_row").select("component", "node", "text")
    groups = verified_groups(texts.mapInArrow(hashed, "component long, node long, hashes binary"), similarity, part_bytes)
    named = values.join(groups, values["_value"] == groups["node"], "left").select("root", "_row", F.coalesce("head", "_value").alias("component"))
    chosen = named.groupBy("component").agg(F.min(F.struct(F.col("root").isNull().alias("none"), "root", "_row")).alias("best"))
    lost = rows.select("_row").join(chosen.select(F.col("best._row").alias("_row")), "_row", "left_anti")
    lost = stored(lost.withColumnRenamed("_row", added[3]), "lost", tidy=True)
    return full.join(checked_broadcast(lost, NUMBERS), added[3], "left_anti").select(*names)
