"""Mixing sources to target weights by entropy balancing, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, doc_key, partitions, stored

#: Largest rate of a document: it is taken at most so many times.
CAP = 2.0
#: Parts of each doubling of the order that copies are given in, and parts of one of those.
_STEPS, _SUBSTEPS = 64, 4096


def size_of(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"))


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = CAP) -> DataFrame:
    """(source, source_size, docs, target): one row per source.

    Weights are dealt in turn by the source's code points, null last: sources are ranked within ranges of their order, and the ranges
    by their counts. A target stops at cap times its source; what is above is shared again by weight, in rounds over all sources, until
    none is above.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    per = stored(per.repartitionByRange(partitions(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    counts = per.groupBy("part").count().select("part", before.alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.join(F.broadcast(counts), "part").withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    per = stored(per.select("source", "source_size", "docs", "w", (F.col("source_size") * cap).alias("room")), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = -1.0, -1
    while True:
        over = F.col("room") <= F.col("w") * level
        r = per.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("room"))).alias("room"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if r["full"] == full or not r["w"]:
            break
        full, level = r["full"], (share * total - (r["room"] or 0.0)) / r["w"]
    return per.select("source", "source_size", "docs", F.when(over, F.col("room")).otherwise(F.col("w") * level).alias("target"))


def _sum(value):
    """A sum that does not depend on the order of rows, as one of doubles does in its last bits."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def rate_of(cap: float = CAP):
    """exp(lam * size / scale) and at most cap, of a row with its source's lam and scale; lam is null where everything is taken cap times."""
    return F.when(F.col("lam").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.lit(math.log(cap)), F.col("lam") * F.col("size") / F.col("scale")))))


def tilts(units: DataFrame, targets: DataFrame, cap: float = CAP, tolerance: float = 1e-9, max_rounds: int = 100) -> DataFrame:
    """targets with lam and scale: each source's tilt, by Newton rounds on the dual.

    The document rates nearest to one (least sum of r log r - r + 1, 0 <= r <= cap) whose words meet the source's target are
    r = min(cap, exp(lam * size)): the token constraint tilts a document by its own size. The dual, a convex function of lam for
    each source, has the gradient sum(size * r) - target. Equal sizes of a source are one row with a count; each round sums gradient and curvature
    over these rows for all sources at once. A step that leaves the bracket of the signs seen so far halves it. Rounds that don't converge are an error.
    """
    sizes = units.groupBy("source", "size").agg(F.count("*").alias("n")).where("size > 0")
    sizes = stored(sizes, "sizes")
    scale = F.col("source_size") / F.col("docs")
    free = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
    dual = targets.where(free).select("source", "target", scale.alias("scale"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("off"))
    dual = stored(dual, "dual")
    small = targets.count() <= BROADCAST_ROWS
    for _ in range(max_rounds):
        known = F.broadcast(dual) if small else dual
        rows = sizes.withColumnRenamed("source", "of").join(known, F.col("of").eqNullSafe(F.col("source"))).withColumn("r", rate_of(cap))
        words = F.col("n") * F.col("size") * F.col("r")
        bent = F.when(F.col("r") < cap, words * F.col("size") / F.col("scale")).otherwise(F.lit(0.0))
        first = [F.first(c).alias(c) for c in ("target", "scale", "lam", "lo", "hi")]
        step = rows.groupBy("source").agg(*first, _sum(words).alias("mass"), _sum(bent).alias("curve"))
        over = F.col("mass") > F.col("target")
        step = step.withColumns({"lo": F.when(over, F.col("lo")).otherwise(F.col("lam")), "hi": F.when(over, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - (F.col("mass") - F.col("target")) / F.nullif(F.col("curve"), F.lit(0.0))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        half = F.when(F.col("hi").isNull(), 2 * F.abs("lo") + 1).when(F.col("lo").isNull(), -2 * F.abs("hi") - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        off = F.abs(F.col("mass") - F.col("target")) / F.col("target")
        lam = F.when(off < tolerance, F.col("lam")).when(inside, newton).otherwise(half)
        dual = stored(step.select("source", "target", "scale", lam.alias("lam"), "lo", "hi", off.alias("off")), "dual")
        if (dual.agg(F.max("off")).first()[0] or 0.0) < tolerance:
            break
    else:
        raise RuntimeError("the mixing dual did not converge")
    found = dual.select(F.col("source").alias("of"), "scale", "lam")
    return targets.join(F.broadcast(found) if small else found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def _placed(rows: DataFrame, known: DataFrame, small: bool, cap: float) -> DataFrame:
    """rows (_source, at, size) with their source's row of known, their rate, whole copies, and the turn in which they get one copy more.

    turn is u / f, with u uniform by the id's md5 and f the rate's fraction (none: null), the order of sequential Poisson
    sampling: a document of a larger fraction comes earlier. bin and sub are two levels of parts of that order.
    """
    out = rows.join(F.broadcast(known) if small else known, F.col("_source").eqNullSafe(F.col("source"))).withColumn("rate", rate_of(cap))
    out = out.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("rest", F.col("rate") - F.col("whole"))
    u = F.conv(F.substring("at", 1, 13), 16, 10).cast("double") / 2.0**52
    out = out.withColumn("turn", F.when((F.col("rest") > 1e-9) & (F.col("size") > 0), u / F.col("rest"))).drop("rest")
    place = F.lit(_STEPS) * F.greatest(F.lit(-500.0), F.coalesce(F.log2("turn"), F.lit(-500.0)))
    return out.withColumns({"bin": F.floor(place), "sub": F.floor((place - F.floor(place)) * _SUBSTEPS)})


def _crossing(sums: DataFrame, state: DataFrame, *order: str) -> DataFrame:
    """state with the row of sums (more words in order) at which each source's words run out, and the words left there; if they don't, the last row."""
    by = Window.partitionBy("_source").orderBy(*order)
    before = F.coalesce(F.sum("more").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = sums.join(state, F.col("_source").eqNullSafe(F.col("of")))
    met = met.withColumns({"before": before, "last": F.lead("more").over(by).isNull()})
    met = met.where((F.col("before") < F.col("left")) & (F.col("last") | (F.col("before") + F.col("more") >= F.col("left"))))
    return met.withColumn("left", F.least("more", F.col("left") - F.col("before"))).drop("before", "last", "more", "_source")


def mixing_plan(units: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = CAP) -> DataFrame:
    """One row per source: what decides for each of its documents, from its size and id alone, how many words are taken.

    Rates become copies: every document is taken floor(rate) times, and the words that are left of the source's rounded target are
    one copy more of documents by their turn. The place at which these words run out is found by sums over parts of the order,
    then over parts of the part that holds it, then over the places in that one; only those are put in order. Rows of
    that place (of one id and size) share what is left there, each cut to the same number of words.
    """
    plan = stored(tilts(units, source_targets(units, weights, share, cap), cap), "plan")
    small = plan.count() <= BROADCAST_ROWS
    rows = units.select(F.col("source").alias("_source"), F.md5(doc_key("doc_id").cast("binary")).alias("at"), "size")
    rows = _placed(rows, plan.select("source", "target", "lam", "scale"), small, cap)
    more = F.sum(F.when(F.col("turn").isNotNull(), F.col("size"))).alias("more")
    bins = stored(rows.groupBy("_source", "bin").agg(more, F.sum(F.col("whole") * F.col("size")).alias("words"), F.first("target").alias("target")), "bins")
    state = bins.groupBy(F.col("_source").alias("of")).agg((F.round(F.first("target")).cast("long") - F.sum("words")).alias("left")).where("left > 0")
    state = stored(_crossing(bins.select("_source", "bin", "more").where("more > 0"), state, "bin"), "bins")
    for keys, deeper in ((("bin",), ("sub",)), (("bin", "sub"), ("turn", "at", "size"))):
        chosen = state.select("of", "left", *[F.col(k).alias("its_" + k) for k in keys])
        inside = F.col("_source").eqNullSafe(F.col("of"))
        for k in keys:
            inside &= F.col(k) == F.col("its_" + k)
        sums = rows.join(F.broadcast(chosen) if small else chosen, inside).where("turn IS NOT NULL").groupBy("_source", *deeper).agg(F.sum("size").alias("more"), F.count("*").alias("n"))
        state = _crossing(sums, chosen, *deeper).withColumnsRenamed({"its_" + k: k for k in keys})
        state = stored(state, "crossing")
    cut = state.select(F.col("of"), F.struct("turn", "at", "size").alias("cut"), F.floor(F.col("left") / F.col("n")).alias("cut_taken"))
    plan = plan.withColumnRenamed("source", "_source").join(cut, F.col("_source").eqNullSafe(F.col("of")), "left").drop("of")
    return stored(plan.withColumnRenamed("_source", "source"), "plan")


def _taken(rows: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """rows (_source, at, size, ...) with source_size, target, rate and taken."""
    small = plan.count() <= BROADCAST_ROWS
    key = F.struct("turn", "at", "size")
    more = F.when(key < F.col("cut"), F.col("size")).when(key == F.col("cut"), F.col("cut_taken")).otherwise(F.lit(0))
    more = F.when(F.col("turn").isNotNull() & F.col("cut").isNotNull(), more).otherwise(F.lit(0))
    return _placed(rows, plan, small, cap).withColumn("taken", (F.col("whole") * F.col("size") + more).cast("long"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = CAP,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, taken): how many words of each document the mix takes.

    A source's taken words equal its rounded target, but for less than a word for each row of one id and size where the words run
    out. No document is taken more than cap times. Reruns agree. Null and wordless texts have size 0 and taken 0; a null source is a
    source of its own; a null doc_id is ordered as the empty text; repeated rows are documents of their own; an empty table gives an empty result.
    """
    units = stored(sizes_of(docs, id_col, text_col, source_col), "sizes")
    rows = units.select("doc_id", F.col("source").alias("_source"), F.md5(doc_key("doc_id").cast("binary")).alias("at"), "size")
    return _taken(rows, mixing_plan(units, weights, share, cap), cap).select("doc_id", "source", "size", "source_size", "target", "rate", "taken")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3.0, 1.0, 2.0), share: float = 1.5, cap: float = CAP, length_col: str | None = "n_chars"
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns, whatever their names.

    Decisions follow from a row's size and id and its source's plan, so texts are read, not shuffled. A copy that is cut to fit holds its first words, joined by one
    space. Documents without words are not taken; nulls, repeated rows and empty tables are as in mix().
    """
    plan = mixing_plan(stored(sizes_of(docs, id_col, text_col, source_col), "sizes"), weights, share, cap)
    rows = docs.select(F.struct("*").alias("_row"), F.col(source_col).cast("string").alias("_source"), F.md5(doc_key(id_col).cast("binary")).alias("at"), size_of(text_col).alias("size"))
    rows = _taken(rows, plan, cap).where("taken > 0")
    copy = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy")
    rows = rows.select("_row", "size", "taken", copy).select("_row", "size", (F.col("taken") - (F.col("copy") - 1) * F.col("size")).alias("left"))
    cut, text = F.col("left") < F.col("size"), F.col("_row")[text_col]
    words = F.slice(F.regexp_extract_all(text, F.lit("(" + WORD + ")")), F.lit(1), F.col("left").cast("int"))
    text = F.when(cut, F.array_join(words, " ")).otherwise(text)
    out = {c: F.col("_row")[c] for c in docs.columns} | {text_col: text}
    if length_col and length_col in docs.columns:
        out[length_col] = F.when(cut, F.length(text)).otherwise(F.col("_row")[length_col]).cast(docs.schema[length_col].dataType)
    return rows.select(*[out[c].alias(c) for c in docs.columns])


#: The dual is solved here by halving, 110 times, over each source's distinct sizes.
SQL = r"""
WITH RECURSIVE units AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM units GROUP BY source),
dealt AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM per),
rooms AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS room FROM dealt),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY room / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY room / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM rooms),
targets AS (SELECT *, CASE WHEN room <= w * level THEN room ELSE w * (SELECT min_by(level, room / w) FROM levels WHERE room > w * level) END AS target, source_size / docs AS scale FROM levels),
hist AS (SELECT t.sid, u.size, count(*) AS n FROM units u JOIN dealt t ON u.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
halves AS (
  SELECT 0 AS k, sid, target, scale, -60.0::DOUBLE * scale AS lo, 60.0::DOUBLE * scale AS hi FROM targets WHERE source_size > 0 AND target < 2.0::DOUBLE * source_size * (1 - 1e-12)
  UNION ALL
  SELECT h.k + 1, h.sid, any_value(h.target), any_value(h.scale),
         CASE WHEN sum(s.n * s.size * least(2.0::DOUBLE, exp(least(1.0::DOUBLE, (h.lo + h.hi) / 2 * s.size / h.scale)))) > any_value(h.target) THEN any_value(h.lo) ELSE any_value((h.lo + h.hi) / 2) END,
         CASE WHEN sum(s.n * s.size * least(2.0::DOUBLE, exp(least(1.0::DOUBLE, (h.lo + h.hi) / 2 * s.size / h.scale)))) > any_value(h.target) THEN any_value((h.lo + h.hi) / 2) ELSE any_value(h.hi) END
  FROM halves h JOIN hist s ON h.sid = s.sid WHERE h.k < 110 GROUP BY h.k, h.sid),
tilt AS (SELECT sid, (lo + hi) / 2 AS lam FROM halves WHERE k = 110),
rates AS (SELECT u.*, t.sid, t.source_size, t.target, CASE WHEN l.lam IS NULL THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, exp(least(1.0::DOUBLE, l.lam * u.size / t.scale))) END AS rate
          FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source LEFT JOIN tilt l ON l.sid = t.sid),
turns AS (SELECT *, floor(rate + 1e-9) AS whole, CASE WHEN rate - floor(rate + 1e-9) > 1e-9 AND size > 0 THEN CAST(CAST('0x' || substr(digest, 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 / (rate - floor(rate + 1e-9)) END AS turn FROM rates),
rests AS (SELECT sid, round(any_value(target)) - sum(whole * size) AS rest FROM turns GROUP BY sid),
grouped AS (SELECT sid, turn, digest, size, sum(size) AS more, count(*) AS n FROM turns WHERE turn IS NOT NULL GROUP BY ALL),
running AS (SELECT *, coalesce(sum(more) OVER (PARTITION BY sid ORDER BY turn, digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM grouped)
SELECT t.doc_id, CAST(t.size AS BIGINT) AS size, t.source_size, round(t.target, 6) AS target,
       CAST(t.whole * t.size + coalesce(greatest(0, floor(least(g.more, r.rest - g.before) / g.n)), 0) AS BIGINT) AS taken
FROM turns t JOIN rests r ON r.sid = t.sid LEFT JOIN running g ON g.sid = t.sid AND g.turn = t.turn AND g.digest = t.digest AND g.size = t.size
"""
