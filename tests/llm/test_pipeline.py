"""The pipeline's stages: columns, what each keeps, and the packed result."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from vantor.llm.common import stored

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, ids = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == names
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert np.mean([i in ids[0] for i in good]) > 0.97 and np.mean([i in ids[0] for i in bad]) < 0.2
    packed = corpus_pipeline.packing_stage(spark, docs, SF).toPandas()
    assert set(packed.doc_id) == ids[-1]
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()]


CLASHING = ("_fp", "_value", "_bands", "_row", "_key", "at", "size", "score", "chunk", "bucket", "component")


def write_tables(spark, folder, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("own") for c in CLASHING})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    """Null ids, texts and sources, empty and repeated rows, ties, one very long text, and columns that are called like the operators' own."""
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choice(["the", "quick", "river", "moved", "slowly", "over", "old", "stones", "while", "birds"]) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, line(rng.randint(5, 80)) + ".", "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(None, line(30), "en", None, 1), (None, None, None, None, None), (100, None, "en", "s0", 0), (101, "", "en", "s0", 0), (102, " \n ", "en", "s1", 3)]
    rows += [rows[3]] * 3 + [(200 + i, rows[5][1], "en", "s2", 1) for i in range(4)] + [(300, line(30_000), "en", "s1", 1), (301, "mail jo@doe.org or jo@doe.org", "en", "s1", 1)]
    write_tables(spark, f"{tmp_path}/t", rows, [(i, int(i % 7 != 0), 0) for i in range(60)])
    docs = spark.read.parquet(f"{tmp_path}/t/documents.parquet")
    names = docs.columns
    before = sorted(map(repr, docs.collect()))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stored(stage(spark, docs, f"{tmp_path}/t"))
        now = docs.collect()
        assert docs.columns == names and all(r[c] == "own" for r in now for c in CLASHING)
        if k == 0:
            assert set(map(repr, now)) <= set(before)
        if k == 1:
            assert len({r.text for r in now}) == len(now) and not any(200 <= (r.doc_id or 0) < 204 for r in now)
        if k == 2:
            assert not any("@" in (r.text or "") for r in now)
    packed = corpus_pipeline.packing_stage(spark, docs, f"{tmp_path}/t").toPandas()
    assert packed.length.sum() == packed[packed.start == 0].doc_tokens.sum() and packed.length.max() <= 2048


def test_empty_tables_pass_through_all_stages(spark, tmp_path):
    write_tables(spark, f"{tmp_path}/t", [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/t").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
