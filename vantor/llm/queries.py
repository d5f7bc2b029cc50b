"""One query per corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), length=400)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, threshold=0.3)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed import embedding_groups

    return embedding_groups(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import remove_windows

    return remove_windows(_table(spark, sf_dir, "documents"), length=13)


def op8_pitman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman import language_scores

    return language_scores(_table(spark, sf_dir, "documents"), folds=7, held=2)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(_table(spark, sf_dir, "documents"), strict=True).drop("error")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), sequence=2048, end_id=1)


def queries() -> dict:
    return {"op1_simhash": op1_simhash, "op2_suffixes": op2_suffixes, "op3_mixing": op3_mixing, "op4_pii": op4_pii, "op5_quality": op5_quality, "op6_embeddings": op6_embeddings, "op7_windows": op7_windows, "op8_pitman": op8_pitman, "op9_media": op9_media, "op10_packing": op10_packing}


def oracle_sql() -> dict[str, str]:
    from . import embed, mixing, suffixes, windows

    return {"op2_suffixes": suffixes.SQL, "op3_mixing": mixing.SQL, "op6_embeddings": embed.SQL, "op7_windows": windows.SQL}
