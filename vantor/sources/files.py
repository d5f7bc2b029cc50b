"""Scans and sinks: .npy matrices, metadata tables, image listings, polygon annotations, JSON caches."""

from __future__ import annotations

import ast
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff")
METADATA = T.StructType([T.StructField("index", T.LongType()), T.StructField("image_path", T.StringType())])
ANNOTATION = T.StructType(
    [
        T.StructField("_Name", T.StringType()),
        T.StructField("Coordinates", T.StructType([T.StructField("Coordinate", T.ArrayType(T.StructType([T.StructField("_X", T.DoubleType()), T.StructField("_Y", T.DoubleType())])))])),
    ]
)


def npy_header(data: bytes) -> tuple[np.dtype, bool, tuple, int]:
    """(type, Fortran order, shape, offset of the values) of an .npy file."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    wide = data[6] >= 2
    (n,) = struct.unpack_from("<I" if wide else "<H", data, 8)
    at = 8 + (4 if wide else 2)
    head = ast.literal_eval(data[at : at + n].decode("latin-1"))
    return np.dtype(head["descr"]), head["fortran_order"], head["shape"], at + n


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, row array<double>) of all .npy matrices under path, one row per matrix row."""

    def rows(batches):
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                kind, fortran, shape, at = npy_header(data)
                x = np.frombuffer(data, kind, offset=at).reshape(shape, order="F" if fortran else "C").reshape(shape[0] if shape else 1, -1)
                for s in range(0, len(x), 4096):
                    part = x[s : s + 4096].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(s, s + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], ["path", "index", "row"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInArrow(rows, "path string, index long, row array<double>")


def embedding_stem(model: str, size: int | None = None, mode: str | None = None, crops: bool = False) -> str:
    """The composed stem of an embedding table's files."""
    return "_".join([model, *([str(size)] if size else []), *([mode] if mode else []), *(["crops"] if crops else []), "embeddings"])


def write_npy(df: DataFrame, folder: str, stem: str, id_col: str = "vec_id", vec_col: str = "embedding", path_col: str = "image_path") -> DataFrame:
    """(path, rows) of the .npy matrices and CSV tables (index, image_path) that are written, one pair per partition with the same rows in the same order.

    Files are written under a name of the task attempt and renamed, so a task that runs again leaves the same ones.
    """

    def run(batches):
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        task, rows = TaskContext.get(), []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)))
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        at, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        at.create_dir(base, recursive=True)
        name = f"{stem}-{task.partitionId():05d}"
        table = "index,image_path\n" + "".join(f"{i},{p}\n" for i, _, p in rows)
        for suffix, data in ((".npy", npy_bytes(np.array([v for _, v, _ in rows], np.float32))), (".csv", table.encode())):
            with at.open_output_stream(f"{base}/.{name}{suffix}.{task.taskAttemptId()}") as out:
                out.write(data)
            at.move(f"{base}/.{name}{suffix}.{task.taskAttemptId()}", f"{base}/{name}{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.npy"]), pa.array([len(rows)])], ["path", "rows"])

    from ..operators.durable import cut

    return cut(df.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"), F.col(path_col)).mapInArrow(run, "path string, rows long"))


def write_mask(masks: DataFrame, folder: str, height: int, width: int) -> DataFrame:
    """(path, n): one .npy of 0 and 1 per image of (image_id, y, x, m), named by the image; rows are the image's lines."""

    def run(key, table):
        from pyarrow import fs as pafs

        at, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        at.create_dir(base, recursive=True)
        x = np.zeros((height, width), np.uint8)
        x[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("m").to_numpy(zero_copy_only=False)
        name = f"{base}/{key[0].as_py()}.npy"
        with at.open_output_stream(name + ".new") as out:
            out.write(npy_bytes(x))
        at.move(name + ".new", name)
        return pa.table({"path": [f"{folder}/{key[0].as_py()}.npy"], "n": [int(x.sum())]})

    from ..operators.durable import cut

    return cut(masks.select("image_id", "y", "x", "m").groupBy("image_id").applyInArrow(run, "path string, n long"))


def read_masks(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, y, x, m) of the .npy masks in folder, by the files' stems."""
    rows = read_npy(spark, folder).select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("image_id"), F.col("index").cast("int").alias("y"), F.posexplode("row").alias("x", "v"))
    return rows.select("image_id", "y", "x", (F.col("v") > 0).alias("m"))


def put_texts(spark: SparkSession, folder: str, texts: dict[str, str]) -> str:
    """Write a few small text files by name; returns the folder."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, text in texts.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()
    return folder


def npy_bytes(x: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(index, image_path) of a CSV with header, by its declared schema."""
    return spark.read.schema(METADATA).csv(path, header=True)


def write_clustered(metadata: DataFrame, labels: DataFrame, path: str, name: str = "leiden_cluster") -> DataFrame:
    """Metadata with the label column, matched by index, written as CSV and returned; unmatched rows are an error."""
    both = metadata.join(labels.select(F.col("vec_id").alias("index"), F.col("label").alias(name)), "index", "full")
    if both.where(F.col("image_path").isNull() | F.col(name).isNull()).limit(1).count():
        raise ValueError("labels and metadata differ in their rows")
    both.write.mode("overwrite").csv(path, header=True)
    return both


def list_files(spark: SparkSession, path: str, suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """(path, name, stem, suffix) of files whose suffix is one of those, in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), suffix.alias("suffix"))
    return out.where(F.col("suffix").isin(*suffixes))


def paired(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with the mask of their stem (an ending _mask is dropped), and the files of either side without partner."""
    m = masks.select(F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask_path"))
    i = images.select("stem", F.col("path").alias("image_path"))
    both = i.join(m, "stem", "full")
    return both.where("image_path IS NOT NULL AND mask_path IS NOT NULL"), both.where("image_path IS NULL OR mask_path IS NULL")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, polygon_id, pts array<struct<x float, y float>>) of annotation files; fewer than three points make no polygon."""
    raw = spark.read.format("xml").option("rowTag", "Annotation").schema(ANNOTATION).load(path).withColumn("file", F.input_file_name())
    pts = F.transform(F.filter("Coordinates.Coordinate", lambda c: c["_X"].isNotNull() & c["_Y"].isNotNull()), lambda c: F.struct(c["_X"].cast("float").alias("x"), c["_Y"].cast("float").alias("y")))
    slide = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    out = raw.select(slide.alias("slide_id"), F.monotonically_increasing_id().alias("at"), pts.alias("pts")).where(F.size("pts") >= 3)
    from pyspark.sql import Window

    return out.select("slide_id", (F.row_number().over(Window.partitionBy("slide_id").orderBy("at")) - 1).alias("polygon_id"), "pts")


def cached_json(spark: SparkSession, path: str, make) -> DataFrame:
    """The JSON table at path if it is there, else what make() gives, written there first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path)
    except AnalysisException:
        make().write.mode("overwrite").json(path)
        return spark.read.json(path)


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is still to be done."""
    return wanted.join(done, key, "left_anti")


def resolved(path: Column, base: str) -> Column:
    """Absolute paths stay, others are taken under base."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(base), path))
