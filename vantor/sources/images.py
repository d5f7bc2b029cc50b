"""8-bit PNG images as binary columns: sink, reader, and the loader of image and mask pairs."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import cut
from .files import list_files, paired

_HEAD = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel of the colour types: grey, RGB, grey with alpha, RGB with alpha.
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def png_encode(image: np.ndarray) -> bytes:
    """Lossless PNG of a height x width (grey) or height x width x 3 array of bytes."""
    h, w = image.shape[:2]
    kind = 0 if image.ndim == 2 else 2
    rows = np.zeros((h, 1 + w * _SAMPLES[kind]), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return _HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """height x width x samples of an 8-bit PNG without interlacing; anything else is a ValueError."""
    if data[:8] != _HEAD:
        raise ValueError("not a PNG")
    at, packed, shape = 8, b"", None
    while at < len(data):
        (n,), name = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", body)
            if bits != 8 or kind not in _SAMPLES or laced:
                raise ValueError("only 8-bit grey and RGB images without interlacing")
            shape = h, w, _SAMPLES[kind]
        elif name == b"IDAT":
            packed += body
        at += 12 + n
    h, w, s = shape
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * s)
    out = np.zeros((h, w * s), np.uint8)
    above = np.zeros(w * s, np.int64)
    for y in range(h):
        line, kind = rows[y, 1:].astype(np.int64), rows[y, 0]
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(w, s), 0).ravel()
        elif kind in (3, 4):
            for x in range(w * s):
                a, b, c = (line[x - s] if x >= s else 0), above[x], (above[x - s] if x >= s else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    return out.reshape(h, w, s)


def write_images(pixels: DataFrame, folder: str, names: DataFrame, height: int, width: int, channels=("r", "g", "b")) -> DataFrame:
    """(name, bytes) of one PNG per image of (image_id, y, x, channels), called as in names (image_id, name); one channel makes a grey image."""

    def run(key, table):
        from pyarrow import fs as pafs

        at, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        at.create_dir(base, recursive=True)
        image = np.zeros((height, width, len(channels)), np.uint8)
        for k, c in enumerate(channels):
            image[table.column("y").to_numpy(), table.column("x").to_numpy(), k] = table.column(c).to_numpy()
        data = png_encode(image if len(channels) > 1 else image[:, :, 0])
        name = f"{base}/{key[0].as_py()}"
        with at.open_output_stream(name + ".new") as out:
            out.write(data)
        at.move(name + ".new", name)
        return pa.table({"name": [key[0].as_py()], "bytes": [len(data)]})

    rows = pixels.join(names, "image_id").select("name", "y", "x", *channels)
    return cut(rows.groupBy("name").applyInArrow(run, "name string, bytes long"))


def load_pairs(spark: SparkSession, images: str, masks: str) -> DataFrame:
    """(stem, height, width, image array<float> in 0..1, mask array<int>) of images and the masks of their stems, row by row; a file without partner is an error.

    Masks are the first channel, unscaled.
    """
    pairs, alone = paired(list_files(spark, images, ("png",)), list_files(spark, masks, ("png",)))
    if alone.limit(1).count():
        raise ValueError("images and masks differ")
    read = lambda path, name: spark.read.format("binaryFile").load(path).select(F.col("path").alias(f"{name}_path"), F.col("content").alias(name))
    both = pairs.join(read(images, "image"), "image_path").join(read(masks, "mask"), "mask_path").select("stem", "image", "mask")

    def run(batches):
        for batch in batches:
            for stem, image, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x, m = png_decode(image), png_decode(mask)[:, :, 0]
                if x.shape[:2] != m.shape:
                    raise ValueError(f"{stem}: the mask's size differs")
                row = [[stem], [m.shape[0]], [m.shape[1]], [(x.ravel() / np.float32(255)).astype(np.float32)], [m.ravel().astype(np.int32)]]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["stem", "height", "width", "image", "mask"])

    return both.mapInArrow(run, "stem string, height int, width int, image array<float>, mask array<int>")
