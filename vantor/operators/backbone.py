"""Pluggable image models: a frozen model turns decoded tiles into vectors, with masks as weights."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class ImageModel(ABC):
    """What a model gives: tokens of an image on a square grid, any number of leading tokens without place, and a mode."""

    prefix_tokens = 0
    mode = "patch"

    def load(self) -> None:
        """Called once per worker."""

    def prepare(self, image: np.ndarray) -> np.ndarray:
        return image.astype(np.float32) / 255

    @abstractmethod
    def tokens(self, image: np.ndarray) -> np.ndarray:
        """(prefix + grid * grid) x dims."""

    def pooled(self, tokens: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Mean of the grid's tokens weighted by the mask's coverage of their cells, the first token, or both."""
        first, grid = tokens[0], tokens[self.prefix_tokens :]
        side = int(round(len(grid) ** 0.5))
        if side * side != len(grid):
            raise ValueError("tokens do not form a square grid")
        weight = np.ones(len(grid)) if mask is None else coverage(mask, side)
        mean = (grid * weight[:, None]).sum(0) / max(weight.sum(), 1e-6)
        return {"cls": first, "patch": mean, "both": np.concatenate([mean, first])}[self.mode]


def coverage(mask: np.ndarray, side: int) -> np.ndarray:
    """Share of set pixels in each of side x side cells."""
    edges_y, edges_x = (np.linspace(0, n, side + 1).astype(int) for n in mask.shape)
    total = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1))
    total[1:, 1:] = (mask > 0).cumsum(0).cumsum(1)
    block = total[edges_y][:, edges_x]
    counts = block[1:, 1:] - block[:-1, 1:] - block[1:, :-1] + block[:-1, :-1]
    return (counts / np.maximum(1, np.outer(np.diff(edges_y), np.diff(edges_x)))).ravel()


class BlockMeans(ImageModel):
    """A stand-in without weights: mean colours of the grid's cells."""

    def __init__(self, side: int = 4):
        self.side = side

    def tokens(self, image: np.ndarray) -> np.ndarray:
        rows = np.array_split(image, self.side, axis=0)
        return np.array([c.reshape(-1, image.shape[2]).mean(0) for r in rows for c in np.array_split(r, self.side, axis=1)])


def embed_images(images: DataFrame, model: ImageModel) -> DataFrame:
    """images (id, height, width, pixels binary of height * width * 3, mask binary or null) -> (id, vec); the model is loaded once per worker."""

    def run(batches):
        model.load()
        for batch in batches:
            out = []
            for h, w, raw, mask in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "pixels", "mask"))):
                image = model.prepare(np.frombuffer(raw, np.uint8).reshape(h, w, 3))
                own = None if mask is None else np.frombuffer(mask, np.uint8).reshape(h, w)
                out.append(model.pooled(model.tokens(image), own).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.float64()))], ["id", "vec"])

    return images.select("id", "height", "width", "pixels", "mask").mapInArrow(run, "id long, vec array<double>")
