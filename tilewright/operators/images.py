"""From images to vectors: preprocessing on arrays, and a pluggable back-end that encodes batches on the executors."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import parse_path


def center_crop(img: np.ndarray, size: int) -> np.ndarray:
    y, x = max(0, (img.shape[0] - size) // 2), max(0, (img.shape[1] - size) // 2)
    return img[y : y + size, x : x + size]


def top_left_crop(img: np.ndarray, size: int) -> np.ndarray:
    return img[:size, :size]


def resize(img: np.ndarray, size: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned."""
    at = [np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1) for n in img.shape[:2]]
    low = [np.floor(a).astype(int) for a in at]
    high = [np.minimum(a + 1, n - 1) for a, n in zip(low, img.shape[:2])]
    fy, fx = (at[0] - low[0])[:, None, None], (at[1] - low[1])[None, :, None]
    src = img.reshape(*img.shape[:2], -1).astype(float)
    top = src[low[0]][:, low[1]] * (1 - fx) + src[low[0]][:, high[1]] * fx
    bottom = src[high[0]][:, low[1]] * (1 - fx) + src[high[0]][:, high[1]] * fx
    return (top * (1 - fy) + bottom * fy).round().astype(img.dtype).reshape(size, size, *img.shape[2:])


PREPROCESSING: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"center_crop": center_crop, "top_left_crop": top_left_crop, "resize": resize, "none": lambda img, size: img}


class Backend(ABC):
    """An encoder. It is pickled to the executors; load weights lazily, in encode_batch."""

    name: str
    dimension: int
    input_size: int = 224

    @abstractmethod
    def decode(self, content: bytes) -> np.ndarray:
        """An image's array, height x width x 3."""

    @abstractmethod
    def encode_batch(self, images: np.ndarray) -> np.ndarray:
        """Vectors, a row for each image."""


class MeanColour(Backend):
    """A small stand-in: means and deviations of the channels over a grid, of binary PPM images."""

    name, dimension = "mean_colour", 24

    def decode(self, content: bytes) -> np.ndarray:
        magic, width, height, top, data = content.split(maxsplit=4) if content[:2] == b"P6" else (b"", b"0", b"0", b"0", b"")
        if magic != b"P6" or top != b"255":
            raise ValueError("not a binary PPM image")
        head = content.index(b"255") + 4
        return np.frombuffer(content, np.uint8, offset=head).reshape(int(height), int(width), 3)

    def encode_batch(self, images: np.ndarray) -> np.ndarray:
        n, h, w, _ = images.shape
        cells = [images[:, a : a + h // 2, b : b + w // 2] for a in (0, h // 2) for b in (0, w // 2)]
        return np.concatenate([np.concatenate([c.mean((1, 2)), c.std((1, 2))], axis=1) for c in cells], axis=1)


def extract(files: DataFrame, backend: Backend, preprocessing: str = "resize", done: DataFrame | None = None, batch: int = 128) -> DataFrame:
    """path, the path's metadata, preprocessing, dimension, model, vector and ok for each image of files (path, content).

    Paths in `done` are skipped, so a stopped run goes on; an image that can't be decoded gives the vector of a black one and ok = false.
    """
    todo = files.select("path", "content") if done is None else files.select("path", "content").join(done.select("path"), "path", "left_anti")
    prepare, size = PREPROCESSING[preprocessing], backend.input_size

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                images, ok = [], []
                for content in part["content"]:
                    try:
                        images.append(prepare(backend.decode(content), size))
                        ok.append(True)
                    except Exception:
                        images.append(np.zeros((size, size, 3), np.uint8))
                        ok.append(False)
                vectors = [backend.encode_batch(i[None])[0] for i in images] if len({i.shape for i in images}) > 1 else backend.encode_batch(np.stack(images))
                yield pd.DataFrame({"path": part["path"], "vector": [np.asarray(v, np.float32) for v in vectors], "ok": ok})

    got = todo.mapInPandas(run, "path string, vector array<float>, ok boolean")
    return got.select("path", *parse_path(F.col("path")), F.lit(preprocessing).alias("preprocessing"), F.lit(backend.dimension).alias("dimension"), F.lit(backend.name).alias("model"), "vector", "ok")


def retry(call: Callable, tries: int = 5, first_wait: float = 5.0, errors: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """call() again after waits that double, for services outside of Spark; the last error is raised."""
    for n in range(tries):
        try:
            return call()
        except errors:
            if n == tries - 1:
                raise
            sleep(first_wait * 2**n)
