"""Pixel measurements: Spark decodes and distributes, numpy kernels measure one image each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = (
    "path string, height int, width int, readable boolean, brightness double, contrast double, blur_score double, "
    "r_mean double, g_mean double, b_mean double, luma_mean double, luma_std double, phash long"
)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width, channels, data; a file that does not decode has height -1."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return images.select(
        F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data"
    )


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """BGR pixels (height, width, 3); a single channel is repeated."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, :3]


def luma(bgr: np.ndarray) -> np.ndarray:
    # Summed blue first, pixel by pixel: a matrix product may add in another order, and halves then round apart.
    return np.rint(0.114 * bgr[..., 0] + 0.587 * bgr[..., 1] + 0.299 * bgr[..., 2])


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, mirrored at the border."""
    g = np.pad(gray.astype(float), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(float), 1, mode="edge")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4.0 * g[1:-1, 1:-1]
    return float(lap.var())


def _shrink(gray: np.ndarray, side: int) -> np.ndarray:
    """Area average on a side x side grid."""

    def weights(n: int) -> np.ndarray:
        edges = np.arange(side + 1) * n / side
        cells = np.arange(n)
        low = np.maximum(edges[:-1, None], cells[None, :])
        high = np.minimum(edges[1:, None], cells[None, :] + 1)
        w = np.maximum(high - low, 0.0)
        return w / w.sum(axis=1, keepdims=True)

    return weights(gray.shape[0]) @ gray @ weights(gray.shape[1]).T


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits: the low 8 x 8 cosine frequencies of a 32 x 32 reduction against their median."""
    side, low = 32, 8
    k = np.arange(side)
    basis = np.cos(np.pi * np.outer(np.arange(low), 2 * k + 1) / (2 * side))
    freq = basis @ _shrink(gray, side) @ basis.T
    flags = (freq > np.median(freq)).reshape(-1)
    value = 0
    for flag in flags:
        value = value << 1 | int(flag)
    return value - (1 << 64) if value >= 1 << 63 else value


def measure(row: dict) -> dict:
    """All measures of one decoded image."""
    bgr = pixels(row["data"], row["height"], row["width"], row["nChannels"])
    gray = luma(bgr)
    b, g, r = bgr.reshape(-1, 3).mean(axis=0)
    return {
        "readable": True, "brightness": gray.mean(), "contrast": gray.std(), "blur_score": laplacian_variance(gray),
        "r_mean": r, "g_mean": g, "b_mean": b, "luma_mean": gray.mean(), "luma_std": gray.std(),
        "phash": perceptual_hash(gray),
    }


def image_features(images: DataFrame, kernel: Callable[[dict], dict] = measure, schema: str = FEATURES) -> DataFrame:
    """One row of measures per image. ``kernel`` may be replaced, together with ``schema``.

    A file that does not decode keeps its path and has null measures.
    """
    import pandas as pd

    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                base = {n: row.get(n) for n in ("path", "height", "width")}
                ok = row["height"] is not None and row["height"] > 0
                out.append({**base, **(kernel(row) if ok else {"readable": False})})
            yield pd.DataFrame(out, columns=names).astype({"phash": "Int64"} if "phash" in names else {})

    return images.mapInPandas(run, schema)


def region_sharpness(gray: np.ndarray, regions) -> list[float | None]:
    """Laplacian variance inside each relative box; None where a side is under two pixels."""
    height, width = gray.shape
    out = []
    for x, y, w, h in regions:
        x0, y0 = max(0, round(x * width)), max(0, round(y * height))
        x1, y1 = min(width, round((x + w) * width)), min(height, round((y + h) * height))
        out.append(laplacian_variance(gray[y0:y1, x0:x1]) if x1 - x0 >= 2 and y1 - y0 >= 2 else None)
    return out


def image_pixels(images: DataFrame, side: int = 48) -> DataFrame:
    """(path, r, g, b): pixels of a side x side reduction, input of the dominant colour."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if row["height"] <= 0:
                    continue
                bgr = pixels(row["data"], row["height"], row["width"], row["nChannels"]).astype(float)
                b, g, r = (_shrink(bgr[:, :, c], side).reshape(-1) for c in range(3))
                yield pd.DataFrame({"path": row["path"], "r": r, "g": g, "b": b})

    return images.mapInPandas(run, "path string, r double, g double, b double")


def embed_faces(crops: DataFrame, backend: Callable, key: list[str], schema: str) -> DataFrame:
    """Vectors from a user-supplied model: ``backend(list of crops) -> list of vectors`` per batch.

    ``crops`` has the key columns and ``crop`` (bytes); ``schema`` lists the key columns and
    ``vector array<float>``. A zero vector is dropped.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            vectors = backend(list(pdf["crop"]))
            out = pdf[key].assign(vector=[np.asarray(v, np.float32).tolist() for v in vectors])
            yield pd.DataFrame(out[[any(v) for v in out["vector"]]])

    return crops.mapInPandas(run, schema)
