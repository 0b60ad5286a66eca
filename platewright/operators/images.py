"""Pixel measures of grey crops. Crops come as rows of pixels (crop_id, i, p) or as arrays; the neighbourhood filters run in Arrow batches over numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.functions import kernels as k

METRICS = ("brightness", "contrast", "sharpness", "snr", "motion", "highlight", "shadow", "quality")


def crops(pixels: DataFrame) -> DataFrame:
    """crop_id and its pixels in order."""
    return pixels.groupBy("crop_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("pixels"))


def quadrant_spread(pixels: DataFrame, side: int, scale: float) -> DataFrame:
    y, x = F.floor(F.col("i") / side), F.col("i") % side
    quarter = F.floor(y / (side // 2)) * 2 + F.floor(x / (side // 2))
    means = pixels.groupBy("crop_id", quarter.alias("q")).agg(F.avg("p").alias("m"))
    return means.groupBy("crop_id").agg(F.least(F.lit(1.0), F.stddev_pop("m") / scale).alias("spread"))


def border_delta(pixels: DataFrame, side: int) -> DataFrame:
    edge = max(2, side // 8)
    inner = F.floor(F.col("i") / side).between(edge, side - edge - 1) & (F.col("i") % side).between(edge, side - edge - 1)
    rows = pixels.groupBy("crop_id").agg(F.avg(F.when(~inner, F.col("p"))).alias("b"), F.avg(F.when(inner, F.col("p"))).alias("c"))
    return rows.select("crop_id", F.least(F.lit(1.0), F.abs(F.col("b") - F.col("c")) / 70.0).alias("delta"))


def _shifts(g: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The eight neighbours of each pixel, the border mirrored about its own pixels."""
    padded = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    h, w = g.shape[1:]
    return {(dy, dx): padded[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def ensure_bgr(image: np.ndarray) -> np.ndarray:
    """Three channels: grey is repeated, a fourth (alpha) is left out."""
    if image.ndim == 2:
        image = image[:, :, None]
    return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3]


def filters(g: np.ndarray) -> dict[str, np.ndarray]:
    """Per image: variance of the Laplacian, noise level against a 3 x 3 Gaussian, and the share by which gradients favour one direction."""
    s = _shifts(g.astype(float))
    laplacian = s[-1, 0] + s[1, 0] + s[0, -1] + s[0, 1] - 4 * s[0, 0]
    blurred = sum(s[dy, dx] * (2 - abs(dy)) * (2 - abs(dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 16
    gx = sum((s[dy, 1] - s[dy, -1]) * (2 - abs(dy)) for dy in (-1, 0, 1))
    gy = sum((s[1, dx] - s[-1, dx]) * (2 - abs(dx)) for dx in (-1, 0, 1))
    mx, my = np.abs(gx).mean((1, 2)), np.abs(gy).mean((1, 2))
    return {"sharpness": laplacian.var((1, 2)), "noise": (g - blurred).std((1, 2)) + 1e-6, "anisotropy": np.abs(mx - my) / (mx + my + 1e-6)}


def measure(rows: DataFrame, side: int = 8, edges: float = 0.05) -> DataFrame:
    """crop_id and METRICS of square crops; edge density, which needs an external edge detector, is given."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            g = np.array(pdf["pixels"].tolist(), float).reshape(len(pdf), side, side)
            f = filters(g)
            mean = g.mean((1, 2))
            yield pd.DataFrame(
                {
                    "crop_id": pdf["crop_id"],
                    "brightness": mean,
                    "contrast": g.std((1, 2)),
                    "sharpness": f["sharpness"],
                    "snr": 20 * np.log10((mean + 1) / f["noise"]),
                    "motion": np.minimum(1, 0.65 * f["anisotropy"] + 0.35 * (1 - np.clip(f["sharpness"] / 120, 0, 1))),
                    "highlight": (g >= 250).mean((1, 2)),
                    "shadow": (g <= 5).mean((1, 2)),
                }
            )

    out = rows.mapInPandas(batch, "crop_id long, brightness double, contrast double, sharpness double, snr double, motion double, highlight double, shadow double")
    names = {"brightness": "brightness", "contrast": "contrast", "sharpness": "sharpness", "snr": "snr", "motion": "motion", "edges": f"{edges}e0", "high": "highlight", "low": "shadow"}
    return out.withColumn("quality", F.expr(k.quality_score(names)))
