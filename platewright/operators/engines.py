"""External engines behind small interfaces: detectors, readers, second opinions. Each is made once per worker process from a factory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DETECTION = "image_id long, det_seq long, x1 long, y1 long, x2 long, y2 long, confidence double, class_name string, error string"
READ = "crop_id long, variant_idx int, text string, confidence double, engine string, error string"


class Detector(Protocol):
    def __call__(self, h: int, w: int, c: int, data: bytes, confidence: float) -> list[tuple[int, int, int, int, float, str]]: ...


class Reader(Protocol):
    name: str

    def __call__(self, h: int, w: int, c: int, data: bytes) -> list[tuple[str, float]]: ...


def detect(images: DataFrame, factory: Callable[[], Detector], confidence: float = 0.25) -> DataFrame:
    """Boxes of images (image_id, h, w, c, data); an image that fails gives one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, names = factory(), [x.split()[0] for x in DETECTION.split(", ")]
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    out += [(r.image_id, n, *(int(v) for v in d[:4]), float(d[4]), d[5], None) for n, d in enumerate(engine(r.h, r.w, r.c, bytes(r.data), confidence))]
                except Exception as e:  # noqa: BLE001  a bad image is a row, not a failed task
                    out.append((r.image_id, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in ("det_seq", "x1", "y1", "x2", "y2")})

    return images.select("image_id", "h", "w", "c", "data").mapInPandas(run, DETECTION)


def read(variants: DataFrame, factory: Callable[[], Reader]) -> DataFrame:
    """Texts of crop variants (crop_id, variant_idx, h, w, c, data)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    out += [(r.crop_id, r.variant_idx, t, max(0.0, min(1.0, float(c))), engine.name, None) for t, c in engine(r.h, r.w, r.c, bytes(r.data))]
                except Exception as e:  # noqa: BLE001
                    out.append((r.crop_id, r.variant_idx, None, None, engine.name, str(e)))
            yield pd.DataFrame(out, columns=["crop_id", "variant_idx", "text", "confidence", "engine", "error"])

    return variants.select("crop_id", "variant_idx", "h", "w", "c", "data").mapInPandas(run, READ)


def best_read(reads: DataFrame) -> DataFrame:
    """The read of the highest confidence of each crop, the first variant on ties; empty texts don't count."""
    w = Window.partitionBy("crop_id").orderBy(F.desc("confidence"), "variant_idx")
    return reads.where("text <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_with_fallback(variants: DataFrame, original: DataFrame, factory: Callable[[], Reader], fallback: Callable[[], Reader] | None = None) -> DataFrame:
    """Best read of the variants, else of the original crop, else by the fallback engine."""
    out = best_read(read(variants, factory))
    for rows, make in [(original, factory)] + ([(original, fallback)] if fallback else []):
        missing = rows.join(out, "crop_id", "left_anti")
        out = out.unionByName(best_read(read(missing, make)))
    return out
