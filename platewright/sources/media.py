"""Images, videos and model files as rows. Decoders are functions given by the caller and made once per worker process."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK

IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG,BMP,WEBP}"
IMAGE = "path string, h int, w int, c int, data binary, error string"
FRAME = "path string, frame_number long, timestamp_ms double, h int, w int, c int, data binary, error string"


def read_images(spark: SparkSession, path: str, decoder: Callable[[], Callable[[bytes], tuple[int, int, int, bytes] | None]]) -> DataFrame:
    """One row per image file. decoder() gives a function from bytes to (h, w, c, data); None for no image. A file that can't be decoded gives its error; Spark leaves out empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = decoder()
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    found, error = (one(bytes(r.content)) if len(r.content) else None), None
                except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed task
                    found, error = None, str(e)
                rows.append((r.path, *(found or (None, None, None, None)), error))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "c", "data", "error"]).astype({"h": "Int32", "w": "Int32", "c": "Int32"})

    return files.mapInPandas(decode, IMAGE)


def read_videos(spark: SparkSession, path: str, opener: Callable[[], Callable[[bytes], Iterator[tuple[int, float, int, int, int, bytes]]]], skip: int = 1) -> DataFrame:
    """One row per sampled frame of the video files; opener() gives a function from a file's bytes to its frames (number, ms, h, w, c, data), which are streamed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.expr(k.is_video(SPARK, "path"))).select("path", "content")

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FRAME.split(", ")]
        start = opener()
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                try:
                    for f in start(bytes(r.content)):
                        if (f[0] - 1) % skip == 0:
                            yield pd.DataFrame([(r.path, *f, None)], columns=names)
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame([(r.path, None, None, None, None, None, None, str(e))], columns=names).astype({"frame_number": "Int64", "h": "Int32", "w": "Int32", "c": "Int32"})

    return files.mapInPandas(frames, FRAME)


def list_models(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Paths of the model files below path, by name; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pt").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.col("length").alias("bytes")).orderBy("path")
