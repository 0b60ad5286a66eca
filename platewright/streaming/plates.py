"""Plate reads as streams: tracks with per-video state, and rollups by event time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.operators.tracking import OUT, Tracker


def track_stream(reads: DataFrame, idle: str = "NoTimeout", **how) -> DataFrame:
    """Each read with its track, as ``tracking.assign_tracks`` gives it, over a stream whose reads of a video arrive in order of frames.

    The state of a video is its tracker: at most ``capacity`` tracks, as JSON.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = Tracker(**how)
        if state.exists:
            tracker.load(json.loads(state.get[0]))
        rows, out = pd.concat(list(parts)).sort_values(["frame_number", "seq"], kind="stable"), []
        for r in rows.itertuples():
            found = tracker.observe(int(r.frame_number), r.plate, float(r.confidence), (int(r.x1), int(r.y1), int(r.x2), int(r.y2)))
            if found is not None:
                out.append((key[0], r.frame_number, r.seq, found, r.plate.replace("-", "").upper(), r.confidence))
        state.update((json.dumps(tracker.state()),))
        yield pd.DataFrame(out, columns=["video_id", "frame_number", "seq", "track_id", "text", "confidence"])

    wanted = reads.select("video_id", "frame_number", "seq", "plate", "confidence", "x1", "y1", "x2", "y2")
    return wanted.groupBy("video_id").applyInPandasWithState(step, OUT, "tracker string", "append", idle)


def plate_windows(reads: DataFrame, time: str = "ts", window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Detections and best confidence of each plate by tumbling or sliding window; rows later than the watermark are dropped."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    out = reads.withWatermark(time, late).groupBy(span.alias("w"), "plate").agg(F.count("*").alias("detections"), F.max("confidence").alias("best_confidence"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "plate", "detections", "best_confidence")


def plate_sessions(reads: DataFrame, time: str = "ts", gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Visits: reads of one plate with no longer gap between them."""
    out = reads.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "plate").agg(F.count("*").alias("detections"), F.max("confidence").alias("best_confidence"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "plate", "detections", "best_confidence")


def distinct_plates(reads: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each plate of a video once while its event time is within the watermark."""
    return reads.withWatermark(time, late).dropDuplicatesWithinWatermark(["video_id", "plate"])
