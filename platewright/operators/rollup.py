"""Rollups of plate reads. Reads: video_id, frame_number, seq, plate (normalised), plate_text, confidence, quality, char_conf (mean), x1..y2, timestamp_ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"detections": 0.22, "best": 0.20, "average": 0.13, "quality": 0.15, "chars": 0.15, "span": 0.10, "bonus": 0.05}
BOX = "struct<x1: bigint, y1: bigint, x2: bigint, y2: bigint>"


def read_quality(rows: DataFrame) -> DataFrame:
    return rows.withColumn("read_quality", F.greatest("confidence", "quality", 0.5 * F.col("confidence") + 0.5 * F.col("char_conf")))


def stable_box(boxes: Column, iou: float = 0.5, old: float = 0.65) -> Column:
    """The boxes (structs with seq, in order) folded into one: an average that starts anew where a box lies too far off."""

    def overlap(a: Column, b: Column) -> Column:
        w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
        h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        area = lambda p: F.greatest(F.lit(1), (p["x2"] - p["x1"]) * (p["y2"] - p["y1"]))
        both = w * h
        return F.when((w <= 0) | (h <= 0), 0.0).otherwise(both / F.greatest(F.lit(1), area(a) + area(b) - both))

    def step(state: Column, b: Column) -> Column:
        smooth = F.struct(*(F.bround(old * state[c] + (1 - old) * b[c]).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))
        fresh = F.struct(*(b[c].cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))
        return F.when(state.isNull(), fresh).when(overlap(state, b) >= iou * 0.5, smooth).otherwise(fresh)

    return F.aggregate(boxes, F.lit(None).cast(BOX), step)


def unique_plates(reads: DataFrame, voting: bool = True) -> DataFrame:
    """One row per video and plate: counts, first and last sight, the first best text, the last best frame, means and the span."""
    rows = read_quality(reads)
    order = F.struct("frame_number", "seq")
    out = rows.groupBy("video_id", "plate").agg(
        F.count("*").alias("total_detections"),
        F.min("frame_number").alias("first_seen_frame"),
        F.max_by("frame_number", order).alias("last_seen_frame"),
        F.min_by("timestamp_ms", order).alias("first_seen_time"),
        F.max_by("timestamp_ms", order).alias("last_seen_time"),
        F.max("confidence").alias("best_confidence"),
        F.max_by("plate_text", F.struct("confidence", -F.col("frame_number"), -F.col("seq"))).alias("plate_text"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("read_quality").alias("avg_quality"),
        F.max("read_quality").alias("best_quality"),
        F.max_by("frame_number", F.struct("read_quality", "frame_number", "seq")).alias("best_frame_number"),
        F.avg("char_conf").alias("char_confirmation"),
    )
    seen = F.when(F.lit(voting) | (F.col("total_detections") > 1), F.col("total_detections")).otherwise(0)
    return out.withColumns({"span_frames": F.greatest(F.lit(1), F.col("last_seen_frame") - F.col("first_seen_frame") + 1), "temporal_observations": seen})


def stable_boxes(reads: DataFrame) -> DataFrame:
    """video_id, plate and the folded box of each."""
    boxes = F.array_sort(F.collect_list(F.struct("frame_number", "seq", "x1", "y1", "x2", "y2")))
    rows = reads.groupBy("video_id", "plate").agg(stable_box(boxes).alias("s"))
    return rows.select("video_id", "plate", "s.x1", "s.y1", "s.x2", "s.y2")


def best_chars(reads: DataFrame) -> DataFrame:
    """video_id, plate, pos, ch, conf: the best character of each place, the first read of the highest confidence."""
    rows = reads.select("video_id", "plate", "frame_number", "seq", F.posexplode("char_confs").alias("pos", "c"))
    best = F.max_by(F.struct("c.ch", "c.conf"), F.struct("c.conf", -F.col("frame_number"), -F.col("seq")))
    return rows.groupBy("video_id", "plate", "pos").agg(best.alias("b")).select("video_id", "plate", "pos", F.col("b.ch"), F.col("b.conf").alias("conf"))


def confirmed_reading(chars: DataFrame, threshold: float = 0.70) -> DataFrame:
    """video_id, plate, reading: characters below the threshold masked."""
    c = F.struct("pos", F.when(F.col("conf") >= threshold, F.col("ch")).otherwise("*").alias("c"))
    return chars.groupBy("video_id", "plate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["c"]), "").alias("reading"))


def with_composite(plates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """plates with composite: weighted shares against the largest counts and spans of the video (or of all, by=[])."""
    w = Window.partitionBy(*(["video_id"] if by is None else by))
    share = lambda c: F.when(F.max(c).over(w) > 0, F.col(c) / F.max(c).over(w)).otherwise(0.0)
    bonus = F.when(F.coalesce(F.col("voted"), F.lit(False)), 1.0).otherwise(F.least(F.lit(1.0), F.col("temporal_observations") / 5)) if "voted" in plates.columns else F.least(F.lit(1.0), F.col("temporal_observations") / 5)
    x = WEIGHTS
    score = x["detections"] * share("total_detections") + x["best"] * F.col("best_confidence") + x["average"] * F.col("avg_confidence") + x["quality"] * F.col("avg_quality") + x["chars"] * F.col("char_confirmation") + x["span"] * share("span_frames") + x["bonus"] * bonus
    return plates.withColumn("composite", score)


def rank_plates(plates: DataFrame, top: int = 10) -> DataFrame:
    """The best plates of each video by composite; ties by first sight."""
    w = Window.partitionBy("video_id").orderBy(F.round("composite", 9).desc(), "first_seen_frame", "plate")
    return with_composite(plates).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= top)


def temporal_prior(reads: DataFrame) -> DataFrame:
    """For each read, the prior its plate had from the frames before it (0 at first sight)."""
    rows = read_quality(reads)
    before = Window.partitionBy("video_id", "plate").orderBy("frame_number").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"n": F.count("*").over(before), "first": F.min("frame_number").over(before), "last": F.max("frame_number").over(before), "best": F.max("confidence").over(before), "best_q": F.max("read_quality").over(before), "chars": F.avg("char_conf").over(before)})
    upto = Window.partitionBy("video_id", "plate").orderBy("frame_number").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"n_now": F.count("*").over(upto), "span_now": F.col("frame_number") - F.min("frame_number").over(upto) + 1})
    video = Window.partitionBy("video_id").orderBy("frame_number").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"max_n": F.max("n_now").over(video), "max_span": F.max("span_now").over(video), "span": F.col("last") - F.col("first") + 1})
    bonus = F.greatest("chars", F.least(F.lit(1.0), F.col("n") / 5))
    prior = F.least(F.lit(1.0), 0.35 * F.col("n") / F.col("max_n") + 0.20 * F.col("span") / F.col("max_span") + 0.20 * F.col("best") + 0.15 * F.col("best_q") + 0.10 * bonus)
    return rows.withColumn("prior", F.when(F.col("n") > 0, prior).otherwise(0.0))


def early_stop(frames: DataFrame, least: float = 0.85, streak: int = 3) -> DataFrame:
    """video_id and the first frame at which the same text has led for that many frames with plates in a row, each with the least confidence. frames: one row per frame with plates."""
    w = Window.partitionBy("video_id").orderBy("frame_number")
    good = F.col("confidence") >= least
    rows = frames.withColumn("good", good).withColumn("breaks", F.when(good & (F.lag("plate").over(w) == F.col("plate")) & F.lag("good").over(w), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("breaks").over(w)).where("good")
    rows = rows.withColumn("run", F.row_number().over(Window.partitionBy("video_id", "island").orderBy("frame_number")))
    return rows.where(F.col("run") >= streak).groupBy("video_id").agg(F.min("frame_number").alias("stop_frame"))


def last_annotation(frames: DataFrame, value: str) -> DataFrame:
    """frames with shown: the value of the last processed frame (null where skipped) up to each."""
    w = Window.partitionBy("video_id").orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("shown", F.last(value, ignorenulls=True).over(w))
