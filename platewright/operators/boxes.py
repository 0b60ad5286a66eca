"""Boxes: checks, margins, tiles, IoU, greedy suppression, retry reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions import kernels as k

SMALL_HEIGHT, OCR_HEIGHT = 60, 80


def valid_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.where("x1 < x2 AND y1 < y2 AND x1 >= 0 AND y1 >= 0")


def regions(boxes: DataFrame, margin: float = 0.10) -> DataFrame:
    """Crops around boxes: a wider margin for low plates, kept within the image, and the size after enlarging to a readable height."""
    h, w = F.expr("y2 - y1"), F.expr("x2 - x1")
    wide = F.when((h < SMALL_HEIGHT) & (h > 0), F.greatest(F.lit(margin), F.least(F.lit(0.25), 0.15 * (SMALL_HEIGHT / h)))).otherwise(F.lit(margin))
    rows = boxes.withColumn("margin", wide)
    mx, my = F.expr("CAST((x2 - x1) * margin AS BIGINT)"), F.expr("CAST((y2 - y1) * margin AS BIGINT)")
    rows = rows.withColumns({"cx1": F.greatest(F.lit(0), F.col("x1") - mx), "cy1": F.greatest(F.lit(0), F.col("y1") - my), "cx2": F.least(F.col("img_w"), F.col("x2") + mx), "cy2": F.least(F.col("img_h"), F.col("y2") + my)})
    rows = rows.where("cx1 < cx2 AND cy1 < cy2")
    ch, cw = F.expr("cy2 - cy1"), F.expr("cx2 - cx1")
    grown = lambda side: F.when(ch < OCR_HEIGHT, F.expr(f"CAST(({side}) * ({OCR_HEIGHT}e0 / (cy2 - cy1)) AS BIGINT)")).otherwise(F.expr(side))
    return rows.withColumns({"out_w": grown("cx2 - cx1"), "out_h": grown("cy2 - cy1")}).withColumn("crop_w", cw).withColumn("crop_h", ch)


def tiles(images: DataFrame, size: int = 640, overlap: float = 0.25) -> DataFrame:
    """image_id, tx1 ... ty2 of overlapping tiles; none for an image within one tile, and none of under 0.4 of the size."""
    step = int(size * (1 - overlap))
    rows = images.where(f"img_w > {size} OR img_h > {size}")
    rows = rows.withColumn("ty1", F.explode(F.expr(f"sequence(0, img_h - 1, {step})"))).withColumn("tx1", F.explode(F.expr(f"sequence(0, img_w - 1, {step})")))
    rows = rows.withColumns({"tx2": F.least(F.col("tx1") + size, F.col("img_w")), "ty2": F.least(F.col("ty1") + size, F.col("img_h"))})
    return rows.where((F.col("tx2") - F.col("tx1") >= size * 0.4) & (F.col("ty2") - F.col("ty1") >= size * 0.4)).select("image_id", "tx1", "ty1", "tx2", "ty2")


def retry_reason(boxes: DataFrame, large: int = 1600, conf: float = 0.55, area: float = 0.01) -> DataFrame:
    """image_id, reason ('' for none) from each image's boxes; images without boxes come as rows whose confidence is null."""
    found = boxes.groupBy("image_id").agg(
        F.count("confidence").alias("n"),
        F.max(F.greatest("img_w", "img_h")).alias("side"),
        F.max("confidence").alias("best"),
        F.max(F.expr("CAST(greatest(0, x2 - x1) * greatest(0, y2 - y1) AS DOUBLE) / greatest(1, img_w * img_h)")).alias("ratio"),
    )
    reason = F.when(F.col("n") == 0, "no_detections").when(F.col("side") < large, "").when(F.col("best") < conf, "low_confidence").when(F.col("ratio") <= area, "small_plate_candidate").otherwise("")
    return found.select("image_id", reason.alias("reason"))


def _overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda p: (p["x2"] - p["x1"]) * (p["y2"] - p["y1"])
    both = F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)
    return both / F.greatest(F.lit(1), area(a) + area(b) - both)


def nms(boxes: DataFrame, group: str = "image_id", threshold: float = 0.45, least: float = 0.1) -> DataFrame:
    """Greedy suppression by group: boxes by falling confidence (first seen first on ties), each kept unless it overlaps a kept one more than the threshold.

    A group is one image's boxes, folded in one array.
    """
    box = F.struct((-F.col("confidence")).alias("s"), F.col("det_seq"), "x1", "y1", "x2", "y2")
    rows = boxes.where(F.col("confidence") >= least).groupBy(group).agg(F.array_sort(F.collect_list(box)).alias("b"))
    start = F.filter("b", lambda x: F.lit(False))
    keep = F.aggregate("b", start, lambda kept, x: F.when(F.exists(kept, lambda y: _overlap(y, x) > threshold), kept).otherwise(F.concat(kept, F.array(x))))
    return rows.select(group, F.explode(keep).alias("k")).select(group, "k.det_seq", "k.x1", "k.y1", "k.x2", "k.y2", (-F.col("k.s")).alias("confidence"))


def detect_flow(full: DataFrame, tiled: DataFrame, threshold: float = 0.45, **retry) -> DataFrame:
    """Boxes of the whole image and, where a retry is due, of its tiles: merged by suppression if both found any. full: with rows of null confidence for images without boxes."""
    due = retry_reason(full, **retry).where("reason <> ''")
    found = full.where("confidence IS NOT NULL").withColumn("source", F.lit("full_frame"))
    more = nms(tiled).join(tiled.select("image_id", "det_seq").distinct(), ["image_id", "det_seq"]).join(due.select("image_id"), "image_id", "left_semi").withColumn("source", F.lit("tiles"))
    names = ["image_id", "det_seq", "x1", "y1", "x2", "y2", "confidence", "source"]
    both = found.select(*names).unionByName(more.select(*names))
    mixed = both.groupBy("image_id").agg(F.countDistinct("source").alias("n")).where("n > 1").select("image_id")
    merged = nms(both.join(mixed, "image_id", "left_semi"), threshold=threshold).join(both.select("image_id", "det_seq", "source"), ["image_id", "det_seq"])
    return merged.select(*names).unionByName(both.join(mixed, "image_id", "left_anti").select(*names)).join(due, "image_id", "left").withColumn("reason", F.coalesce("reason", F.lit("")))


def with_iou(pairs: DataFrame, a: str, b: str, floor_area: bool = False) -> DataFrame:
    return pairs.withColumn("iou", F.expr(k.iou(a, b, floor_area)))


def order_corners(points: DataFrame, group: str) -> DataFrame:
    """The four corners of each group's points: by least and largest x + y, and least and largest y - x (first seen on ties, then by x and y)."""
    pick = lambda f, e: f(F.struct("x", "y"), F.struct(F.expr(e), *((F.col(c) if f is F.min_by else -F.col(c)) for c in ("seq", "x", "y"))))
    found = points.groupBy(group).agg(pick(F.min_by, "x + y").alias("tl"), pick(F.max_by, "x + y").alias("br"), pick(F.min_by, "y - x").alias("tr"), pick(F.max_by, "y - x").alias("bl"))
    return found.select(group, *(F.col(f"{c}.{a}").alias(f"{c}_{a}") for c in ("tl", "tr", "br", "bl") for a in ("x", "y")))


def fit_geometry(images: DataFrame, width: int = 300, height: int = 100) -> DataFrame:
    """Scaled size and padding of w x h within width x height; extra padding goes right and down."""
    rows = images.withColumn("scale", F.least(F.lit(float(width)) / F.col("w"), F.lit(float(height)) / F.col("h")))
    rows = rows.withColumns({"new_w": F.expr("CAST(w * scale AS BIGINT)"), "new_h": F.expr("CAST(h * scale AS BIGINT)")})
    rows = rows.withColumns({"left": F.expr(f"CAST(floor(({width} - new_w) / 2) AS BIGINT)"), "top": F.expr(f"CAST(floor(({height} - new_h) / 2) AS BIGINT)")})
    return rows.withColumns({"right": F.lit(width) - F.col("new_w") - F.col("left"), "bottom": F.lit(height) - F.col("new_h") - F.col("top"), "method": F.when(F.col("scale") > 1, "cubic").otherwise("area")})
