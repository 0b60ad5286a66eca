"""Evaluation of predictions against fixtures, by scenario tag, and threshold calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions import kernels as k


def char_accuracy(a: str, b: str) -> Column:
    """Equal characters by position over the longer length; two empty texts agree."""
    same = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: (p["x"] == p["y"]) & (p["x"] != "")))
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 1.0).otherwise(same / F.greatest(F.length(a), F.length(b), F.lit(1)))


def scored(records: DataFrame) -> DataFrame:
    return records.withColumns({"exact": ((F.col("expected") != "") & (F.col("expected") == F.col("predicted"))).cast("double"), "chars": char_accuracy("expected", "predicted"), "wrong": ((F.col("expected") == "") & (F.col("predicted") != "")).cast("double")})


def _summary() -> list[Column]:
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return [F.count("*").alias("n"), mean("exact", "exact_rate"), mean("chars", "char_accuracy"), mean("wrong", "false_positive_rate"), mean("confidence", "avg_confidence"), mean("det_conf", "avg_detection"), mean("ms", "avg_ms")]


def evaluate(records: DataFrame) -> DataFrame:
    """One row; zeros without records."""
    return scored(records).agg(*_summary())


def evaluate_by_tag(records: DataFrame, tags: str = "tags") -> DataFrame:
    """A row per tag; a record counts once for each of its different tags."""
    return scored(records).withColumn("scenario", F.explode(F.array_distinct(tags))).groupBy("scenario").agg(*_summary())


def calibrate(records: DataFrame, detector: list[float], ocr: list[float], fallback: list[float]) -> DataFrame:
    """The grid of thresholds, best first by score, then in grid order.

    The 27 or so combinations are one array per record, summed map-side; a read below a threshold counts as no read.
    """
    grid = [(n, *g) for n, g in enumerate((d, o, f) for d in detector for o in ocr for f in fallback)]
    options = F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lit(d).alias("detector"), F.lit(o).alias("ocr"), F.lit(f).alias("fallback")) for n, d, o, f in grid))
    rows = scored(records).withColumn("g", F.explode(options))  # a record is compared once, not once per combination
    kept = (F.col("det_conf") >= F.col("g.detector")) & (F.col("confidence") >= F.col("g.ocr"))
    blank = F.when(F.length("expected") == 0, 1.0).otherwise(0.0)
    rows = rows.withColumns(
        {
            "exact": F.when(kept, F.col("exact")).otherwise(0.0),
            "chars": F.when(kept, F.col("chars")).otherwise(blank),
            "wrong": F.when(kept, F.col("wrong")).otherwise(0.0),
            "ms": F.col("ms") + F.when(F.col("confidence") < F.col("g.fallback"), 200.0).otherwise(0.0),
        }
    )
    found = rows.groupBy("g").agg(*_summary())
    score = F.expr(k.calib_score("exact_rate", "char_accuracy", "false_positive_rate", "avg_ms"))
    return found.select(F.col("g.n").alias("grid_seq"), "g.detector", "g.ocr", "g.fallback", "n", score.alias("score")).orderBy(F.round("score", 9).desc(), "grid_seq")
