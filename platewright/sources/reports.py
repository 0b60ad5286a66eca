"""Sinks: a JSON report per read, evaluation summaries as JSON and rows as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK


def _given(rows: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(n) for n in names if n in rows.columns]


def report_payload(rows: DataFrame, source: str = "content") -> DataFrame:
    """label and payload (JSON) of each read; sections hold what columns the rows have."""
    recognition = F.struct(*_given(rows, ["plate_text", "normalized_text", "raw_ocr_text", "format_type", "is_valid", "ocr_engine", "confidence", "detection_confidence"]), F.expr(k.report_band("confidence", "is_valid")).alias("confidence_band"))
    parts = [F.lit("1.0").alias("report_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("generated_at")]
    if source in rows.columns:
        parts.append(F.struct(F.sha2(F.col(source).cast("binary"), 256).alias("sha256")).alias("source"))
    parts.append(recognition.alias("recognition"))
    parts += _given(rows, ["scenario_tags", "warnings", "quality", "validation", "llm_validation", "forensic", "detector", "alternatives", "timing", "artifacts", "bbox", "char_confidences"])
    label = F.expr(k.normalize_plate(SPARK, "plate_text"))
    return rows.select(F.when(label == "", "unknown").otherwise(label).alias("label"), F.to_json(F.struct(*parts)).alias("payload"))


def write_reports(rows: DataFrame, path: str) -> None:
    """One JSON line per read, in a folder per label's first two characters: few folders, whatever the number of plates."""
    report_payload(rows).withColumn("part", F.substring("label", 1, 2)).select("part", F.col("payload").alias("value")).write.partitionBy("part").mode("append").text(path)


def write_evaluation(summary: DataFrame, scored: DataFrame, path: str) -> None:
    """summary as JSON, and a CSV row per record with its tags joined by commas."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows = scored.select("fixture_id", F.col("expected").alias("expected_plate"), F.col("predicted").alias("predicted_plate"), "confidence", F.col("det_conf").alias("detection_confidence"), F.col("ms").alias("processing_time_ms"), (F.col("exact") == 1).alias("exact_match"), F.col("chars").alias("char_accuracy"), (F.col("wrong") == 1).alias("false_positive"), F.array_join("tags", ",").alias("scenario_tags"))
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
