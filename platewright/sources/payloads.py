"""JSON bodies as rows: fixture manifests, plate-service responses, model decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK

MANIFEST = "version int, fixtures array<struct<id: string, fixture_id: string, path: string, media_type: string, expected_plate: string, expected_format: string, scenario_tags: array<string>, notes: string>>"
RESPONSE = "results array<struct<plate: string, score: double, box: struct<xmin: int, ymin: int, xmax: int, ymax: int>, region: struct<code: string>, vehicle: struct<type: string>, candidates: array<struct<plate: string, score: double>>>>"
DECISION = "selected_plate string, should_override boolean, decision_confidence double, reason string"


def fixtures(rows: DataFrame, body: str) -> DataFrame:
    """One row per fixture; its id falls back to fixture_id, then to the stem of the path."""
    f = rows.select(F.explode(F.from_json(body, MANIFEST)["fixtures"]).alias("f")).select("f.*")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    named = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.nullif(F.col("fixture_id"), F.lit("")), stem)
    return f.withColumns({"fixture_id": named, "expected_plate": F.expr(k.normalize_plate(SPARK, "expected_plate")), "media_type": F.coalesce("media_type", F.lit("image")), "scenario_tags": F.coalesce("scenario_tags", F.array().cast("array<string>"))}).drop("id")


def plate_response(rows: DataFrame, body: str, least: float = 0.5) -> DataFrame:
    """rows with the best result (first of the highest score): plate, score, accepted, format, region, vehicle, box and up to five alternates. Without results plate is ''."""
    results = F.from_json(body, RESPONSE)["results"]
    rows = rows.withColumn("_r", F.coalesce(results, F.array().cast("array<" + RESPONSE.split("array<", 1)[1])))
    first = F.aggregate("_r", F.get("_r", 0), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    rows = rows.withColumn("_b", first).withColumn("plate", F.coalesce(F.expr(k.normalize_ocr_text(SPARK, "_b.plate")), F.lit("")))
    return rows.withColumns(
        {
            "score": F.coalesce("_b.score", F.lit(0.0)),
            "accepted": F.coalesce(F.col("_b.score") >= least, F.lit(False)),
            "format": F.expr(k.detect_format(SPARK, "plate")),
            "region": F.coalesce("_b.region.code", F.lit("")),
            "vehicle": F.coalesce("_b.vehicle.type", F.lit("")),
            "box": F.col("_b.box"),
            "alternates": F.slice(F.coalesce("_b.candidates", F.array().cast("array<struct<plate: string, score: double>>")), 1, 5),
        }
    ).drop("_r", "_b")


def decision(rows: DataFrame, body: str) -> DataFrame:
    """rows with the decision's fields, from the text between the first { and the last }, code fences or not; null fields where there is none."""
    return rows.withColumn("_d", F.from_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1), DECISION)).select("*", "_d.*").drop("_d")


def accepted_pick(rows: DataFrame, pick: str, candidates: str) -> DataFrame:
    """rows with choice: the pick if it is among the candidates (an array), else ABSTAIN."""
    return rows.withColumn("choice", F.when(F.array_contains(candidates, F.col(pick)), F.col(pick)).otherwise("ABSTAIN"))
