"""Fragments of one reading: joined if they make a plate together, else the best of them. Columns: read_id, seq, text, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK


def best_text(fragments: DataFrame) -> DataFrame:
    """read_id, text, score, confidence. Empty fragments are left out; a read of empty fragments alone gives no row."""
    rows = fragments.withColumn("t", F.expr(k.clean_plate_ocr(SPARK, "text"))).where("t <> ''")
    rank = F.when(F.expr(k.is_plate(SPARK, "t")), 2).when(F.length("t") == 7, 1).otherwise(0)
    found = rows.groupBy("read_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "").alias("joined"),
        F.avg("score").alias("mean"),
        F.max_by(F.struct("t", "score"), F.struct(rank, F.col("score"), -F.col("seq"))).alias("b"),
    )
    found = found.withColumn("whole", F.expr(k.clean_plate_ocr(SPARK, "joined"))).withColumn("fits", F.expr(k.is_plate(SPARK, "whole")))
    found = found.select("read_id", F.when(F.col("fits"), F.col("whole")).otherwise(F.col("b.t")).alias("text"), F.when(F.col("fits"), F.col("mean")).otherwise(F.col("b.score")).alias("score"))
    return found.withColumn("confidence", F.expr(k.clip01(f"0.7e0 * {k.clip01('score')} + 0.3e0 * ({k.format_aderence(SPARK, 'text')})")))


def parsed(rows: DataFrame, body: str) -> DataFrame:
    """read_id, seq, text, score from either raw layout: {rec_texts, rec_scores}, or [[box, [text, score]], ...]."""
    new = F.from_json(body, "array<struct<rec_texts: array<string>, rec_scores: array<double>>>")
    first = F.get(new, 0)
    by_new = F.transform(first["rec_texts"], lambda t, i: F.struct(t.alias("text"), F.coalesce(F.get(first["rec_scores"], i), F.lit(0.0)).alias("score")))
    lines = F.from_json(body, "array<array<string>>")
    by_old = F.transform(F.get(lines, 0), lambda x: F.from_json(x, "array<string>"))
    by_old = F.transform(by_old, lambda x: F.from_json(F.get(x, 1), "array<string>"))
    by_old = F.transform(by_old, lambda x: F.struct(F.get(x, 0).alias("text"), F.get(x, 1).cast("double").alias("score")))
    chosen = F.when(F.size(F.coalesce(first["rec_texts"], F.array().cast("array<string>"))) > 0, by_new).otherwise(by_old)
    return rows.select("read_id", F.posexplode_outer(chosen).alias("seq", "f")).where("f.text IS NOT NULL").select("read_id", "seq", "f.text", "f.score")


def char_confidences(text: Column, confs: Column, overall: Column) -> Column:
    """Array of (ch, conf) as long as the text: given values first, then the overall one; without any given, the overall one throughout."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.struct(c.alias("ch"), F.coalesce(F.get(confs, i), overall).alias("conf")))
