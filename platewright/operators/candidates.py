"""Candidate scoring: reading support, pattern, n-gram, agreement and prior make one probability; the best k of each read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK
from platewright.functions.tables import CONFUSION_DEFAULT, SIMILAR, weight
from platewright.operators.ngram import candidate_table, score_texts


def support(raw: str, text: str, conf: str) -> Column:
    """Mean over the candidate's characters: as read, a look-alike of what was read, or neither."""
    pairs = [(a + b, weight(a, b)) for a, others in SIMILAR.items() for b in others]
    table = F.create_map(*(F.lit(x) for p in pairs for x in p))

    def char(c: Column, i: Column) -> Column:
        read = F.substr(F.col(raw), i + 1, F.lit(1))
        look = F.try_element_at(table, F.concat(read, c))
        alike = F.greatest(F.lit(0.12), F.col(conf) * look + (1 - F.col(conf)) * 0.25)
        return F.least(F.lit(1.0), F.when(read == c, F.col(conf)).when(look.isNotNull(), alike).otherwise(F.greatest(F.lit(0.05), (1 - F.col(conf)) * 0.60)))

    scores = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), char)
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.length(text), F.lit(1))


def describe_changes(raw: str, text: str) -> Column:
    """Like 1:A->4, 7:_->2 for the places that differ."""

    def change(c: Column, i: Column) -> Column:
        old = F.substr(F.col(raw), i + 1, F.lit(1))
        old = F.when(old == "", "_").otherwise(old)
        return F.when(old != c, F.concat((i + 1).cast("string"), F.lit(":"), old, F.lit("->"), c))

    found = F.array_join(F.array_compact(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), change)), ", ")
    return F.when(F.col(raw) == "", "candidate").when(found == "", "no-change").otherwise(found)


def scored(reads: DataFrame, raw_count: int = 1) -> DataFrame:
    """reads: read_id, plate_text, confidence, prior. One row per candidate with its parts and composite."""
    rows = candidate_table(reads).join(reads.select("read_id", "prior"), "read_id")
    rows = score_texts(rows, "text").withColumn("ngram", 0.7 * F.col("ngram") + 0.3 * F.col("base_conf"))
    rows = rows.withColumns({"ocr": support("raw", "text", "base_conf"), "pattern": F.expr(k.pattern_score(SPARK, "text")), "consensus": F.least(F.lit(1.0), F.col("support") / raw_count), "temporal": F.least(F.lit(1.0), F.col("prior"))})
    total = 0.30 * F.col("ngram") + 0.30 * F.col("ocr") + 0.20 * F.col("pattern") + 0.10 * F.col("consensus") + 0.10 * F.col("temporal")
    return rows.withColumn("composite", total)


def alternatives(reads: DataFrame, top: int = 5) -> DataFrame:
    """The best candidates of each read (first registered on ties), with probabilities that sum to one, their changes and place."""
    rows = scored(reads)
    w = Window.partitionBy("read_id").orderBy(F.round("composite", 9).desc(), "seq")
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    total = F.sum(F.greatest(F.lit(0.0), "composite")).over(Window.partitionBy("read_id"))
    return rows.select("read_id", F.col("place").cast("long").alias("place"), "text", F.when(total > 0, F.col("composite") / total).otherwise(F.col("composite")).alias("probability"), describe_changes("raw", "text").alias("changes"), "support")


def gate(alternatives: DataFrame, reads: DataFrame, fallback: float = 0.8, gap: float = 0.12) -> DataFrame:
    """read_id, gap, reason: whether a second opinion is asked for. reads: read_id, confidence, is_valid."""
    top = alternatives.groupBy("read_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("place") == 1, F.col("probability"))).alias("p1"), F.max(F.when(F.col("place") == 2, F.col("probability"))).alias("p2"))
    rows = reads.join(top, "read_id").withColumn("gap", F.greatest(F.lit(0.0), F.col("p1") - F.col("p2")))
    ask = ~F.col("is_valid") | (F.col("confidence") < fallback) | (F.col("gap") <= gap)
    return rows.select("read_id", "gap", F.when(F.col("n") < 2, "not_enough_candidates").when(ask, "ask").otherwise("not_needed").alias("reason"))


def confusion_weight(a: str, b: str) -> Column:
    pairs = [(x + y, weight(x, y)) for x, others in SIMILAR.items() for y in others if weight(x, y) != CONFUSION_DEFAULT]
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for p in pairs for v in p)), F.concat(a, b)), F.lit(CONFUSION_DEFAULT))
