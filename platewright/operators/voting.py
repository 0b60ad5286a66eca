"""Voting over the reads of a track. Input columns: key columns, seq (order of reading), text, conf; char_confs (array of doubles) is optional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK
from platewright.functions.tables import SIMILAR


def individual(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The first read of the highest confidence, the count, and the first and last frame."""
    best = F.max_by(F.struct("text", "conf"), F.struct("conf", -F.col("seq")))
    out = reads.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("observations"), F.min("seq").alias("first_frame"), F.max("seq").alias("last_frame"))
    return out.select(*keys, F.col("b.text").alias("best_text"), F.col("b.conf").alias("best_conf"), "observations", "first_frame", "last_frame")


def majority(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent text of seven characters, the first seen on ties; its share and its own confidence."""
    by_text = reads.where("length(text) = 7").groupBy(*keys, "text").agg(F.count("*").alias("n"), F.max("conf").alias("c"), F.min("seq").alias("f"))
    found = by_text.groupBy(*keys).agg(F.max_by(F.struct("text", "n", "c"), F.struct("n", -F.col("f"))).alias("m"), F.sum("n").alias("total"))
    share = F.col("m.n") / F.col("total")
    return found.select(*keys, F.col("m.text").alias("major_text"), share.alias("share"), ((share + F.col("m.c")) / 2).alias("major_conf"))


def _votes() -> Column:
    """What a character at a place votes for: each look-alike first, with 0.3 of the confidence, then itself in full."""
    own = [c for c in SIMILAR]
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(s) for s in x)) for c in own for x in (c, SIMILAR[c])))
    alike = F.coalesce(F.try_element_at(table, F.col("ch")), F.array().cast("array<string>"))
    return F.concat(F.transform(alike, lambda s, i: F.struct(s.alias("c"), F.lit(0.3).alias("share"), i.alias("rank"))), F.array(F.struct(F.col("ch").alias("c"), F.lit(1.0).alias("share"), F.size(alike).alias("rank"))))


def positional(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Per place the character with the most weight; ties go to the one that got a vote first."""
    rows = reads.where("length(text) = 7")
    if "char_confs" not in reads.columns:
        rows = rows.withColumn("char_confs", F.lit(None).cast("array<double>"))
    rows = rows.select(*keys, "seq", "text", "conf", "char_confs", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("pos"))
    rows = rows.withColumns({"ch": F.expr("substr(text, pos, 1)"), "w": F.coalesce(F.get("char_confs", F.col("pos") - 1), F.col("conf"))})
    rows = rows.select(*keys, "seq", "pos", "w", F.explode(_votes()).alias("v"))
    weights = rows.groupBy(*keys, "pos", F.col("v.c").alias("c")).agg(F.sum(F.col("w") * F.col("v.share")).alias("w"), F.min(F.struct("seq", "v.rank")).alias("first"))
    n = reads.where("length(text) = 7").groupBy(*keys).agg(F.count("*").alias("n7"))
    # min_by over the negated weight: the largest, and of equal ones (to nine digits) the first voted for
    best = weights.groupBy(*keys, "pos").agg(F.min_by(F.struct("c", "w"), F.struct(-F.round("w", 9), "first")).alias("b"))
    best = best.join(n, keys)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("b.c").alias("c")))), lambda x: x["c"]), "")
    return best.groupBy(*keys).agg(joined.alias("voted_text"), (F.sum(F.least(F.lit(1.0), F.col("b.w") / F.col("n7"))) / 7).alias("voted_conf"))


def hybrid(reads: DataFrame, keys: list[str], least: int = 2, strategy: str = "hybrid") -> DataFrame:
    """Each track's result: a clear and valid majority, else a valid positional vote, else the best read; few reads aren't voted on."""
    rows = individual(reads, keys).join(majority(reads, keys), keys, "left").join(positional(reads, keys), keys, "left")
    plate = lambda c: F.coalesce(F.expr(k.is_plate(SPARK, c)), F.lit(False))
    enough = F.col("observations") >= least
    if strategy == "hybrid":
        how = F.when(~enough, "best").when((F.col("share") > 0.5) & plate("major_text"), "majority").when(plate("voted_text"), "positional").otherwise("best")
    else:
        text = "major_text" if strategy == "majority" else "voted_text"
        how = F.when(enough & F.col(text).isNotNull(), strategy).otherwise("best")
    rows = rows.withColumn("how", how)
    pick = lambda a, b, c: F.when(F.col("how") == "majority", F.col(a)).when(F.col("how") == "positional", F.col(b)).otherwise(F.col(c))
    frame = lambda c: F.when(enough, F.col(c)).alias(c)
    return rows.select(*keys, pick("major_text", "voted_text", "best_text").alias("text"), pick("major_conf", "voted_conf", "best_conf").alias("confidence"), "observations", "best_text", enough.alias("voting_applied"), frame("first_frame"), frame("last_frame"))


def self_consistency(samples: DataFrame, keys: list[str], floor: float = 0.15) -> DataFrame:
    """The most frequent sample (first seen on ties) and a confidence from agreement and format; empty and unreadable samples count against it."""
    rows = samples.withColumn("ok", (F.coalesce("text", F.lit("")) != "") & (F.col("text") != "UNREADABLE"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    by_text = rows.where("ok").groupBy(*keys, "text").agg(F.count("*").alias("votes"), F.min("seq").alias("f"))
    best = by_text.groupBy(*keys).agg(F.max_by(F.struct("text", "votes"), F.struct("votes", -F.col("f"))).alias("m"))
    rows = total.join(best, keys, "left").select(*keys, "total", F.col("m.text").alias("winner"), F.col("m.votes").alias("votes"))
    form = F.expr(k.format_aderence(SPARK, "winner"))
    base = 0.6 * F.col("votes") / F.col("total") + 0.4 * form
    base = F.when((F.col("total") >= 3) & (F.col("votes") == F.col("total")), F.least(F.lit(1.0), base + 0.05)).otherwise(base)
    return rows.select(*keys, F.coalesce("winner", F.lit("")).alias("winner"), F.when(F.col("winner").isNull(), F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), base))).alias("confidence"))
