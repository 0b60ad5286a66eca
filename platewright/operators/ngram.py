"""The n-gram plate model: prefixes, letter and pair rates, and the score of a text. The model is a few hundred rows, whatever the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.functions import kernels as k
from platewright.functions.dialect import SPARK
from platewright.functions.tables import LETTERS, MERCOSUL, NGRAM_RANGES, OLD, ordered


def prefixes(spark: SparkSession) -> DataFrame:
    """prefix, state of every three letters in a range; the state that stands last in the table owns the prefix."""
    letters = F.explode(F.split(F.lit(LETTERS), ""))
    codes = spark.range(1).select(letters.alias("a")).select("a", letters.alias("b")).select("a", "b", letters.alias("c")).select(F.concat("a", "b", "c").alias("prefix"))
    ranges = spark.createDataFrame(ordered(NGRAM_RANGES), "seq int, state string, low string, high string")
    found = codes.join(F.broadcast(ranges), F.col("prefix").between(F.col("low"), F.col("high")))
    return found.groupBy("prefix").agg(F.max_by("state", "seq").alias("state"))


def letter_rates(prefix: DataFrame) -> DataFrame:
    """pos (0 to 2), ch, p with one added to each count."""
    spark = prefix.sparkSession
    rows = prefix.select(F.posexplode(F.split("prefix", "")).alias("pos", "ch"))
    total = prefix.agg(F.count("*").alias("total"))
    every = spark.range(3).select(F.col("id").cast("int").alias("pos"), F.explode(F.split(F.lit(LETTERS), "")).alias("ch"))
    counts = rows.groupBy("pos", "ch").agg(F.count("*").alias("n"))
    return every.join(counts, ["pos", "ch"], "left").join(F.broadcast(total)).select("pos", "ch", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + 26)).alias("p"))


def pair_rates(prefix: DataFrame) -> DataFrame:
    """pos (1, 2), prev, ch, p with one added to each count."""
    spark = prefix.sparkSession
    rows = prefix.select(F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.substring("prefix", i, 1).alias("prev"), F.substring("prefix", i + 1, 1).alias("ch")) for i in (1, 2)))).alias("x")).select("x.*")
    counts = rows.groupBy("pos", "prev", "ch").agg(F.count("*").alias("n"))
    totals = rows.groupBy("pos", "prev").agg(F.count("*").alias("total"))
    each = F.explode(F.split(F.lit(LETTERS), ""))
    every = spark.range(1, 3).select(F.col("id").cast("int").alias("pos"), each.alias("prev")).select("pos", "prev", each.alias("ch"))
    joined = every.join(counts, ["pos", "prev", "ch"], "left").join(totals, ["pos", "prev"], "left")
    return joined.select("pos", "prev", "ch", ((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + 26)).alias("p"))


def score_texts(texts: DataFrame, text: str = "t") -> DataFrame:
    """texts (its distinct values of ``text``, compact and upper case) with ngram: 0 to 1; 0 if not of seven characters."""
    spark = texts.sparkSession
    known = prefixes(spark)
    log = lambda p: F.log(F.coalesce(p, F.lit(1e-6)) + 1e-10)
    rows = texts.select(text).distinct().where(F.length(text) == 7)
    singles = letter_rates(known).withColumn("p", log(F.col("p")))
    pairs = pair_rates(known).withColumn("p", log(F.col("p")))
    char = lambda i: F.substring(text, i + 1, 1)
    digit = F.when(F.lit(True), 0.0)
    for i in (3, 5, 6):
        digit = digit + log(F.when(char(i).rlike("[0-9]"), 0.1))
    digit = digit + log(F.when(char(4).rlike("[0-9]"), 0.4 / 10).when(char(4).rlike("[AEIOU]"), 0.001).when(char(4).rlike("[A-Z]"), 0.6 / 21))
    rows = rows.withColumn("l", digit)
    miss = F.log(F.lit(1e-6 + 1e-10))
    for i in (0, 1, 2):
        side = F.broadcast(singles.where(F.col("pos") == i).select(F.col("ch").alias("_c"), F.col("p").alias("_p")))
        rows = rows.join(side, char(i) == F.col("_c"), "left").withColumn("l", F.col("l") + F.coalesce("_p", miss)).drop("_c", "_p")
    for i in (1, 2):
        side = F.broadcast(pairs.where(F.col("pos") == i).select(F.concat("prev", "ch").alias("_c"), F.col("p").alias("_p")))
        rows = rows.join(side, F.substring(text, i, 2) == F.col("_c"), "left").withColumn("l", F.col("l") + F.coalesce("_p", miss)).drop("_c", "_p")
    rows = rows.join(F.broadcast(known), F.substring(text, 1, 3) == F.col("prefix"), "left")
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("l") + 50.0) / 47.0))
    base = F.when(F.col("state").isNotNull(), F.least(F.lit(1.0), base + 0.15)).otherwise(base)
    t, vowel = F.col(text), F.expr(k.vowel_fifth(text))
    base = F.when(t.rlike(OLD), F.least(F.lit(1.0), base + 0.05)).when(t.rlike(MERCOSUL) & ~vowel, F.least(F.lit(1.0), base + 0.07)).when(t.rlike(MERCOSUL), base - 0.05).otherwise(base)
    rows = rows.select(F.col(text), base.alias("ngram"), "state")
    return texts.join(rows, text, "left").withColumn("ngram", F.coalesce("ngram", F.lit(0.0)))


def candidate_table(reads: DataFrame) -> DataFrame:
    """read_id, raw, text, base_conf, support, seq: the distinct candidates of each read, from its text, its corrected text and its variants of seven characters."""
    from platewright.operators.validate import normalize_to_7, validate

    rows = reads.withColumn("raw", F.expr(k.normalize_plate(SPARK, "plate_text")))
    rows = rows.withColumn("_c", F.expr(k.compact(SPARK, "plate_text")))
    plain = F.replace(validate(F.col("_c")), F.lit("-"), F.lit(""))
    rows = rows.withColumn("pool", F.array_compact(F.concat(F.array(F.col("raw"), plain), normalize_to_7(F.col("_c")))))
    rows = rows.select("read_id", "raw", "confidence", F.posexplode_outer("pool").alias("seq", "text")).where("text <> ''")
    return rows.groupBy("read_id", "raw", "text").agg(F.max("confidence").alias("base_conf"), F.count("*").alias("support"), F.min("seq").alias("seq"))
