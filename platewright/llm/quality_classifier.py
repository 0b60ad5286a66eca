"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is the probability that a logistic classifier on plain text statistics gives.
Sites have two levels: a host, and a path within it. Grouped aggregation sums the evidence of all
documents of each path; host posteriors shrink toward the global rate, path posteriors toward their
host's, with strengths from the spread between sites beyond what their sizes explain (moments), so a
site with few documents says little. A second logistic step weighs the document's log-odds against the
log-odds by which its path differs from the global rate.

The fit uses labelled rows of the training folds, at most about ``fit_rows`` of them (see the toxicity
operator); sums over sites cover all documents. Site sums are formed map-side first; they join back on
the path key, where Spark broadcasts them if small and splits a hot site's rows if not.

Edge cases: null and empty texts have statistics of zero and are scored like any; a null host or path is
a site of its own. Without labels of both kinds each score is the share of good labels (0.5 without any).
Repeated rows are scored each and all count for their site. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.llm.common import let, table, text_of, written
from platewright.llm.quality_rules import lines_of, words_of
from platewright.llm.toxicity import logistic, training_rows

FEATURES = ("symbols", "capitals", "repeats", "long_words", "line_repeats", "length", "digits", "marks")


def features(text: Column) -> dict[str, Column]:
    share = lambda n, of: n / F.greatest(of, F.lit(1)).cast("double")
    lines = lines_of(text)
    words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("double").alias("n"),
            F.length(F.array_join(w, "")).cast("double").alias("chars"),
            F.size(F.array_distinct(w)).cast("double").alias("distinct"),
        ),
    )
    f = F.col("_qc_words")
    return {
        "_qc_words": words,
        "symbols": F.least(F.lit(1.0), 10 * share(F.regexp_count(text, F.lit("[#*$%&|<>]")), f["chars"])),
        "capitals": F.least(F.lit(1.0), 2 * share(F.regexp_count(text, F.lit("\\p{Lu}")), f["chars"])),
        "repeats": 1 - F.least(F.lit(1.0), share(f["distinct"], F.pow(F.greatest(f["n"], F.lit(1.0)), F.lit(0.9)))),
        "long_words": F.least(F.lit(3.0), F.abs(share(f["chars"], f["n"]) - 5) / 2),
        "line_repeats": let(lines, lambda x: share(F.size(x) - F.size(F.array_distinct(x)), F.size(x))),
        "length": F.log1p(f["n"]) / 5,
        "digits": F.least(F.lit(1.0), 4 * share(F.regexp_count(text, F.lit("[0-9]")), f["chars"])),
        "marks": F.least(F.lit(1.0), 4 * share(F.regexp_count(text, F.lit("[!?]")), f["n"])),
    }


def with_features(rows: DataFrame) -> DataFrame:
    """rows (with text) and one struct-free column per feature."""
    found = features(text_of("text"))
    return rows.withColumn("_qc_words", found.pop("_qc_words")).withColumns({f"_qc_{k}": v for k, v in found.items()}).drop("_qc_words", "text")


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


@dataclass
class Model:
    evidence: list[float]  # intercept, then FEATURES
    combine: tuple[float, float, float] = (0.0, 1.0, 0.0)  # intercept, own log-odds, site's log-odds

    def own(self) -> Column:
        return sigmoid(sum((F.lit(w) * F.col(f"_qc_{k}") for w, k in zip(self.evidence[1:], FEATURES, strict=True)), F.lit(self.evidence[0])))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fit_rows: int = 20_000) -> Model:
    rows = training_rows(docs, labels, label, id_col, text_col, folds, fit_rows).withColumn("text", F.col("text").cast("string"))
    found = with_features(rows).collect()  # about fit_rows rows of a few numbers
    y = np.array([r["label"] for r in found], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model([math.log(max(share, 1e-9) / max(1 - share, 1e-9))] + [0.0] * len(FEATURES))
    x = np.array([[1.0, *(r[f"_qc_{k}"] for k in FEATURES)] for r in found])
    return Model([float(w) for w in logistic(x, y)])


def strength(groups: DataFrame, total: float, parent: str) -> float:
    """How many documents the prior of a site is worth, by moments: from the spread of site means around their parent's beyond binomial noise."""
    around = F.col(parent)
    noise = F.greatest(around * (1 - around), F.lit(1e-6))
    r = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - around, 2)).alias("spread"),
        F.sum(noise).alias("noise"),
        F.sum(F.col("n") * noise).alias("scale"),
        F.count("*").alias("sites"),
    ).first()
    if not r["sites"] or not total:
        return 1e6
    between = max(0.0, (r["spread"] - r["noise"]) / total)
    return 1e6 if between <= 0 else min(1e6, max(1.0, (r["scale"] / total) / between - 1))


def posteriors(own: DataFrame) -> DataFrame:
    """host, path, site (the path's posterior rate) and base (the global one) from host, path, own."""
    paths = written(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("good")), "quality-sites")
    total = paths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("good").alias("good")).first()
    base = (total["good"] or 0.0) / max(1, total["n"])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("base", F.lit(base))
    k = strength(hosts, total["n"], "base")
    hosts = hosts.select("host", ((F.col("good") + k * base) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    k = strength(paths, total["n"], "host_rate")
    return paths.select("host", "path", ((F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)).alias("site"), F.lit(base).alias("base"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label: str = "quality", **how) -> DataFrame:
    """id, own (the document's evidence), site (its path's posterior), score and kept (score of 0.5 or more)."""
    model = fit(docs, labels, label, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col("source") if host is None else host).alias("host"), (F.col("lang") if path is None else path).alias("path"))
    own = written(with_features(rows).select("id", "host", "path", model.own().alias("own")), "quality-own")
    sites = posteriors(own).select(F.col("host").alias("h"), F.col("path").alias("p"), "site", "base")
    seen = own.join(sites, own["host"].eqNullSafe(F.col("h")) & own["path"].eqNullSafe(F.col("p"))).drop("h", "p")
    seen = seen.withColumns({"a": logit(F.col("own")), "b": logit(F.col("site")) - logit(F.col("base"))})
    known = training_rows(docs, labels, label, id_col, text_col, how.get("folds", 5), how.get("fit_rows", 20_000)).select("id", "label").distinct()
    found = seen.join(known, "id").select("a", "b", "label").collect()  # the fit's rows again
    if len({r["label"] for r in found}) == 2:
        x = np.array([[1.0, r["a"], r["b"]] for r in found])
        w = logistic(x, np.array([r["label"] for r in found], float))
        model.combine = tuple(float(v) for v in w)
    c = model.combine
    p = sigmoid(F.lit(c[0]) + F.lit(c[1]) * F.col("a") + F.lit(c[2]) * F.col("b"))
    return seen.select(F.col("id").alias(id_col), "own", "site", p.alias("score"), (p >= 0.5).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
